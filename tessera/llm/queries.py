"""The opN queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from tessera.llm.hmm import op2_hmm
from tessera.llm.neardup import op7_neardup
from tessera.llm.packing import op4_packing
from tessera.llm.pieces import op3_sentencepiece
from tessera.llm.quality import op1_quality
from tessera.llm.secrets import OP10_SQL, op10_secrets
from tessera.llm.sharding import OP5_SQL, op5_sharding
from tessera.llm.topk import OP6_SQL, op6_topk
from tessera.llm.toxicity import op8_toxicity
from tessera.llm.tiff import media_digests


def op9_tiff_media(spark, sf_dir):
    """Every text stored as a TIFF, read back page by page and described."""
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_quality": op1_quality, "op2_hmm": op2_hmm, "op3_sentencepiece": op3_sentencepiece, "op4_packing": op4_packing, "op5_sharding": op5_sharding, "op6_topk": op6_topk, "op7_neardup": op7_neardup, "op8_toxicity": op8_toxicity, "op9_tiff_media": op9_tiff_media, "op10_secrets": op10_secrets}
ORACLE_SQL: dict[str, str] = {"op5_sharding": OP5_SQL, "op6_topk": OP6_SQL, "op10_secrets": OP10_SQL}
