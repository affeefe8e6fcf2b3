"""Names, slugs, digests, keyword predicates and prompts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defect families with the keywords that imply them, in order of precedence.
FAMILIES = (
    ("scratch", ("scratch", "linear or", "linear mark", "groove", "shallow groove", "linear or jagged")),
    ("crack", ("crack", "fissure", "fissured", "linear or jagged line", "jagged line")),
    ("dent", ("dent", "depressed", "indent", "dimpled", "hollow", "concave", "flattened", "compression")),
    ("bulge", ("raised", "bulging", "protrusion", "layered cap", "extra layer")),
    ("stain", ("stain", "blotchy", "discolor", "patchy", "darker patch", "darker shade", "soiling", "soiled", "irregular or blotchy", "dark or discolored patches")),
    ("mold", ("fuzzy", "powdery", "mold", "fungal", "moisture exposure", "fungal growth")),
    ("contamination", ("infestation", "pest", "pitted", "holes", "small spot", "fleck", "round or irregular", "irregular holes or discolorations")),
    ("fragment", ("fragment", "broken", "irregular fragments", "fragments or pieces", "jagged fragments", "rough edges", "irregular or jagged", "structural failure")),
)
FALLBACK_FAMILIES = ("scratch", "stain", "dent", "fragment", "bulge")

# Noun phrases with the triggers that imply them.
PHRASES = (
    ("a scratch", ("scratch", "scrape", "abrasion")),
    ("a dent", ("dent", "deform", "bent", "warp")),
    ("a crack", ("crack", "fissur")),
    ("mold", ("mold", "fungal", "fuzzy", "powdery")),
    ("pest damage", ("infest", "pest", "insect")),
    ("contamination", ("contamination", "soil", "dirt", "oil residue")),
    ("a flattened area", ("compress", "flatten")),
    ("an extra cap layer", ("layered cap", "additional cap", "extra cap")),
    ("holes", ("hole", "pitted")),
    ("rough edges", ("rough edge", "jagged edge")),
    ("rust", ("rust",)),
    ("discolouration", ("discolour", "discolor", "stain")),
    ("a chipped edge", ("chip", "chipped")),
    ("a missing part", ("missing", "absent")),
)

# Prompt templates, states, and descriptions that say nothing.
TEMPLATES = (
    "a photo of a {state} {obj}",
    "a photo of the {state} {obj}",
    "a close-up photo of a {state} {obj}",
    "a cropped photo of a {state} {obj}",
    "a bright photo of a {state} {obj}",
    "a dark photo of a {state} {obj}",
    "a blurry photo of a {state} {obj}",
    "a photo of a small {state} {obj}",
    "a photo of a large {state} {obj}",
    "an industrial inspection photo of a {state} {obj}",
)
NORMAL_STATES = ("normal", "perfect", "flawless", "unblemished", "undamaged", "good")
ANOMALY_STATES = ("damaged", "defective", "broken", "flawed", "anomalous", "with a defect")
PLACEHOLDERS = ("an anomaly is present", "localized visual anomaly affecting the object surface")

# Fixed value: how file names say their view.
VIEW_NAME = r"^(.+?)_view(\d+)\.[A-Za-z]+$"


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def parse_view(name: Column) -> tuple[Column, Column]:
    """A file name's base and its view number; without one, the stem and null."""
    found = name.rlike(VIEW_NAME)
    return F.when(found, F.regexp_extract(name, VIEW_NAME, 1)).otherwise(stem(name)), F.when(found, F.regexp_extract(name, VIEW_NAME, 2).cast("int"))


def matched(text: Column, table) -> Column:
    """The names of a keyword table that some keyword of theirs stands in the text for, in the table's order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = []
    for name, keywords in table:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(lowered, F.lit(k))
        hits.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*hits))


def families(text: Column, table=FAMILIES) -> Column:
    return matched(text, table)


def keywords(text: Column, table=PHRASES) -> Column:
    return matched(text, table)


def taxonomy(descriptions: DataFrame, cls: str, text: str, order: str, table=FAMILIES, fallback=FALLBACK_FAMILIES) -> DataFrame:
    """``cls, families`` for each class: families by how many of its descriptions they match, ties by first seen; ``fallback`` without any."""
    long = descriptions.select(cls, order, F.posexplode_outer(families(F.col(text), table)).alias("_at", "_family"))
    counted = long.where("_family is not null").groupBy(cls, "_family").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(order, "_at")).alias("_first"))
    listed = counted.groupBy(cls).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "_first", "_family"))), lambda s: s["_family"]).alias("families"))
    known = descriptions.select(cls).distinct()
    return known.join(listed, cls, "left").withColumn("families", F.coalesce("families", F.array(*[F.lit(f) for f in fallback])))


def state_prompts(objects: DataFrame, name: str, states, templates=TEMPLATES) -> DataFrame:
    """Every object with every state in every template: ``name, state_no, template_no, prompt``."""
    wide = objects.select(name, F.posexplode(F.array(*[F.lit(s) for s in states])).alias("state_no", "_state"))
    wide = wide.select("*", F.posexplode(F.array(*[F.lit(t) for t in templates])).alias("template_no", "_template"))
    filled = F.replace(F.replace(F.col("_template"), F.lit("{state}"), F.col("_state")), F.lit("{obj}"), F.col(name))
    return wide.select(name, "state_no", "template_no", filled.alias("prompt"))


def description_prompts(descriptions: DataFrame, name: str, text: str, table=PHRASES) -> DataFrame:
    """Distinct prompts from an object's descriptions (placeholders give none): two for each text, three for each phrase."""
    said = F.trim(F.coalesce(F.col(text), F.lit("")))
    empty = F.lit(False)
    for p in PLACEHOLDERS:
        empty = empty | F.contains(F.lower(said), F.lit(p))
    rows = descriptions.where((said != "") & ~empty).select(name, said.alias("_text"))
    obj = F.col(name)
    whole = rows.select(name, F.explode(F.array(F.concat(F.lit("a photo of a defective "), obj, F.lit(": "), "_text"), F.concat(F.lit("a photo of an anomalous "), obj, F.lit(": "), "_text"))).alias("prompt"))
    one = rows.select(name, F.explode(keywords(F.col("_text"), table)).alias("_k"))
    k = F.col("_k")
    short = one.select(name, F.explode(F.array(F.concat(F.lit("a photo of a "), obj, F.lit(" with "), k), F.concat(F.lit("a "), obj, F.lit(" showing "), k), F.concat(F.lit("a close-up photo of "), k, F.lit(" on a "), obj))).alias("prompt"))
    return whole.unionByName(short).distinct()


def slugify(text: Column) -> Column:
    """Runs of anything but letters, digits, dots, underscores and dashes as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def canonical(value):
    """A configuration value in a form whose JSON does not depend on order or on the kind of sequence."""
    if isinstance(value, Mapping):
        return {str(k): canonical(v) for k, v in value.items()}
    if isinstance(value, set | frozenset):
        return sorted(canonical(v) for v in value)
    if isinstance(value, list | tuple):
        return [canonical(v) for v in value]
    if isinstance(value, PurePath):
        return str(value)
    return int(value) if isinstance(value, float) and value.is_integer() else value


def config_digest(fields: Mapping, length: int = 6) -> str:
    """A short SHA-1 over the fields that change a result."""
    return hashlib.sha1(json.dumps(canonical(fields), sort_keys=True).encode()).hexdigest()[:length]


def make_run_id(slug: str, fields: Mapping, tag: str = "", stamp: str = "") -> str:
    """``stamp_slug[_tag]_digest``; the tag is not part of the digest."""
    import re

    parts = [stamp, slug, re.sub(r"[^A-Za-z0-9._-]+", "-", tag).strip("-"), config_digest(fields)]
    return "_".join(p for p in parts if p)
