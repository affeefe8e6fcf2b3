import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import codec


def encoded(spark, values, h, w):
    return spark.createDataFrame([(values, h, w)], "v array<int>, h int, w int").select(codec.encode(F.col("v"), F.col("h"), F.col("w")).alias("x")).first()["x"]


def decoded(spark, payload, **how):
    return spark.createDataFrame([(payload,)], "p string").select(codec.decode(F.col("p"), **how).alias("x")).first()["x"]


def test_constant_map_is_one_run(spark):
    assert encoded(spark, [42] * 256, 16, 16) == "q8rle 16 16 42 256"


def test_runs_go_down_the_columns(spark):
    assert encoded(spark, [1, 2, 3, 4], 2, 2) == "q8rle 2 2 1 1 3 1 2 1 4 1"


def test_empty_body_is_zeros(spark):
    assert decoded(spark, "q8rle 4 5") == [0] * 20


@pytest.mark.parametrize("h,w", [(1, 1), (3, 5), (5, 3), (1, 7)])
def test_round_trip(spark, h, w):
    values = [(7 * i * i + 3 * i) % 256 for i in range(h * w)]
    assert decoded(spark, encoded(spark, values, h, w)) == values


@pytest.mark.parametrize("payload", ["rle 2 2 0 4", "q8rle 2", "q8rle 2 2 5", "q8rle 2 2 5 3", "q8rle 2 2 300 4", "q8rle 2 x 0 4", "q8rle -1 2 0 0"])
def test_malformed_payloads(spark, payload):
    assert decoded(spark, payload, on_error="null") is None
    with pytest.raises(PySparkException):
        decoded(spark, payload)


def test_wrong_size_raises(spark):
    with pytest.raises(PySparkException):
        encoded(spark, [1, 2, 3], 2, 2)


def test_quantise_clips_and_rounds_half_to_even(spark):
    row = spark.createDataFrame([([-1.0, 2.0, 0.5 / 255, 1.5 / 255, 0.5],)], "v array<double>").select(codec.quantise(F.col("v")).alias("q")).first()["q"]
    assert row[:2] == [0, 255] and row[4] in (127, 128)
