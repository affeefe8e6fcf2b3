"""Secret scans on long texts, many matches and clashing columns, against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from test_documents import base_spans

from tessera.llm import secrets


def merged(text, spans, mark):
    """The text with every run of overlapping spans replaced, by hand."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join(out) + text[at:]


def mixed(rng, n):
    parts = ["token", "=", "abcdef012345", "AKIA" + "A1" * 8, " ", "é", "😀", "Zx9+Qm2/Lp7vRt4kWb8nYc3s", "deadbeef" * 3, "x", "passwd: 'abc"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_many_spans_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [mixed(rng, n) for n in (1, 5, 40, 300, 300, 300, 9_000)]
    clashing = "doc_id long, text string, _base string, _added int, _all int, _text string, row int, spans int, reach int, every int, ms int, x int"
    df = spark.createDataFrame([(k, t, "b", 1, 2, "t", 3, 4, 5, 6, 7, 8) for k, t in enumerate(texts)], clashing)
    found = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    cut = secrets.redact(df)
    assert cut.columns == df.columns
    shown = {r["doc_id"]: r for r in cut.collect()}
    for k, t in enumerate(texts):
        base = [(s["start"], s["stop"]) for s in found[k]["_base"]]
        assert [f"{s['kind']}:{s['start']}:{s['stop']}" for s in found[k]["_base"]] == base_spans(t)
        added = [(s["start"], s["stop"]) for s in found[k]["_added"]]
        assert all(t[a:b] == s["m"] for (a, b), s in zip(added, found[k]["_added"], strict=True))
        assert not any(a <= c and d <= b for a, b in base for c, d in added)
        assert shown[k]["text"] == merged(t, base + added, "[secret]")
        assert (shown[k]["_base"], shown[k]["_all"], shown[k]["_text"], shown[k]["row"], shown[k]["x"]) == ("b", 2, "t", 3, 8)


@pytest.mark.parametrize("kind", ["path", "hex", "base64"])
def test_texts_of_a_megabyte(spark, kind):
    rng = random.Random(5)
    text = {
        "path": "a1/" * 350_000,
        "hex": " ".join(f"{rng.getrandbits(128):032x}" for _ in range(31_000)),
        "base64": "".join(rng.choice(secrets.ALPHABET) for _ in range(1 << 20)),
    }[kind]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.scan(df).select(secrets.joined("_base").alias("base"), F.size("_added").alias("n")).first()
    assert row["base"] == ",".join(base_spans(text)) and row["n"] == (kind == "base64")
    want = {"path": text, "hex": " ".join(["[secret]"] * 31_000), "base64": "[secret]"}[kind]
    assert secrets.redact(df).first()["text"] == want
