"""Pixels from files, submissions as files and zips, ledgers, priors and view statistics at rest."""

import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import ordering, priors
from tessera.sources import images, pixels, predictions


def png(image, filters=(0, 1, 2, 3, 4)):
    """A PNG file whose rows go through the filters in turn, written by the format's definition."""
    h, w, step = image.shape
    rows = []
    for y in range(h):
        kind = filters[y % len(filters)]
        line = []
        for i in range(w * step):
            x = int(image[y].ravel()[i])
            a = int(image[y].ravel()[i - step]) if i >= step else 0
            b = int(image[y - 1].ravel()[i]) if y else 0
            c = int(image[y - 1].ravel()[i - step]) if y and i >= step else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        rows.append(bytes([kind, *line]))

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[step], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("step", [1, 3, 4])
def test_png_filters(step):
    image = np.random.default_rng(step).integers(0, 256, (11, 7, step)).astype(np.uint8)
    assert (pixels.decode_image(png(image)) == image[..., : min(step, 3)]).all()


def test_other_formats_and_broken_files():
    image = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    assert (pixels.decode_image(b"P6\n# x\n3 2\n255\n" + image.tobytes()) == image).all()
    lines = b"".join(row[:, ::-1].tobytes() + b"\0" * 3 for row in image[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines
    assert (pixels.decode_image(bmp) == image).all()
    for broken in (b"", b"GIF89a", png(image)[:40]):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            pixels.decode_image(broken)


def test_resizing_keeps_constants_and_masks_stay_binary():
    flat = np.full((9, 5, 3), 51, dtype=np.uint8)
    assert np.allclose(pixels.prepared(flat, 4, normalise=False), 0.2)
    assert np.allclose(pixels.prepared(flat, 4)[0], (0.2 - 0.485) / 0.229)
    mask = pixels.prepared_mask(np.array([[0, 255], [128, 127]], dtype=np.uint8)[..., None], 4)
    assert mask.tolist() == [[0, 0, 1, 1], [0, 0, 1, 1], [1, 1, 0, 0], [1, 1, 0, 0]]


def test_a_tree_of_images_is_scanned_and_loaded(spark, tmp_path):
    image = np.random.default_rng(0).integers(0, 256, (8, 8, 3)).astype(np.uint8)
    mask = np.zeros((8, 8, 1), dtype=np.uint8)
    mask[2:5, 3:6] = 255
    for folder, name, data in (("class_01/train/good", "a_view00.png", png(image)), ("class_01/train/dent", "b_view01.png", png(image)), ("class_01/ground_truth_train/dent", "b_view01.png", png(mask)), ("class_01/test", "c_view02.png", b"broken")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_bytes(data)
    found = images.scan_dataset(spark, str(tmp_path))
    got = {r["stem"]: r for r in pixels.load(found, 8, normalise=False).collect()}
    assert len(got) == 3 and np.allclose(np.array(got["a_view00"]["data"]).reshape(3, 8, 8), image.transpose(2, 0, 1) / 255, atol=1e-6)
    assert sum(got["b_view01"]["mask"]) == 9 and sum(got["a_view00"]["mask"]) == 0
    assert got["c_view02"]["data"] is None and "not known" in got["c_view02"]["error"]
    seen = pixels.in_batches(pixels.load(found, 8), lambda x, m, keys: pd.DataFrame({"key": keys, "n": [x.shape[1] * 100 + len(x)] * len(x)}), "key string, n long", batch=1).collect()
    assert [r["n"] for r in seen] == [301, 301]


def test_submission_files_and_zips(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{k}", f"q8rle 1 2 {k} 2") for k in range(30)], "ID string, Label string")
    target = predictions.write_submission(rows, f"{tmp_path}/s.csv", zip_it=True)
    lines = (tmp_path / "s.csv").read_text().splitlines()
    assert lines[0] == "ID,Label" and len(lines) == 31 and lines[1:] == sorted(lines[1:])
    assert target.endswith("s.zip") and zipfile.ZipFile(target).read("s.csv").decode().splitlines() == lines
    for path in (f"{tmp_path}/s.csv", target):
        assert {tuple(r) for r in predictions.read_submission(spark, path).collect()} == {tuple(r) for r in rows.collect()}
    predictions.write_submission(rows.limit(3), f"{tmp_path}/s.csv")  # written again
    assert len((tmp_path / "s.csv").read_text().splitlines()) == 4
    other = rows.where("ID <> 'i7'").withColumn("Label", F.lit("q8rle 2 4 255 8"))
    predictions.write_submission(other, f"{tmp_path}/t.csv")
    got = predictions.test_scores(spark, {"a": target, "b": f"{tmp_path}/t.csv"}).collect()
    assert len(got) == 29 and all((r["h"], r["w"], r["b"]) == (1, 2, [1.0, 1.0]) for r in got)
    with pytest.raises(ValueError):
        predictions.read_submission(spark, str(predictions.write_submission(rows.limit(0), f"{tmp_path}/none.csv")))


def test_ledgers_widen(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    predictions.write_ledger_row(spark, path, {"run_id": "a", "AP": 0.5})
    predictions.write_ledger_row(spark, path, {"run_id": "b", "AP": 0.25, "AP_class_09": 1, "note": None})
    got = {r["run_id"]: r.asDict() for r in predictions.read_ledger(spark, path).collect()}
    assert got["a"] == {"run_id": "a", "AP": "0.5", "AP_class_09": "", "note": ""} and got["b"]["AP_class_09"] == "1"


def test_priors_and_view_statistics_at_rest(spark, tmp_path):
    masks = spark.createDataFrame([("a", 2, 2, [0, 1, 0, 0]), ("a", 2, 2, [0, 1, 1, 0])], "cls string, h int, w int, mask array<int>")
    made = priors.spatial_priors(masks, 0.0)
    priors.write_priors(made, f"{tmp_path}/priors")
    got = {r["cls"]: r for r in priors.load_priors(spark, f"{tmp_path}/priors", ["a", "b"]).collect()}
    assert got["a"]["heat"] == [0.0, 1.0, 0.5, 0.0] and got["b"]["h"] == 128 and sum(got["b"]["heat"]) == 0
    assert {r["cls"]: sum(r["heat"]) for r in priors.load_priors(spark, f"{tmp_path}/nowhere", ["a"]).collect()} == {"a": 0.0}
    scores = spark.createDataFrame([(k % 2, float(k)) for k in range(100)], "view int, v double")
    stats = ordering.calibration(scores, "v", by=("view",))
    priors.write_view_stats(stats, f"{tmp_path}/views")
    assert sorted(map(tuple, priors.load_view_stats(spark, f"{tmp_path}/views").collect())) == sorted(map(tuple, stats.select("view", "lo", "hi").collect()))
