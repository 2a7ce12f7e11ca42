"""Features by a plain count, folds, calibration, and rows of all kinds."""

import math
import zlib

import pytest

from gravelbed.llm import toxicity


def test_features_of_a_made_text():
    got = dict(zip(toxicity.FEATURES, toxicity.features(b"You are an IDIOT, 1d10t!! soooo what?", {"what": 3.0}), strict=True))
    assert got["fixed_rate"] == pytest.approx(1 / 7) and got["learnt_rate"] == pytest.approx(1 / 7) and got["learnt_top"] == 3.0
    assert got["near_you"] == pytest.approx(1 / 7) and got["shouted"] == pytest.approx(1 / 7) and got["hidden"] == pytest.approx(1 / 7) and got["stretched"] == pytest.approx(1 / 7)
    assert got["exclaims"] == pytest.approx(2 / 37) and got["capitals"] == pytest.approx(6 / 37) and got["words"] == pytest.approx(math.log(8))
    assert all(math.isfinite(x) for x in toxicity.features(b"", {})) and len(toxicity.features("é\xff".encode("latin-1"), {})) == len(toxicity.FEATURES)


def test_whole_table(spark, sf_dir):
    rows = toxicity.op5_toxicity(spark, sf_dir).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = ([s for s, y in held if y == k] for k in (0, 1))
    if good and bad:
        assert sum((b > g) + (b == g) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.7


def test_no_class_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "you idiot", 7.5, "f"), (1, "you idiot", 7.5, "f"), (2, None, 1.0, "g"), (None, "", 2.0, "h"), (4, "fine words " * 20_000, 3.0, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, features string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.accepted(docs, labels)
    assert got.columns == docs.columns and sorted((r["score"], r["features"]) for r in got.collect()) == [(1.0, "g"), (2.0, "h"), (3.0, "i")]
    assert toxicity.accepted(docs.limit(0), labels.limit(0)).count() == 0
