"""Raked probabilities against their targets, summed in plain Python; both places of raking; odd rows."""

import re
from collections import Counter

import pytest

from gravelbed.llm import mixing


def tokens(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(have, power, goal):
    """Plain water filling: tempered shares of goal tokens, none over what a value has."""
    full = set()
    while True:
        rest = goal - sum(have[v] for v in full)
        total = sum(n**power for v, n in have.items() if v not in full)  # a common factor of n does not matter
        want = {v: have[v] if v in full else rest * have[v] ** power / total for v in have}
        over = {v for v in have if want[v] > have[v] * (1 + 1e-12)}
        if not over:
            return want
        full |= over


def test_expected_tokens_meet_the_default_targets(spark, sf_dir):
    rows = mixing.op2_mixing(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r["n_tokens"] == tokens(texts[r["doc_id"]]) and r["calibrated"] for r in rows)
    total = sum(r["n_tokens"] for r in rows)
    for d in mixing.DIMENSIONS:
        have, expected = Counter(), Counter()
        for r in rows:
            have[r[d]] += r["n_tokens"]
            expected[r[d]] += r["n_tokens"] * r["probability"]
        want = filled({v: n * mixing.FILL for v, n in have.items() if n}, mixing.TEMPERATURE, mixing.KEEP_SHARE * total)
        assert all(expected[v] == pytest.approx(want[v], rel=1e-3) for v in want)
    assert all(0 <= r["probability"] <= 1 and (r["probability"] < 1 or r["kept"]) for r in rows)
    assert sum(r["n_tokens"] for r in rows if r["kept"]) == pytest.approx(0.8 * total, rel=0.1)


def docs_of(spark, cells):
    rows = [(i * 100 + k, "w " * n, a, b) for i, (a, b, n) in enumerate(cells) for k in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string, a string, b string")


def test_own_targets_by_both_ways(spark):
    docs = docs_of(spark, [("x", "p", 50), ("x", "q", 20), ("y", "p", 10), ("y", "q", 40), ("z", "p", 5), ("z", None, 7)])
    targets = {"a": spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 0.5)], "value string, share double"), "b": spark.createDataFrame([("p", 0.45), ("q", 0.5), (mixing.NULL, 0.05)], "value string, share double")}
    out = []
    for here in (1000, 0):
        got = mixing.mixed(docs, targets, ("a", "b"), 0.5, here=here).collect()
        out.append({(r["a"], r["b"]): r["probability"] for r in got})
        sums = Counter()
        for r in got:
            sums[r["a"]] += r["n_tokens"] * r["probability"]
            sums[r["b"]] += r["n_tokens"] * r["probability"]
        kept = sums["x"] + sums["y"] + sums["z"]
        assert all(r["calibrated"] for r in got) and sums["x"] == pytest.approx(kept * 3 / 5.5, rel=1e-3) and sums["q"] == pytest.approx(kept / 2, rel=1e-3)
    assert out[0] == pytest.approx(out[1], rel=1e-4)
    shown = {(r["dimension"], r["value"]): r["expected"] for r in mixing.marginals(mixing.mixed(docs, targets, ("a", "b"), 0.5), ("a", "b")).collect()}
    assert shown[("a", "x")] == pytest.approx(sums["x"], rel=1e-4)


def test_contradicting_targets_are_flagged(spark):
    docs = docs_of(spark, [("x", "p", 50), ("y", "q", 50)])
    targets = {"a": spark.createDataFrame([("x", 0.9), ("y", 0.1)], "value string, share double"), "b": spark.createDataFrame([("p", 0.1), ("q", 0.9)], "value string, share double")}
    assert {r["calibrated"] for r in mixing.mixed(docs, targets, ("a", "b"), 0.5).collect()} == {False}
    with pytest.raises(ValueError):
        mixing.mixed(docs, {"a": targets["b"]}, ("a",)).collect()


def test_topic_is_the_bucket_of_most_long_words(spark):
    texts = ["elephants elephants butterfly tiny", "", None, "short words", "butterfly ELEPHANTS elephants " * 50]
    got = [r["topic"] for r in mixing.with_topic(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    alone = mixing.with_topic(spark.createDataFrame([("elephants",)], "text string")).first()["topic"]
    assert got == [alone, "none", "none", "none", alone]


def test_nulls_repeats_empty_tables_and_clashing_names(spark):
    rows = [(1, "a b", "s", None, 7, 1, 9), (1, "a b", "s", None, 7, 1, 9), (None, None, None, "en", 7, 1, 9), (3, "", "s", "en", None, 1, 9), (4, "w " * 5000, "t", "de", 7, 1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, probability int, _row int, _counts int")
    once, again = mixing.sampled(docs), mixing.sampled(docs)
    assert once.columns == docs.columns and sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
    assert mixing.sampled(docs, keep_share=1.0).count() == len(rows)
    assert mixing.sampled(docs.limit(0)).count() == 0


def test_probabilities_join_without_python_workers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "ExistingRDD" not in mixing.sampled(docs)._jdf.queryExecution().toString()
