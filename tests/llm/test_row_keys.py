"""Dedup of rows whose ids repeat or are missing."""

from gravelbed.llm import exact_dedup, simhash

BASE = [f"w{i}" for i in range(200)]
NEAR = " ".join([*BASE[:100], "new", *BASE[101:]])


def test_near_copies_under_shared_and_missing_ids(spark):
    rows = [(1, " ".join(BASE)), (9, NEAR), (9, "of its own"), (9, "of its own"), (None, NEAR + " x"), (None, "alone"), (None, "q " * 9), (None, "Q " * 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.deduplicated(frame).collect())
    assert len(got) == 5 and (0, "alone") in got and got[-3:] == [(1, " ".join(BASE)), (9, "of its own"), (9, "of its own")]


def test_exact_copies_under_shared_and_missing_ids(spark):
    rows = [(1, "a", 1), (9, "A", 2), (9, "a", 3), (9, "b", 4), (12, "b", 5), (None, "c", 6), (None, "c", 7), (None, "b", 8), (3, None, 9), (4, "", 10)]
    got = exact_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in got) == [(0, "c"), (4, ""), (9, "a"), (12, "b")]
