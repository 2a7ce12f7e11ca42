"""The cuckoo-filter index: insertion, deletion, resizing and stale ids; odd rows."""

import hashlib
import random

from gravelbed.llm import exact_dedup
from gravelbed.llm.exact_dedup import CuckooIndex


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_filter_against_a_dictionary():
    index, live, draw = CuckooIndex(2), {}, random.Random(3)
    for _ in range(20_000):
        i = draw.randrange(3000)
        if draw.random() < 0.6:
            if index.find(key(i), i) is None:
                index.insert([key(i), i, i, 1, False])
            live[i] = True
        else:
            assert index.delete(key(i), i) == (live.pop(i, None) is not None)
    assert sorted(e[1] for e in index.entries()) == sorted(live) and all((index.find(key(i), i) is not None) == (i in live) for i in range(3000))
    assert index.find(key(next(iter(live))), -1) is None  # the length is part of the key


def test_deletions_leave_live_digests(spark):
    def rows(*ids):
        return exact_dedup.digests(spark.createDataFrame([(i, t) for i, t in ids], "doc_id long, text string"))

    every = [(1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, "a")]
    index = exact_dedup.apply(None, inserted=rows(*every)).drop("stale")
    after = exact_dedup.apply(index, deleted=rows((5, "a"), (4, "c")))
    assert {(r["keep_id"], r["group_size"], r["stale"]) for r in after.collect()} == {(5, 2, True), (3, 1, False)}
    live = rows((1, "a"), (2, "A"), (3, "b"))
    assert {(r["keep_id"], r["group_size"]) for r in exact_dedup.refreshed(after, live).collect()} == {(2, 2), (3, 1)}


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None, 1, 2, 3), (2, "", 1, 2, 3), (3, "x " * 100_000, 1, 2, 3), (4, "X " * 100_000, 4, 5, 6), (None, "q", 7, 8, 9), (None, "Q", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _sha256 int, row int")
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns and sorted((r["doc_id"] or 0, r["_gone"], r["_sha256"], r["row"]) for r in got.collect()) == [(0, 7, 8, 9), (2, 1, 2, 3), (4, 4, 5, 6)]
    assert exact_dedup.deduplicated(docs.limit(0)).count() == 0
