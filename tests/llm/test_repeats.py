"""Suffix-array dedup against a dictionary of all windows."""

import hashlib

import numpy as np

from gravelbed.llm import repeats


def brute_force(rows: list[tuple[int, str | None]], window: int = repeats.WINDOW) -> list[tuple]:
    """op7's rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) by a dictionary of all windows."""
    seen, out = set(), []
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        hit = bytearray(len(raw))
        for at in range(len(raw) - window + 1):
            w = raw[at : at + window]
            if w in seen:
                hit[at : at + window] = b"\x01" * window
            seen.add(w)
        kept = bytes(b for b, h in zip(raw, hit, strict=True) if not h)
        n_spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((doc, len(raw), sum(hit), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def digested(spark, rows):
    """op7's rows for (doc_id, text) rows, through a written table."""
    import tempfile

    d = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return rows_of(repeats.op7_suffix_dedup(spark, d))


def test_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(repeats.op7_suffix_dedup(spark, sf_dir)) == brute_force(rows)


def test_edges_runs_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    rnd = "".join(chr(97 + (i * i * 31 + i // 7) % 26) for i in range(900))
    rows = [(1, "a" * 350), (2, rnd), (3, "x" + rnd[100:400] + "y" + rnd[350:700]), (4, ""), (5, None), (6, rnd[:99]), (7, rnd[:100]), (8, "é" * 120 + rnd[:101])]
    assert digested(spark, rows) == brute_force(rows)


def test_null_ids_and_repeated_rows(spark):
    text = "".join(f"{i}," for i in range(60))
    got = [tuple(r) for r in repeats.kept_texts(spark.createDataFrame([(None, text), (1, text), (2, "short"), (2, "short")], "doc_id long, text string")).collect()]
    by_id = {(d, n): (spans, bytes(kept)) for d, n, spans, kept in got}
    assert len(got) == 4 and not by_id[(None, len(text))][0] and by_id[(1, len(text))][1] == b"" and by_id[(2, 5)] == ([], b"short")


def test_spans_merge_and_digests_repeat_within_a_document():
    start, stop = repeats.merged(np.array([50, 0, 10, 5, 90]), np.array([60, 20, 12, 21, 95]))
    assert (start.tolist(), stop.tolist()) == ([0, 50, 90], [21, 60, 95])
    touching = repeats.merged(np.array([7, 0]), np.array([9, 7]))
    assert [x.tolist() for x in touching] == [[0], [9]] and not len(repeats.merged(np.empty(0), np.empty(0))[0])
    seen: dict = {}
    assert repeats._again(np.array([1, 1, 1, 2, 2]), [b"a", b"b", b"a", b"a", b"c"], seen) == [False, False, True, False, False]
    assert repeats._again(np.array([2, 3]), [b"c", b"c"], seen) == [True, False] and repeats._again(np.empty(0), [], seen) == []
