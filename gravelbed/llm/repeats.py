"""Suffix-array dedup: which bytes lie in a 100-byte string that also starts earlier.

A depth-limited radix sort, most significant digit first, of a sparse set of suffixes: they
are ordered only through the threshold of WINDOW tokens (bytes), each pass deals the
suffixes that still have equals by one more digit, and the groups that are equal at full
depth are exactly the repeated windows.

* Sparse suffixes: each window is represented by its anchor, the position in it whose GRAM
  bytes hash lowest (the leftmost of equals). The choice depends on the window alone, so
  equal windows have equal anchors at equal offsets. Neighbouring windows share an anchor; a
  run of them is one row (about one for each 35 bytes).
* First digit: the anchor's gram. Runs whose gram occurs once are unique and leave.
* Second digit: all bytes of the run (128-bit digest). In a group of equal runs all but the
  first are repeats as a whole.
* Third digit: where a gram has several different runs (the edges of repeated passages), the
  first of each is cut into blocks of BLOCK windows at fixed offsets from the anchor. The bytes
  that all windows of a block share are the digit; a block that has it alone is unique and
  leaves, and blocks equal as a whole are repeats like equal runs.
* Last digit: blocks that still differ are taken apart into single windows, dealt by their
  own digests.

A group is only counted and its first member taken, with map-side combining, and the members
meet that one row in a join, so a passage that a third of all rows share is no group of rows.

Nulls: a null text is empty. A null doc_id sorts before all others. Rows of one doc_id with
different texts are different documents, ordered by a hash of the text; rows equal in both
count as one document and get the same result. Empty texts and those under WINDOW bytes
have nothing removed. Extra columns are ignored. Long texts are cut into pieces that overlap
by a window, so the size of the arrays is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

WINDOW, GRAM, BLOCK = 100, 32, 8
#: Bytes searched at once; positions must fit the low POSITION bits of a sort key.
PIECE, POSITION = 1 << 18, 20
NO_ID = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
#: Ranges of windows: their first and last start, a digit, the digest of all their bytes, and
#: whether the same bytes stand earlier in the same document.
RANGES = "doc long, first int, last int, digit long, full binary, again boolean"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    one, inverse = np.ones(1, np.uint64), np.uint64(pow(BASE, -1, 1 << 64))
    up = np.cumprod(np.concatenate([one, np.full(n, np.uint64(BASE))]), dtype=np.uint64)
    return up, np.cumprod(np.concatenate([one, np.full(n, inverse)]), dtype=np.uint64)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of gram bytes."""
    if not _POWERS or len(_POWERS[0][0]) <= len(data):
        _POWERS[:] = [_powers(max(len(data), PIECE + 2 * WINDOW))]
    up, down = _POWERS[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(sums) - gram]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, lengths: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of windows with one anchor in texts laid end to end: first and last start, anchor, gram hash."""
    none = np.empty(0, np.int64)
    if len(data) < window:
        return none, none, none, none
    h = gram_hashes(data, gram)
    low = np.uint64((1 << POSITION) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, window - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(least)]
    start = np.nonzero(np.arange(window, len(least) + window) <= ends)[0]
    if not len(start):
        return none, none, none, none
    anchor = (least[start] & low).astype(np.int64)
    new = np.nonzero((np.diff(anchor) != 0) | (np.diff(start) != 1))[0] + 1
    head = np.concatenate([[0], new])
    return start[head], start[np.concatenate([new - 1, [len(start) - 1]])], anchor[head], h[anchor[head]].view(np.int64)


def _pieces(batch: pa.RecordBatch):
    """Places (row number, offset in its text) and bytes of parts, together about PIECE bytes each time."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        if not text or len(text) < WINDOW:
            continue
        for at in range(0, len(text) - WINDOW + 1, PIECE):
            part = text[at : at + PIECE + WINDOW - 1]
            if size + len(part) > PIECE + 2 * WINDOW and rows:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append((i, at))
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, parts


def _grams(keyed: DataFrame) -> DataFrame:
    """The first digit of every run."""

    def run(batches):
        for batch in batches:
            for _, parts in _pieces(batch):
                d1 = runs(np.frombuffer(b"".join(parts), np.uint8), np.array([len(x) for x in parts]))[3]
                yield pa.record_batch([pa.array(d1)], names=["digit"])

    return mapped(keyed, run, "digit long")


def _again(doc: np.ndarray, full: list[bytes], seen: dict[int, set]) -> list[bool]:
    """Whether a digest came before in its document, whose rows stand together; seen: those of the last document, which changes."""
    out: list[bool] = []
    edge = [0, *(np.flatnonzero(doc[1:] != doc[:-1]) + 1).tolist(), len(doc)]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if a == b:
            continue
        if (key := int(doc[a])) not in seen:
            seen.clear()
            seen[key] = set()
        had, new = seen[key], set(full[a:b])
        if len(new) == b - a and had.isdisjoint(new):
            out += [False] * (b - a)
            had |= new
            continue
        for x in full[a:b]:
            out.append(x in had)
            had.add(x)
    return out


def _ranges(doc, first, last, digit, full, seen: dict[int, set], extra=()) -> pa.RecordBatch:
    """A batch of ranges; seen: the digests met before in the last document, which grows."""
    again = _again(doc, full, seen)
    columns = [pa.array(doc), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(digit), pa.array(full, pa.binary()), pa.array(again)]
    return pa.record_batch([*columns, *(pa.array(x, pa.int32()) for x in extra)], names=["doc", "first", "last", "digit", "full", "again", "anchor"][: 6 + len(extra)])


def _runs(keyed: DataFrame) -> DataFrame:
    """All runs with their places, anchors and the digests of all their bytes."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, seen = batch.column("doc").to_numpy(), {}
            for rows, parts in _pieces(batch):
                blob, lengths = b"".join(parts), np.array([len(x) for x in parts])
                first, last, anchor, d1 = runs(np.frombuffer(blob, np.uint8), lengths)
                full = [digest(blob[a:b]) for a, b in zip(first.tolist(), (last + WINDOW).tolist(), strict=True)]
                begin = np.cumsum(lengths) - lengths
                part = np.searchsorted(begin, first, "right") - 1
                row, at = (np.array(x, np.int64)[part] for x in zip(*rows, strict=True))
                shift = at - begin[part]
                yield _ranges(ids[row], first + shift, last + shift, d1, full, seen, (anchor + shift,))

    return mapped(keyed, run, f"{RANGES}, anchor int")


def _blocks(texts: DataFrame) -> DataFrame:
    """The blocks of the runs in spans (first, last, anchor); digit: hash of what a block's windows share."""

    def run(batches):
        digest, short = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
        for batch in batches:
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans")), strict=True):
                found, seen = [], {}
                for x in spans:
                    first, last, anchor = x["first"], x["last"], x["anchor"]
                    for near in range(anchor - (anchor - last) // BLOCK * BLOCK, first - 1, -BLOCK):
                        found.append((max(first, near - BLOCK + 1), min(last, near), near))
                found.sort()  # what starts later in the document is the repeat
                for at in range(0, len(found), 50_000):
                    first, last, near = (np.array(x, np.int64) for x in zip(*found[at : at + 50_000], strict=True))
                    full = [digest(text[a:b]) for a, b in zip(first.tolist(), (last + WINDOW).tolist(), strict=True)]
                    digit = np.array([short(text[a : a + WINDOW - BLOCK + 1]) for a in near.tolist()], np.uint64).view(np.int64)
                    yield _ranges(np.full(len(first), doc), first, last, digit, full, seen)

    return mapped(texts, run, RANGES)


def _windows(texts: DataFrame) -> DataFrame:
    """The single windows of the ranges in spans (first, last)."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans")), strict=True):
                seen: dict[int, set] = {}
                start = np.unique(np.concatenate([np.arange(x["first"], x["last"] + 1) for x in spans]))
                for at in range(0, len(start), 50_000):
                    part = start[at : at + 50_000]
                    full = [digest(text[a : a + WINDOW]) for a in part.tolist()]
                    yield _ranges(np.full(len(part), doc), part, part, np.zeros(len(part), np.int64), full, seen)

    return mapped(texts, run, RANGES)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc, doc_id, text: a number for each different document, in their order, and its bytes;
    also a column repeated where several rows may have one number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    number = F.coalesce("doc_id", F.lit(NO_ID))
    if rows.groupBy(number.alias("doc")).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows.select(number.alias("doc"), "doc_id", "text")
    rows = rows.withColumns({"_n": number, "_t": F.xxhash64("text")})
    order = rows.select("_n", "_t").distinct().orderBy("_n", "_t").rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    ranks = written(docs.sparkSession.createDataFrame(order, "_n long, _t long, doc long"), "ranks")
    return rows.join(ranks, ["_n", "_t"]).select("doc", "doc_id", "text", F.lit(True).alias("repeated"))


def _passed(ranges: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    """Of ranges dealt by digit and digest: the byte spans that stand earlier too, and the
    first range of each digest where a digit has several digests."""
    fresh = ranges.filter("NOT again")
    firsts = [F.min_by(c, "doc").alias(c) for c in ("first", "last", *carried)]
    groups = written(fresh.groupBy("digit", "full").agg(F.min("doc").alias("head"), F.count("*").alias("n"), *firsts), "groups")
    heads = groups.filter("n > 1").select("digit", "full", "head")
    later = fresh.join(heads, ["digit", "full"]).filter("doc > head").unionByName(ranges.filter("again"), allowMissingColumns=True)
    mixed = groups.groupBy("digit").agg(F.count("*").alias("n")).filter("n > 1").select("digit")
    edges = groups.join(mixed, "digit", "left_semi").select(F.col("head").alias("doc"), "first", "last", *carried)
    return later.select("doc", F.col("first").alias("start"), (F.col("last") + WINDOW).alias("stop")), edges


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """doc, start, stop: byte ranges that cover all windows that also start earlier."""
    texts = keyed.select("doc", "text").dropDuplicates(["doc"]) if "repeated" in keyed.columns else keyed.select("doc", "text")

    def opened(edges: DataFrame) -> DataFrame:
        own = [c for c in edges.columns if c != "doc"]
        return texts.join(edges.groupBy("doc").agg(F.collect_list(F.struct(*own)).alias("spans")), "doc")

    twice = written(_grams(texts).groupBy("digit").agg(F.count("*").alias("n")).filter("n > 1").select("digit"), "grams")
    whole, edges = _passed(written(_runs(texts).join(twice, "digit", "left_semi"), "runs"), "anchor")
    parts, edges = _passed(written(_blocks(opened(edges)), "blocks"))
    single, _ = _passed(written(_windows(opened(edges)), "windows"))
    return whole.unionByName(parts).unionByName(single)


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of one document as maximal ones in order."""
    if not len(start):
        return start, stop
    order = np.argsort(start)
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = start[1:] > stop[:-1]
    return start[np.append(True, new)], stop[np.append(new, True)]


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, maximal and in order) and kept (the remaining bytes)."""
    keyed = keyed_texts(docs)
    spans = written(repeated_spans(keyed).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found, texts = part.column("spans"), part.column("text").to_pylist()
                ends = np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = found.flatten()
                start, stop = (flat.field(x).to_numpy() for x in ("start", "stop"))
                spans = [merged(start[a:b], stop[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                kept = []
                for text, (starts, stops) in zip(texts, spans, strict=True):
                    kept.append(b"".join(text[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(text)], strict=True)))
                sizes = [len(x) for x in texts]
                ends = np.cumsum([0, *(len(x) for x, _ in spans)])
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int32()) for x in zip(*spans, strict=True)], ["start", "stop"])
                removed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), removed, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return mapped(keyed.join(spans, "doc", "left"), run, "doc_id long, n_bytes long, spans array<struct<start: int, stop: int>>, kept binary")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return kept_texts(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
