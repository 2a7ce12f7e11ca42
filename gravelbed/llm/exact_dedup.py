"""Exact dedup: a cuckoo-filter index of live content digests, bucketed by digest.

Digests (SHA-256 of the text with A-Z lower-cased, UTF-8) are computed once and kept as
a narrow table; texts are never shuffled. Each Arrow batch first folds its own repeats
into (digest, largest id, count), so a text that a third of all rows share reaches the
index as one row a batch. Rows are then dealt by digest, and each bucket's index merges
them: a filter miss inserts a new live digest; a hit is verified against the stored key
(whole digest and byte length) before it counts as a repeat; a full filter is rebuilt at
twice the size from the stored keys.

Nulls: a null text is empty. A row with a null doc_id counts in group_size and yields to
any row with an id; where no row of a group has an id, all stay, since nothing tells them
apart. Repeated rows with the same id and text stay or go together. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, shuffle_partitions, written

DIGESTS = "doc_id long, digest binary, n_bytes long"
ENTRIES = "digest binary, n_bytes long, keep_id long, group_size long"
CHANGED = f"{ENTRIES}, stale boolean"
#: Digests that one bucket of the index holds; sets the number of buckets by the input's size.
BUCKET_KEYS = 2_000_000


class CuckooIndex:
    """Partial-key cuckoo filter of 16-bit tags, four to a bucket, beside the keys it stands for."""

    WAYS, KICKS = 4, 400

    def __init__(self, buckets: int = 1024):
        self._clear(1 << max(1, (buckets - 1).bit_length()))

    def _clear(self, buckets: int) -> None:
        self.mask, self.n = buckets - 1, 0
        self.tags: list[list[int]] = [[] for _ in range(buckets)]
        self.keys: list[list[list]] = [[] for _ in range(buckets)]

    @staticmethod
    def _tag(digest: bytes) -> int:
        return 1 + int.from_bytes(digest[:2], "big") % 65535

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[-8:], "big") & self.mask

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ (tag * 0x9E3779B1 >> 7 & self.mask)

    def find(self, digest: bytes, n_bytes: int) -> list | None:
        """The live entry with this key: the filter's tags first, then the stored keys of those that match."""
        tag, at = self._tag(digest), self._home(digest)
        for bucket in (at, self._other(at, tag)):
            if tag in self.tags[bucket]:
                for t, entry in zip(self.tags[bucket], self.keys[bucket], strict=True):
                    if t == tag and entry[0] == digest and entry[1] == n_bytes:
                        return entry
        return None

    def insert(self, entry: list) -> None:
        """Adds an entry [digest, n_bytes, ...] that find() does not know."""
        self.n += 1
        if self.n > 0.95 * self.WAYS * len(self.tags):
            self._resize(entry)
            return
        tag, at = self._tag(entry[0]), self._home(entry[0])
        for kick in range(self.KICKS):
            for bucket in (at, self._other(at, tag)):
                if len(self.tags[bucket]) < self.WAYS:
                    self.tags[bucket].append(tag)
                    self.keys[bucket].append(entry)
                    return
            way = kick % self.WAYS
            self.tags[at][way], tag = tag, self.tags[at][way]
            self.keys[at][way], entry = entry, self.keys[at][way]
            at = self._other(at, tag)
        self._resize(entry)

    def _resize(self, entry: list) -> None:
        held = [*self.entries(), entry]
        self._clear(2 * len(self.tags))
        for x in held:
            self.insert(x)

    def delete(self, digest: bytes, n_bytes: int) -> bool:
        """Takes a live digest out of the filter and the store."""
        tag, at = self._tag(digest), self._home(digest)
        for bucket in (at, self._other(at, tag)):
            for way, entry in enumerate(self.keys[bucket]):
                if self.tags[bucket][way] == tag and entry[0] == digest and entry[1] == n_bytes:
                    del self.tags[bucket][way], self.keys[bucket][way]
                    self.n -= 1
                    return True
        return False

    def entries(self) -> Iterator[list]:
        for bucket in self.keys:
            yield from bucket


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 and byte length of each whole text, A-Z lower-cased."""

    def digest(batches):
        for batch in batches:
            texts = [x.lower() if x else b"" for x in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), pa.array([len(x) for x in texts], pa.int64())],
                names=["doc_id", "digest", "n_bytes"],
            )

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), digest, DIGESTS)


def _folded(rows: DataFrame) -> DataFrame:
    """Each batch's repeats as one row: digest, n_bytes, largest id, count."""

    def fold(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(["digest", "n_bytes"]).aggregate([("doc_id", "max"), ([], "count_all")])
            t = t.select(["digest", "n_bytes", "doc_id_max", "count_all"]).rename_columns(["digest", "n_bytes", "keep_id", "group_size"])
            yield from t.to_batches()

    return mapped(rows.select("doc_id", "digest", "n_bytes"), fold, ENTRIES)


def _merge(batches):
    """One bucket of the index: rows (digest, n_bytes, keep_id, group_size, sign) in any order of ids,
    deletions (sign -1) after insertions."""
    index, gone, late = CuckooIndex(), 0, []

    def delete(digest, n_bytes, top, count):
        nonlocal gone
        entry = index.find(digest, n_bytes)
        if entry is None:
            return
        entry[3] -= count
        if entry[3] <= 0:
            gone += index.delete(digest, n_bytes)
        elif top is not None and entry[2] is not None and top >= entry[2]:
            entry[4] = True

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("digest", "n_bytes", "keep_id", "group_size", "sign")), strict=True):
            digest, n_bytes, top, count, sign = row
            if sign < 0:
                late.append(row[:4])
            elif (entry := index.find(digest, n_bytes)) is None:
                index.insert([digest, n_bytes, top, count, False])
            else:
                entry[2] = top if entry[2] is None or (top is not None and top > entry[2]) else entry[2]
                entry[3] += count
    for row in late:
        delete(*row)
    out, names = [], ["digest", "n_bytes", "keep_id", "group_size", "stale"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    for entry in index.entries():
        out.append(entry)
        if len(out) == 10_000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def apply(index: DataFrame | None, inserted: DataFrame | None = None, deleted: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """The index after insertions and deletions given as digest rows (doc_id, digest, n_bytes).

    Returns digest, n_bytes, keep_id, group_size, stale; stale: rows remain, but the one
    with the largest id may have been deleted, so keep_id is to be taken anew with refreshed().
    A digest of which no row is left is gone. Deletions must be of rows that were inserted."""
    parts = [] if index is None else [index.select("digest", "n_bytes", "keep_id", "group_size", F.lit(1).alias("sign"))]
    parts += [] if inserted is None else [_folded(inserted).withColumn("sign", F.lit(1))]
    parts += [] if deleted is None else [_folded(deleted).withColumn("sign", F.lit(-1))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return mapped(rows.repartition(buckets or shuffle_partitions(rows.sparkSession), "digest"), _merge, CHANGED)


def refreshed(index: DataFrame, live: DataFrame) -> DataFrame:
    """The index with stale keep_ids taken anew from the live digest rows."""
    stale = index.filter("stale").select("digest", "n_bytes")
    top = live.join(stale, ["digest", "n_bytes"], "left_semi").groupBy("digest", "n_bytes").agg(F.max("doc_id").alias("top"))
    out = index.join(top, ["digest", "n_bytes"], "left")
    return out.select("digest", "n_bytes", F.when(F.col("stale"), F.col("top")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size", F.lit(False).alias("stale"))


def membership(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs), "digests")
    buckets = max(shuffle_partitions(docs.sparkSession), -(-rows.count() // BUCKET_KEYS))
    index = apply(None, inserted=rows, buckets=buckets).select("digest", "n_bytes", "keep_id", "group_size")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.join(index, ["digest", "n_bytes"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each text, of its largest id; all columns stay.

    Rows are told apart by id and text. Of several with the largest id (or all without one), the first by a
    hash of all columns stays."""
    each = written(membership(docs), "membership")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    gone = each.filter(~F.coalesce("kept", F.lit(False))).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256)
    # a row travels as one value, so its columns may have any names
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), sha.alias("sha"))
    rows = rows.join(gone, rows["id"].eqNullSafe(gone["_gone"]) & (rows["sha"] == gone["_sha"]), "left_anti")
    several = written(each.filter("kept").groupBy(F.col("text_sha256").alias("sha")).count().filter("count > 1").select("sha"), "several")
    if not several.isEmpty():
        first = rows.join(several, "sha", "left_semi").groupBy("sha").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        rows = rows.join(several, "sha", "left_anti").select("row").unionByName(first.select("row"))
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return membership(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT doc_id, x, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g"""
