"""SimHash near-dedup with Golay-code fuzzy keys.

The binary Golay code of length 23 is perfect: every 23-bit word lies within 3 bits of one
codeword. A word at 3 bits from its codeword lies at 4 bits from five more. Keyed by its
codeword, or by all six where the distance is 3, two words that differ in 2 bits or fewer
always share a key; a random pair shares one in 0.7 per cent of cases. Each fingerprint
segment of up to 23 bits therefore decodes to one or six 12-bit codeword indices.

Two searches use these keys:

* linked(): all links of 64-bit fingerprints at a small number of bits (op1). Three segments
  and at most two errors leave one segment without an error (pigeonhole) and the next with
  at most two, so the key is (exact segment, codeword index of the next), for each of the
  three in turn. Buckets are verified in full; a bucket over BUCKET rows goes through shared
  neighbours instead (a middle point one bit away), whose groups hold 65 fingerprints at most.
* near_duplicates(): documents whose word shingles have a Jaccard similarity of at least a
  threshold, all of them. The Golay keys come first: sets with fingerprints at two bits or fewer are
  paired by linked(), verified on the sets and contracted, so a group of thousands of close copies
  costs few pairs. They cannot find all pairs: at a similarity of 0.8 two fingerprints of 64 bits differ in
  about ten. What they leave apart meets in an exact search: two sets of a and b shingles that reach
  the threshold share at least threshold * max(a, b), so under any common order of the shingles their first
  a - threshold * a + 1 and b - threshold * b + 1 ones have one in common (prefix filter). The order
  is by hash, with shingles that a sample shows to be common last; it decides only the cost.
  Pairs in a bucket are left out only if their sizes, the places of the key or a 512-bit parity
  sketch prove them to be below the threshold; the others are verified on the sets. A round that
  compares each member of a bucket with one other contracts what it links; the last round compares
  all pairs that are not in one component yet.

Nulls and texts without words have fingerprint zero and link like any other. Rows with equal
fingerprints are folded before any search, so copies cost one row. Rows with a null doc_id
take part; a component's id is the smallest id in it, or null if it has none.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, mapped, written
from .components import components

SEED = 42
#: Fingerprints in a bucket up to which all its pairs are compared.
BUCKET = 64
#: Bits of the three segments of a 64-bit fingerprint.
SEGMENTS = (22, 21, 21)
#: near_duplicates(): bits of a parity sketch, rounds of stars before all pairs, rows of a bucket that one group holds.
BITS, STARS, PART = 512, 1, 4096
#: Nodes to be verified up to which their keys (16 bytes each) are broadcast; beyond it texts meet them by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows of a bucket that all others are compared with in a round of stars.
HUBS = 8
#: Sampled documents for the order of shingles (one in 16 at most), how many must hold a common one, and the longest list.
SAMPLE, COMMON, LISTED = 65_536, 4, 50_000

#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


class Golay:
    """Decoder tables: parity of each 12-bit message, and the error patterns of each syndrome."""

    def __init__(self):
        self.parity = np.arange(4096, dtype=np.uint32) << np.uint32(11)
        for bit in range(22, 10, -1):
            on = (self.parity >> np.uint32(bit) & np.uint32(1)).astype(bool)
            self.parity[on] ^= np.uint32(GENERATOR << (bit - 11))
        self.errors = np.zeros((2048, 6), np.uint32)
        self.n = np.zeros(2048, np.int64)
        for weight in range(5):
            words = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(23), weight)], np.uint32)
            for word, s in zip(words, self.syndrome(words), strict=True):
                if weight < 4 or self.errors[s, 0].item().bit_count() == 3:
                    self.errors[s, self.n[s]] = word
                    self.n[s] += 1

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.parity[words >> np.uint32(11)] ^ (words & np.uint32(2047))

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword indices (n x 6) of 23-bit words, and how many of the six are set."""
        s = self.syndrome(words)
        return ((words[:, None] ^ self.errors[s]) >> np.uint32(11)).astype(np.int64), self.n[s]


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of width words, repeats included; of all words if they are fewer."""
    words = text.lower().split()
    if not words:
        return []
    runs = zip(*(words[k:] for k in range(width)), strict=False) if len(words) >= width else [words]
    return [xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, runs)]


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_MIX = np.cumprod(np.full(32, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def fingerprint(hashes: list, width: int = 1) -> np.ndarray:
    """For each list of shingle hashes, width x 64 bits: 1 where over half the hashes have a 1.
    Beyond the first 64, bits come from products of the hash with odd constants."""
    lengths = np.array([len(x) for x in hashes], np.int64)
    flat = np.concatenate([np.asarray(x, np.uint64) for x in hashes]) if len(hashes) else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(hashes), dtype=np.int64) << 8, lengths)
    out = np.zeros((len(hashes), width), np.uint64)
    for w in range(width):
        h = flat if w == 0 else flat * _MIX[w]
        h = h if w == 0 else h ^ (h >> np.uint64(31))
        bits = np.empty((len(hashes), 64), np.uint8)
        for byte, column in enumerate(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8).T):
            counts = np.bincount(row + column, minlength=len(hashes) << 8).reshape(-1, 256) @ _BITS
            bits[:, 8 * byte : 8 * byte + 8] = counts * 2 > lengths[:, None]
        out[:, w] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _blocks(batch: pa.RecordBatch, rows: int = 256):
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column("doc_id"), [x or b"" for x in part.column("text").to_pylist()]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp: the 64-bit fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for ids, texts in _blocks(batch):
                fp = fingerprint([shingle_hashes(t, words) for t in texts])[:, 0].view(np.int64)
                yield pa.record_batch([ids, pa.array(fp)], names=["doc_id", "fp"])

    return mapped(_texts(docs), run, "doc_id long, fp long")


def segment_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of 64-bit fingerprints: (row numbers, keys)."""
    parts, at = [], 0
    for bits in SEGMENTS:
        parts.append((fp >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.uint32))
        at += bits
    rows, keys = [], []
    for k, exact in enumerate(parts):
        near, n = golay().keys(parts[(k + 1) % len(parts)])
        there = np.arange(6) < n[:, None]
        full = (np.int64(k) << 40) | (exact.astype(np.int64)[:, None] << 12) | near
        rows.append(np.nonzero(there)[0])
        keys.append(full[there])
    return np.concatenate(rows), np.concatenate(keys)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def linked(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Links (u, v), u < v, among distinct fingerprints (column fp) at bits or fewer differing bits.

    Buckets up to BUCKET members give their verified pairs. Members of larger ones are linked
    through each middle point to the smallest fingerprint around it: as many links as there are
    such fingerprints times 65 at most, with the same components as all pairs."""
    if bits > 2:
        raise ValueError("the keys are complete up to two bits")

    def keyed(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            rows, keys = segment_keys(fp.view(np.uint64))
            yield pa.record_batch([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])

    def pairs(batches):
        for batch in batches:
            found = [np.empty((0, 2), np.int64)]
            for members in batch.column("fps").to_pylist():
                fp = np.sort(np.array(members, np.int64))
                i, j = np.triu_indices(len(fp), 1)
                near = _popcount((fp[i] ^ fp[j]).view(np.uint64)) <= bits
                found.append(np.stack([fp[i][near], fp[j][near]], axis=1))
            both = np.concatenate(found)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    rows = written(distinct.select("fp").mapInArrow(keyed, "key long, fp long"), "keys")
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
    twos = buckets.filter("n = 2").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits).select("u", "v")
    more = written(buckets.filter("n > 2").select("key", "n"), "buckets")
    small = rows.join(more.filter(F.col("n") <= BUCKET), "key").groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(pairs, "u long, v long")
    large = rows.join(more.filter(F.col("n") > BUCKET), "key").select("fp").distinct()
    # at two bits, both sides lie within one bit of a middle point
    points = large.select("fp", F.explode(F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))).alias("flip"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1")
    around = points.join(hubs, "point").filter("u < fp").select("u", F.col("fp").alias("v"))
    around = around.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    return twos.unionByName(small).unionByName(around).distinct()


def grouped(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of bits or fewer)."""
    rows = written(fingerprints(docs, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = components(linked(distinct, bits))
    named = parts.join(distinct, parts["node"] == distinct["fp"]).select("node", "component", "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = distinct.join(named.join(least, "component").select(F.col("node").alias("fp"), "component_id"), "fp", "left")
    labels = labels.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(labels, "fp")


def _set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: with its own key, a row needs no id of its own."""
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _common(rows: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles that occur in many documents of a sample."""

    def run(batches):
        for batch in batches:
            for _, texts in _blocks(batch):
                yield pa.record_batch([pa.array(np.concatenate([_set(t, words) for t in texts]).view(np.int64))], names=["key"])

    share = max(16, rows.count() // SAMPLE)
    counts = mapped(rows.filter(F.pmod("text_key", F.lit(share)) == 0).dropDuplicates(["text_key"]).select("doc_id", "text"), run, "key long").groupBy("key").count()
    most = counts.filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(LISTED).select("key").collect()
    return np.sort(np.array([r["key"] for r in most], np.int64).view(np.uint64))


def _parity(h: np.ndarray, bits: int) -> bytes:
    """Parity of the number of hashes that fall on each of bits places, a power of two."""
    counts = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """How many members at least two sets do not share, by their sketches; the longer is folded to the shorter."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _prefixed(rows: DataFrame, words: int, threshold: float, common: np.ndarray) -> DataFrame:
    """doc_id, text_key of the texts that have words; node: a hash of the set of shingles; its size, fingerprint, parity
    sketches and prefix. A set of over BITS shingles has a sketch of about a bit for each besides the one of BITS bits."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                sets = [_set(x or b"", words) for x in part.column("text").to_pylist()]
                for h, fp in zip(sets, fingerprint(sets)[:, 0].view(np.int64).tolist(), strict=True):
                    if not len(h):
                        out.append((None, 0, 0, b"", None, []))
                        continue
                    late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)
                    first = np.concatenate([h[~late], h[late]])[: len(h) - math.ceil(threshold * len(h) - 1e-9) + 1]
                    wide = _parity(h, 1 << (len(h) - 1).bit_length()) if len(h) > BITS else None
                    out.append((xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63), len(h), fp, _parity(h, BITS), wide, first.view(np.int64)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)]
                names = ["doc_id", "text_key", "node", "size", "fp", "sketch", "wide", "prefix"]
                yield pa.record_batch([part.column("doc_id"), part.column("text_key"), *columns], names=names).filter(columns[0].is_valid())

    return mapped(rows, run, "doc_id long, text_key long, node long, size long, fp long, sketch binary, wide binary, prefix array<long>")


def _offered(rows: DataFrame, threshold: float, stars: int | None) -> DataFrame:
    """u, v (u < v) in one bucket and two components that may reach the threshold: of the bucket's
    first HUBS nodes in an order by stars with the others, or, if stars is None, of all pairs.

    rows: key, node, component, size, place, sketch, n (rows of the key). A bucket over PART rows is dealt to
    groups, for stars by parts and for all pairs by each two parts."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(SEED)), parts).cast("int")
    if stars is None:
        both = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least(x, mine).alias("low"), F.greatest(x, mine).alias("high")))
        rows = rows.select("*", F.explode(both).alias("part"), mine.alias("mine")).withColumn("turn", F.col("node"))
    else:
        rows = rows.withColumns({"part": F.struct(mine.alias("low"), mine.alias("high")), "mine": mine, "turn": F.xxhash64("node", F.lit(stars))})
    rows = rows.select("key", F.col("part.low").alias("low"), F.col("part.high").alias("high"), "turn", "mine", "node", "component", "size", "place", "sketch")

    def compared(t: pa.Table, start: np.ndarray, length: np.ndarray):
        column = {c: t.column(c).to_numpy() for c in ("low", "high", "mine", "node", "component", "size", "place")}
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        node, component, size, place, mine = (column[c] for c in ("node", "component", "size", "place", "mine"))
        apart = column["low"] != column["high"]
        first, left = np.repeat(start, length), np.repeat(start + length, length) - np.arange(t.num_rows)
        for step in range(1, int(length.max(initial=1)) if stars is None else HUBS + 1):
            if stars is None:
                i = np.flatnonzero(left > step)
                j = i + step
                i, j = (x[~apart[i] | (mine[i] != mine[j])] for x in (i, j))
            else:
                i = first + step - 1
                j = np.flatnonzero(np.arange(t.num_rows) > i)
                i = i[j]
            i, j = (x[component[i] != component[j]] for x in (i, j))
            total, least = size[i] + size[j], threshold / (1 + threshold) * (size[i] + size[j]) - 1e-6
            # of two sets that reach it, the first common key leaves enough behind it in both
            may = (np.minimum(size[i], size[j]) >= least) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= least) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-6)
            i, j, most = i[may], j[may], (total - 2 * least)[may]
            may = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= most
            i, j = i[may], j[may]
            if len(i):
                yield np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])])

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            t = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if t is None or not t.num_rows:
                continue
            group = np.stack([t.column(c).to_numpy() for c in ("key", "low", "high")])
            start = np.concatenate([[0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1])
            whole = t.num_rows if batch is None else int(start[-1])
            held, start = t.slice(whole), start[start < whole]
            length = np.diff(np.append(start, whole))
            found = [*compared(t.slice(0, whole), start, length)] if whole else []
            if found:
                u, v = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "turn")
    return mapped(dealt, run, "u long, v long").distinct()


def _screened(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """pairs without those of two large sets that the long sketches prove to be below the threshold."""

    def run(batches):
        for batch in batches:
            most = (1 - 2 * threshold / (1 + threshold)) * (batch.column("size_u").to_numpy() + batch.column("size_v").to_numpy()) + 1e-6
            apart = [_apart(a, b) for a, b in zip(batch.column("wide_u").to_pylist(), batch.column("wide_v").to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(np.array(apart) <= most))

    large = nodes.filter("wide IS NOT NULL")
    for side in ("u", "v"):
        pairs = pairs.join(large.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("wide").alias(f"wide_{side}")), side, "left")
    pairs = written(pairs, "sketched")
    both = F.col("wide_u").isNotNull() & F.col("wide_v").isNotNull()
    return pairs.filter(~both).select("u", "v").unionByName(mapped(pairs.filter(both), run, "u long, v long"))


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs whose sets of shingles have at least the threshold's Jaccard similarity."""

    def run(batches):
        for batch in batches:
            for ids, texts in _blocks(batch, 64):
                sets = [_set(t, words).view(np.int64) for t in texts]
                yield pa.record_batch([ids, pa.array(sets, pa.list_(pa.int64()))], names=["id", "runs"])

    pairs = written(_screened(pairs, nodes, threshold), "screened")
    named = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    one = written(nodes.select("node", "text_key").join(named, "node", "left_semi"), "one")
    few = F.broadcast(one) if one.count() <= BROADCAST_ROWS else one
    held = texts.select("text_key", "text").join(few, "text_key").dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), "text")
    sets = written(mapped(held, run, "id long, runs array<long>"), "sets")
    a, b = (sets.select(F.col("id").alias(x), F.col("runs").alias(y)) for x, y in (("u", "a"), ("v", "b")))
    both = F.size(F.array_intersect("a", "b"))
    out = written(pairs.join(a, "u").join(b, "v").filter(both >= threshold * (F.size("a") + F.size("b") - both)).select("u", "v"), "links")
    for done in (pairs, one, sets):
        forget(done)
    return out


def _buckets(nodes: DataFrame) -> DataFrame:
    """key, node, size, place, sketch, n of the prefix keys that several nodes share."""
    each = nodes.select("node", "size", F.posexplode("prefix").alias("place", "key")).withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    each = written(each.select("key", "node", "size", F.col("place").cast("long").alias("place"), "n"), "shared")
    out = written(each.join(nodes.select("node", "sketch"), "node"), "buckets")
    forget(each)
    return out


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """u, v (u < v) of nodes whose fingerprints are at two bits or fewer, by the Golay keys; nodes of one
    fingerprint meet its smallest node, which stands for it."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.max("node").alias("other")), "prints")
    hub = prints.filter("hub < other").select("fp", "hub")
    same = nodes.select("node", "fp").join(hub, "fp").filter("hub < node").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    links = linked(prints)
    for side in ("u", "v"):
        links = links.join(prints.select(F.col("fp").alias(side), F.col("hub").alias(f"{side}_hub")), side).drop(side)
    return same.unionByName(links.select(F.least("u_hub", "v_hub").alias("u"), F.greatest("u_hub", "v_hub").alias("v")))


def _joined(nodes: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """node, component of the nodes (sets of shingles) that link to another one."""
    links = parts = buckets = None
    for step in ["fingerprints", *range(STARS), None]:
        if step == "fingerprints":
            offered = _fingerprint_pairs(nodes)
        else:
            buckets = _buckets(nodes) if buckets is None else buckets
            now = buckets.withColumn("component", F.col("node")) if parts is None else buckets.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
            offered = _offered(now, threshold, step)
        pairs = written(offered, "pairs")
        if pairs.isEmpty():
            continue
        more = _verified(pairs, texts, nodes, words, threshold)
        forget(pairs)
        if parts is not None and more.isEmpty():
            continue
        links = more if links is None else links.unionByName(more)
        parts = written(components(links), "parts")
    forget(buckets)
    return parts if parts is not None else nodes.select("node", F.col("node").alias("component")).limit(0)


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, component_id (the smallest id of its group), text_key, kept of the documents that have a near-duplicate.

    Links are pairs whose sets of shingles of words words have a Jaccard similarity of threshold or
    more; a text of fewer words has one shingle, one without words none and no links. A document is
    (doc_id, text_key): rows equal in both are one, rows of one id with other texts are several, and
    rows without an id come after all others. Of a group the first one is kept."""
    texts = _keyed(docs)
    prefixed = written(_prefixed(texts, words, threshold, _common(texts, words)), "prefixed")
    rows = written(prefixed.select("doc_id", "text_key", "node"), "rows")
    nodes = written(prefixed.groupBy("node").agg(*(F.first(c).alias(c) for c in ("text_key", "size", "fp", "sketch", "wide", "prefix"))), "nodes")
    forget(prefixed)
    parts = _joined(nodes, texts, words, threshold)
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    each = rows.groupBy("node").agg(F.min(one).alias("least"), F.max(one).alias("last")).join(parts, "node", "left")
    each = written(each.withColumn("component", F.coalesce("component", "node")), "nodes")
    groups = each.groupBy("component").agg(F.min("least").alias("least"), F.max("last").alias("last")).filter("least <> last")
    named = each.drop("least", "last").join(groups.select("component", "least"), "component").select("node", "least")
    found = rows.select("node", "doc_id", "text_key").distinct().join(named, "node")
    return found.select("doc_id", F.col("least.doc_id").alias("component_id"), "text_key", (one == F.col("least")).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the near-duplicates of a document with a smaller id; all columns stay."""
    gone = near_duplicates(docs, words, threshold).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_text"))
    # columns of the two sides are named by their frames, so docs may have any names
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"].cast("binary")) == gone["_text"])
    return docs.join(gone, same, "left_anti")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return grouped(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
