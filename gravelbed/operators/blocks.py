"""Block planning, slicing, containers: expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelbed.functions.binary import le, put_le, running_sums

#: Fixed values of the block container: magic, header bytes, smallest and largest block.
MAGIC, HEADER, SMALLEST, LARGEST = 0x4C5A, 14, 64 << 10, 1 << 20


def thread_block_size(n: Column, threads: int) -> Column:
    """An even share for each thread within the limits, at most the input; the smallest for no input."""
    share = F.least(F.greatest(F.ceil(n / threads), F.lit(SMALLEST)), F.lit(LARGEST))
    return F.when(n == 0, SMALLEST).otherwise(F.least(share, n)).cast("long")


def device_block_size(n: Column, blocks: int, align: int, low: int | None = None, high: int | None = None) -> Column:
    """An even share of blocks blocks, aligned up and within limits."""
    size = F.ceil(F.ceil(n / blocks) / align) * align
    size = size if low is None else F.greatest(size, F.lit(low))
    return (size if high is None else F.least(size, F.lit(high))).cast("long")


def host_block_size(n: Column, units: int, blocks: int | None = None, align: int = 16 << 10, low: int = 64 << 10, high: int = 256 << 10) -> Column:
    """The host's rule in full: an even share of blocks blocks (128 for each unit), at least units blocks, and a
    last block under a quarter of the others shared out among them."""

    def even(count: Column) -> Column:
        return F.least(F.greatest(F.ceil(F.ceil(n / count) / align) * align, F.lit(low)), F.lit(high))

    size = even(F.greatest(F.least(F.lit(units * 128 if blocks is None else blocks), n), F.lit(1)))
    few = F.ceil(n / size) < units
    size, count = F.when(few, even(F.lit(units))).otherwise(size), F.when(few, F.lit(units)).otherwise(F.ceil(n / size))
    small = (count > 1) & (n - size * (count - 1) < F.floor(size / 4)) & (n >= size * (count - 1))
    return F.when(small, even(count)).otherwise(size).cast("long")


def daemon_block_size(n: Column, units: int, align: int = 64 << 10, low: int = 16 << 10, high: int = 128 << 10) -> Column:
    """The resident service's rule: an even share of 128 blocks for each unit, aligned up (so never under align) and within limits."""
    share = F.ceil(n / F.greatest(F.least(F.lit(units * 128), n), F.lit(1)))
    return F.least(F.greatest(F.ceil(share / align) * align, F.lit(max(align, low))), F.lit(high)).cast("long")


def block_count(n: Column, size: Column) -> Column:
    return F.when(n > 0, F.ceil(n / size)).otherwise(0).cast("long")


def expansion_bound(n: Column, divisor: int = 16, extra: int = 67) -> Column:
    """Most bytes that n bytes can become when encoded."""
    return n + F.floor(n / divisor).cast("long") + extra


def sliced(rows: DataFrame, value: str, size: Column | int) -> DataFrame:
    """One row for each block: the other columns, block_id, offset, block. Empty and null values have no block."""
    size = F.lit(size).cast("long") if isinstance(size, int) else size
    own = [F.col(f"`{c}`") for c in rows.columns if c != value]
    starts = F.when(F.octet_length(value) > 0, F.sequence(F.lit(0).cast("long"), F.octet_length(value).cast("long") - 1, size))
    out = rows.withColumn("_size", size).select(*own, "_size", value, F.posexplode(starts).alias("block_id", "offset"))
    return out.select(*own, "block_id", "offset", F.substring(F.col(value), (F.col("offset") + 1).cast("int"), F.col("_size").cast("int")).alias("block"))


def with_offsets(blocks: DataFrame, key: str, length: Column) -> DataFrame:
    """blocks with packed_offset: where each block's bytes begin when all are laid end to end."""
    before = Window.partitionBy(key).orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("packed_offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def containers(rows: DataFrame, blocks: DataFrame, key: str, original: Column, size: Column) -> DataFrame:
    """key and container (header, table of lengths, payloads in block order) for each row of rows (one for each key),
    with the blocks (key, block_id, payload) of that key; a row without blocks gets a container without any.

    Arrays of binary values have no join of their own, so payloads meet as hexadecimal digits: twice their size, one container at a time."""
    each = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_id", "payload"))).alias("_parts"))
    both = rows.select(key, original.alias("_n"), size.alias("_size")).join(each, key, "left").withColumn("_parts", F.coalesce("_parts", F.array()))
    table = F.array_join(F.transform("_parts", lambda p: F.hex(put_le(F.octet_length(p["payload"]), 4))), "")
    payloads = F.array_join(F.transform("_parts", lambda p: F.hex(p["payload"])), "")
    head = F.concat(put_le(F.lit(MAGIC), 2), put_le(F.col("_n"), 4), put_le(F.col("_size"), 4), put_le(F.size("_parts"), 4))
    return both.select(key, F.concat(head, F.unhex(F.concat(table, payloads))).alias("container"))


def parsed(rows: DataFrame, key: str, container: str = "container") -> DataFrame:
    """key, status, block_id, plain_bytes, payload of each container's blocks; one without blocks, or a bad one, is one row
    with null in the last three. A block's place is the running sum of the lengths before it."""
    c = F.col("_c")
    n, total = le(c, 10, 4), F.octet_length(c).cast("long")
    status = F.when(total < HEADER, "too small").when(le(c, 0, 2) != MAGIC, "bad magic").when(total < HEADER + 4 * n, "short length table").otherwise("ok")
    out = rows.select(key, F.col(container).alias("_c")).select(key, "_c", status.alias("status"))
    first = HEADER + 4 * le(F.col("_c"), 10, 4)
    table = F.when(F.col("status") == "ok", F.substring(c, F.lit(HEADER + 1), (first - HEADER).cast("int")))
    out = out.withColumn("_ends", running_sums(F.coalesce(table, F.lit(b""))))
    short = (F.col("status") == "ok") & (F.octet_length("_c") < first + F.coalesce(F.try_element_at("_ends", F.lit(-1)), F.lit(0)))
    out = out.withColumn("status", F.when(short, "short payload").otherwise(F.col("status")))
    ends = F.when(F.col("status") == "ok", F.col("_ends"))
    spans = F.transform(ends, lambda x, i: F.struct(F.when(i > 0, F.get("_ends", i - 1)).otherwise(0).alias("at"), x.alias("end")))
    out = out.select(key, "_c", "status", F.posexplode_outer(spans).alias("block_id", "_b"))
    plain = F.least(le(c, 6, 4), le(c, 2, 4) - F.col("block_id") * le(c, 6, 4))
    payload = F.substring(c, (first + F.col("_b.at") + 1).cast("int"), (F.col("_b.end") - F.col("_b.at")).cast("int"))
    there = F.col("_b").isNotNull()
    return out.select(key, "status", F.col("block_id").cast("long").alias("block_id"), F.when(there, plain).alias("plain_bytes"), F.when(there, payload).alias("payload"))
