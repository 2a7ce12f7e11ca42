"""Fixed-width integers in binary columns, and checksums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def le(value: Column, at: int | Column, width: int) -> Column:
    """The unsigned little-endian integer of width bytes at a place (from 0)."""
    at = F.lit(at) if isinstance(at, int) else at
    hexed = [F.hex(F.substring(value, at + (i + 1), F.lit(1))) for i in reversed(range(width))]
    return F.conv(F.concat(*hexed), 16, 10).cast("long")


def put_le(number: Column, width: int) -> Column:
    """A non-negative integer as width little-endian bytes."""
    digits = F.lpad(F.hex(number.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width)))))


def be(value: Column, at: int | Column, width: int) -> Column:
    """The unsigned big-endian integer of width bytes at a place (from 0)."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(value, at + 1, F.lit(width))), 16, 10).cast("long")


def put_be(number: Column, width: int) -> Column:
    """A non-negative integer as width big-endian bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * width, "0"))


def _adler(value: bytes | None, part: int = 1 << 20) -> int:
    low, high = 1, 0
    for at in range(0, len(value or b""), part):
        x = np.frombuffer(value[at : at + part], np.uint8).astype(np.int64)
        high = (high + len(x) * low + int((np.arange(len(x), 0, -1) * x).sum())) % 65521
        low = (low + int(x.sum())) % 65521
    return high << 16 | low


@F.pandas_udf(LongType())
def adler32(values: pd.Series) -> pd.Series:
    """Adler-32 by weighted sums over parts of a value; null counts as no bytes and gives 1."""
    return values.map(_adler)


def crc32(value: Column) -> Column:
    """CRC-32; null counts as no bytes and gives 0."""
    return F.crc32(F.coalesce(value, F.lit(b"")))


@F.pandas_udf(LongType())
def first_mismatch(a: pd.Series, b: pd.Series) -> pd.Series:
    """Where two binary values first differ (from 0), the shorter length if one begins the other; null if they are equal."""

    def place(x: bytes | None, y: bytes | None):
        x, y = (np.frombuffer(v or b"", np.uint8) for v in (x, y))
        n = min(len(x), len(y))
        off = np.flatnonzero(x[:n] != y[:n])
        return int(off[0]) if len(off) else n if len(x) != len(y) else None

    return pd.Series([place(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(ArrayType(LongType()))
def byte_counts(values: pd.Series) -> pd.Series:
    """How often each of the 256 bytes comes in a value; null counts as no bytes."""
    return values.map(lambda x: np.bincount(np.frombuffer(x or b"", np.uint8), minlength=256))


@F.pandas_udf(ArrayType(LongType()))
def running_sums(tables: pd.Series) -> pd.Series:
    """Sums up to each of the unsigned little-endian 32-bit integers that a binary value holds."""
    return tables.map(lambda x: np.cumsum(np.frombuffer(x, "<u4").astype(np.int64)))
