"""The 1X block dialect: a greedy encoder and a checked decoder, as Arrow-batched column functions."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

#: Fixed values of the dialect: end mark, and the largest distances of its match forms.
END, NEAR, MIDDLE, FAR = b"\x11\x00\x00", 0x800, 0x4000, 0xBFFF
#: Statuses of a decoded block.
OK, INPUT_OVERRUN, OUTPUT_OVERRUN, LOOK_BEHIND, NOT_CONSUMED = 0, -4, -5, -6, -8
#: Bytes of a batch that a worker gets, and rows of it computed at once.
BATCH_BYTES, PIECE = 4 << 20, 64


class Fault(Exception):
    """A stream that breaks a rule; its argument is the status."""


def _long(value: int, field: int) -> bytes:
    """The bytes that carry on a length beyond its field."""
    full, rest = divmod(value - field - 1, 255)
    return b"\x00" * full + bytes([rest + 1])


def encode(data: bytes, bits: int = 14) -> bytes:
    """data as a 1X stream; matches are found by the last place of each four bytes (2^bits of them)."""
    out, table, at, start, size = bytearray(), {}, 0, 0, len(data)

    def literals(stop: int) -> None:
        n = stop - start
        if not n:
            return
        if not out and n <= 238:
            out.append(17 + n)
        elif n <= 3:
            out[-2] |= n
        elif n <= 18:
            out.append(n - 3)
        else:
            out.append(0)
            out.extend(_long(n - 3, 15))
        out.extend(data[start:stop])

    while at + 4 < size and size > 20:
        key = (int.from_bytes(data[at : at + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)
        seen, table[key] = table.get(key, -1), at
        away = at - seen
        if seen < 0 or away > FAR or data[seen : seen + 4] != data[at : at + 4]:
            at += 1 + (at - start >> 5)
            continue
        literals(at)
        stop = at + 4
        while stop < size and data[stop] == data[stop - away]:
            stop += 1
        n = stop - at
        if n <= 8 and away <= NEAR:
            out += bytes([(n - 1 << 5) | ((away - 1 & 7) << 2), away - 1 >> 3])
        elif away <= MIDDLE:
            out += bytes([32 | n - 2]) if n <= 33 else b"\x20" + _long(n - 2, 31)
            out += bytes([(away - 1 & 63) << 2, away - 1 >> 6])
        else:
            high, low = (away - MIDDLE) >> 14 << 3, away - MIDDLE & 0x3FFF
            out += bytes([16 | high | n - 2]) if n <= 9 else bytes([16 | high]) + _long(n - 2, 7)
            out += bytes([(low & 63) << 2, low >> 6])
        at = start = stop
    literals(size)
    return bytes(out + END)


def decode(data: bytes, limit: int | None = None) -> tuple[int, bytes]:
    """Status and decoded bytes; limit: the most bytes that may come out."""
    out, at = bytearray(), 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise Fault(INPUT_OVERRUN)
        at += n
        return data[at - n : at]

    def length(field: int, most: int) -> int:
        if field:
            return field
        n = most
        while (b := take(1)[0]) == 0:
            n += 255
        return n + b

    def put(piece: bytes) -> None:
        if limit is not None and len(out) + len(piece) > limit:
            raise Fault(OUTPUT_OVERRUN)
        out.extend(piece)

    def copy(away: int, n: int) -> None:
        if away > len(out):
            raise Fault(LOOK_BEHIND)
        unit = bytes(out[len(out) - away : len(out) - away + min(n, away)])
        put((unit * (n // len(unit) + 1))[:n])

    try:
        state = 0  # trailing literals of the token before; 4: a long run of literals
        if data[:1] and data[0] > 17:
            n = take(1)[0] - 17
            put(take(n))
            state = min(n, 4)
        while True:
            t = take(1)[0]
            if t >= 64:
                low, b = t, take(1)[0]
                copy(1 + (t >> 2 & 7) + (b << 3), (t >> 5) + 1)
            elif t >= 16:
                n = (length(t & 31, 31) if t >= 32 else length(t & 7, 7)) + 2
                low, high = take(2)
                away = (low >> 2) + (high << 6) + (1 if t >= 32 else (t & 8) << 11)
                if t < 32:
                    if away == 0:
                        return (OK if at == len(data) else NOT_CONSUMED), bytes(out)
                    away += MIDDLE
                copy(away, n)
            elif state == 0:
                put(take(length(t, 15) + 3))
                state = 4
                continue
            else:
                low, b = t, take(1)[0]
                copy((NEAR if state == 4 else 0) + 1 + (t >> 2) + (b << 2), 3 if state == 4 else 2)
            state = low & 3
            if state:
                put(take(state))
    except Fault as fault:
        return fault.args[0], bytes(out)


@F.pandas_udf(BinaryType())
def encoded(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else encode(x))


@F.pandas_udf(StructType([StructField("status", IntegerType()), StructField("plain", BinaryType())]))
def decoded(values: pd.Series, limits: pd.Series) -> pd.DataFrame:
    """Status and bytes of each stream, limits being the sizes that the blocks should have."""
    return pd.DataFrame([(None, None) if x is None else decode(x, int(n)) for x, n in zip(values, limits, strict=True)], columns=["status", "plain"])


def round_trips(rows: DataFrame) -> DataFrame:
    """doc_id, n (bytes of the value), n_packed, and whether the stream decodes to the value again, of rows (doc_id, value, n).

    Both ways in one worker, PIECE rows of a batch of bounded bytes at a time: what is held does not grow with the rows."""
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("n_packed", pa.int64()), ("same", pa.bool_())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part, sizes, same = batch.slice(at, PIECE), [], []
                for value in part.column("value").to_pylist():
                    packed = None if value is None else encode(value)
                    sizes.append(None if packed is None else len(packed))
                    same.append(None if packed is None else decode(packed, len(value)) == (OK, value))
                yield pa.record_batch([part.column("doc_id"), part.column("n"), pa.array(sizes, pa.int64()), pa.array(same)], schema=kind)

    # Spark reads the bound when the plan runs, so the session keeps it; it holds for Arrow batches alone
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "value", "n").mapInArrow(run, "doc_id long, n long, n_packed long, same boolean")
