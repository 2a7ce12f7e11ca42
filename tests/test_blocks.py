"""Codec, containers, checksums."""

import random
import zlib

from pyspark.sql import functions as F

from gravelbed.functions import binary
from gravelbed.operators import blocks, codec
from gravelbed.plans import catalogue


def test_vectors_and_round_trips():
    assert codec.encode(b"") == bytes.fromhex("110000") and codec.encode(b"A") == bytes.fromhex("1241110000")
    assert codec.encode(b"ABCD") == bytes.fromhex("1541424344110000") and codec.encode(b"A" * 20) == b"\x25" + b"A" * 20 + b"\x11\0\0"
    draw = random.Random(1)
    for n in (0, 1, 3, 4, 21, 300, 5000, 70_000, 200_000):
        for data in (bytes(n), draw.randbytes(n), b"".join(draw.choice([b"alpha ", b"beta ", b"\0\0", b"gamma!"]) for _ in range(n // 4))):
            packed = codec.encode(data)
            assert codec.decode(packed, len(data)) == (0, data) and len(packed) <= len(data) + len(data) // 16 + 67


def test_faults():
    packed = codec.encode(b"hello hello hello hello hello hello")
    assert codec.decode(packed[:-3])[0] == codec.INPUT_OVERRUN and codec.decode(packed, 10)[0] == codec.OUTPUT_OVERRUN
    assert codec.decode(packed + b"x")[0] == codec.NOT_CONSUMED and codec.decode(b"\x12A\x40\xff")[0] == codec.LOOK_BEHIND


def test_containers(spark):
    data = [(1, b"a" * 10), (2, bytes(range(256)) * 9), (3, b"")]
    rows = spark.createDataFrame(data, "id long, value binary").withColumn("n", F.octet_length("value"))
    cut = blocks.sliced(rows, "value", 1000).withColumn("payload", codec.encoded("block"))
    made = blocks.containers(rows, cut, "id", F.col("n"), F.lit(1000))
    back = blocks.parsed(made, "id").withColumn("d", codec.decoded("payload", "plain_bytes")).collect()
    whole = {}
    for r in sorted(back, key=lambda r: (r["id"], r["block_id"])):
        assert r["status"] == "ok" and (r["block_id"] is None or r["d"]["status"] == 0)
        whole[r["id"]] = whole.get(r["id"], b"") + (bytes(r["d"]["plain"]) if r["block_id"] is not None else b"")
    assert whole == dict(data)
    bad = spark.createDataFrame([(1, b"x"), (2, b"\0" * 14), (3, b"\x5a\x4c" + b"\1\0\0\0" * 3), (4, b"\x5a\x4c" + b"\1\0\0\0" * 3 + b"\5\0\0\0")], "id long, container binary")
    assert [r["status"] for r in blocks.parsed(bad, "id").orderBy("id").collect()] == ["too small", "bad magic", "short length table", "short payload"]


def test_checksums(spark):
    row = spark.createDataFrame([(bytes(128 << 10),)], "v binary").select(binary.adler32("v").alias("a"), binary.crc32(F.col("v")).alias("c")).first()
    assert tuple(row) == (0x001E0001, 0x7EE8CDCD) and zlib.adler32(bytes(128 << 10)) == row["a"]


def test_round_trip_holds_a_bounded_batch(spark, sf_dir):
    plan = catalogue.queries()["codec_round_trip"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == codec.BATCH_BYTES
    values = [None, b"", b"ab" * 3_000_000, *(b"%d" % i * 9 for i in range(200))]
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, value binary").withColumn("n", F.octet_length("value").cast("long"))
    got = {r["doc_id"]: (r["n"], r["n_packed"], r["same"]) for r in codec.round_trips(rows).collect()}
    assert got == {i: (None, None, None) if x is None else (len(x), len(codec.encode(x)), True) for i, x in enumerate(values)}
