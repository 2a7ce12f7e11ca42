"""WARC: round trip, revisits, and salvage of damaged archives."""

import hashlib

from gravelbed.llm import warc


def packed(*payloads, plain=False):
    out = [warc.record("response", str(i), f"http://x/{i}", p, warc.base32_sha1(p)) for i, p in enumerate(payloads)]
    return [x if plain else warc.member(x) for x in out]


def test_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    got = warc.written_and_read(pages).collect()
    assert {int(r["record_id"]): bytes(r["payload"]) for r in got} == want
    assert {r["page_id"]: r["payload_digest"] for r in warc.op4_warc(spark, sf_dir).collect()} == {k: warc.base32_sha1(v) for k, v in want.items()}


def test_revisits_and_nulls(spark):
    rows = [(3, None, "same"), (1, "u", "same"), (2, "u v", None), (9, "u", ""), (None, "u", "same"), (7, "u", "é"), (7, "u", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.written_and_read(pages).collect()), key=str)
    assert got == sorted([("3", "revisit", "1", 4), ("1", "response", None, 4), ("2", "response", None, 0), ("9", "revisit", "2", 0), (None, "revisit", "1", 4), ("7", "response", None, 2), ("7", "response", None, 2)], key=str)
    assert warc.written_and_read(pages.limit(0)).count() == 0


def test_salvage_recovers_later_records():
    for plain in (False, True):
        a, b, c = packed(b"first" * 50, b"WARC/1.1\r\nfalse start" * 20, b"third" * 50, plain=plain)
        clean = list(warc.salvage(a + b + c))
        assert [x.block for x in clean] == [b"first" * 50, b"WARC/1.1\r\nfalse start" * 20, b"third" * 50]
        hurt = bytearray(b)
        hurt[len(hurt) // 2] ^= 0x55
        found = list(warc.salvage(a + bytes(hurt) + c))
        assert [x.kind for x in found] == ["response", None, "response"]
        assert (found[1].offset, found[1].n_bytes) == (len(a), len(b)) and found[1].reason
        assert found[2].block == b"third" * 50
        cut = list(warc.salvage(a + b[: len(b) - 9]))
        assert [x.kind for x in cut] == ["response", None] and cut[1].n_bytes == len(b) - 9
    junk = list(warc.salvage(b"\x1f\x8b\x08junk" + a + b"tail"))
    assert [x.kind for x in junk] == [None, "response", None]
    assert not list(warc.salvage(b""))


def test_quarantine_log(spark, tmp_path):
    a, b = packed(b"one" * 30, b"two" * 30)
    (tmp_path / "x.warc.gz").write_bytes(a[:-5] + b)
    records = warc.read(spark, str(tmp_path))
    assert [(r["offset"], r["n_bytes"]) for r in warc.gaps(records).collect()] == [(0, len(a) - 5)]
    assert [hashlib.sha1(bytes(r["payload"])).digest() for r in records.filter("record_type IS NOT NULL").collect()] == [hashlib.sha1(b"two" * 30).digest()]


def test_members_of_several_records_and_http():
    a, b, c = packed(b"first" * 50, b"second" * 50, b"third" * 50, plain=True)
    assert [x.block[:5] for x in warc.salvage(warc.member(a + b + c))] == [b"first", b"secon", b"third"]
    bad = list(warc.salvage(warc.member(a + b.replace(b"second", b"sEcond") + c)))
    assert [(x.kind, x.block[:5]) for x in bad] == [("response", b"first"), ("response", b"third"), (None, b"")] and bad[2].reason == "payload digest"
    noise = warc.record("response", "9", "u", bytes(hashlib.sha256(bytes([i, j])).digest()[0] for i in range(200) for j in range(200)), "")
    whole = warc.member(a + noise)
    cut = list(warc.salvage(whole[:-200] + warc.member(c)))
    assert [x.block[:5] for x in cut] == [b"first", b"", b"third"] and cut[1].kind is None and (cut[1].offset, cut[1].n_bytes) == (0, len(whole) - 200)
    body = b"<p>x</p>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    lines = ["WARC-Type: response", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{warc.base32_sha1(body)}", f"Content-Length: {len(block)}"]
    http = warc.VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    assert [(x.kind, warc.payload_of(x.headers, x.block)) for x in warc.salvage(http)] == [("response", body)]
    assert [x.kind for x in warc.salvage(http.replace(b"<p>x", b"<p>y"))] == [None]
