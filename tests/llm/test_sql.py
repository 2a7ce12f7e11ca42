"""Operators with SQL against DuckDB, and fingerprints against brute force."""

import duckdb
import pytest
import xxhash

from gravelbed.llm import registry, simhash


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    got = registry.queries()[name](spark, sf_dir).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())


def test_fingerprints_and_components(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {}
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op1_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}
