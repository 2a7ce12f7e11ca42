"""Registered queries over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gravelbed.functions.binary import adler32, crc32
from gravelbed.operators import blocks, codec, records
from gravelbed.scratch import written

_QUERIES = {}
_SQL = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, and its SQL where there is one."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _payloads(spark, sf_dir):
    value = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return _table(spark, sf_dir, "documents").select("doc_id", value.alias("value")).withColumn("n", F.octet_length("value").cast("long"))


def flagship(spark, sf_dir):
    """Bytes and block counts of the documents' UTF-8 payloads by language."""
    docs = _table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    count = blocks.block_count(size, F.lit(1024))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(size).alias("n_bytes"), F.sum(count).alias("n_blocks"))


query("block_totals", "SELECT lang, count(*) AS n_docs, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes, CAST(sum(ceil(strlen(coalesce(text, '')) / 1024.0)) AS BIGINT) AS n_blocks FROM documents GROUP BY lang")(flagship)


@query("thread_block_plan", """
SELECT doc_id, n, size, CASE WHEN n > 0 THEN CAST(ceil(n / CAST(size AS DOUBLE)) AS BIGINT) ELSE 0 END AS n_blocks, n + n // 16 + 67 AS bound
FROM (SELECT doc_id, n, CASE WHEN n = 0 THEN 65536 ELSE least(least(greatest(CAST(ceil(n / 4.0) AS BIGINT), 65536), 1048576), n) END AS size
FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents))""")
def thread_block_plan(spark, sf_dir):
    size = blocks.thread_block_size(F.col("n"), 4)
    return _payloads(spark, sf_dir).select("doc_id", "n", size.alias("size"), blocks.block_count(F.col("n"), size).alias("n_blocks"), blocks.expansion_bound(F.col("n")).alias("bound"))


@query("device_block_plan", """
SELECT doc_id, CAST(least(greatest(ceil(ceil(n / 1024.0) / 16384) * 16384, 65536), 262144) AS BIGINT) AS host, CAST(ceil(ceil(n / 32.0) / 256) * 256 AS BIGINT) AS plain
FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)""")
def device_block_plan(spark, sf_dir):
    n = F.col("n")
    return _payloads(spark, sf_dir).select("doc_id", blocks.device_block_size(n, 1024, 16 << 10, 64 << 10, 256 << 10).alias("host"), blocks.device_block_size(n, 32, 256).alias("plain"))


@query("block_slices", """
SELECT doc_id, CAST(o / 1024 AS BIGINT) AS block_id, o AS start, least(1024, n - o) AS n_bytes, CAST(o AS BIGINT) AS packed_offset
FROM (SELECT doc_id, n, unnest(range(0, n, 1024)) AS o FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents))""")
def block_slices(spark, sf_dir):
    cut = blocks.sliced(_payloads(spark, sf_dir), "value", 1024)
    cut = cut.select("doc_id", F.col("block_id").cast("long").alias("block_id"), F.col("offset").alias("start"), F.octet_length("block").cast("long").alias("n_bytes"))
    return blocks.with_offsets(cut, "doc_id", F.col("n_bytes"))


@query("codec_round_trip", "SELECT doc_id, strlen(coalesce(text, '')) AS n, true AS same, true AS within_bound FROM documents")
def codec_round_trip(spark, sf_dir):
    back = codec.round_trips(_payloads(spark, sf_dir))
    return back.select("doc_id", "n", "same", (F.col("n_packed") <= blocks.expansion_bound(F.col("n"))).alias("within_bound"))


@query("container_round_trip", """
SELECT doc_id, CAST(ceil(n / 4096.0) AS BIGINT) AS n_blocks, n AS n_bytes, 14 + 4 * CAST(ceil(n / 4096.0) AS BIGINT) + n AS n_packed, md5(x) AS plain_md5
FROM (SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, '')) AS n FROM documents)""")
def container_round_trip(spark, sf_dir):
    """Containers of given payloads (here the blocks themselves), parsed and laid end to end again; empty values too."""
    rows = _payloads(spark, sf_dir)
    cut = blocks.sliced(rows, "value", 4096).withColumnRenamed("block", "payload")
    made = written(blocks.containers(rows, cut, "doc_id", F.col("n"), F.lit(4096)), "containers")
    back = blocks.parsed(made, "doc_id").filter("status = 'ok'")
    whole = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("block_id").isNotNull(), F.struct("block_id", "payload")))), lambda p: F.hex(p["payload"])), ""))
    plain = back.groupBy("doc_id").agg(F.count("block_id").alias("n_blocks"), F.coalesce(F.sum("plain_bytes"), F.lit(0)).alias("n_bytes"), F.md5(whole).alias("plain_md5"))
    return plain.join(made.select("doc_id", F.octet_length("container").cast("long").alias("n_packed")), "doc_id")


@query("checksums")
def checksums(spark, sf_dir):
    return _payloads(spark, sf_dir).select("doc_id", "n", adler32("value").alias("adler32"), crc32(F.col("value")).alias("crc32"))


@query("adler_sums", """
SELECT doc_id, n, ((n + coalesce(list_sum(list_transform(bytes, lambda v, i: (n - i + 1) * v)), 0)) % 65521) * 65536 + (1 + coalesce(list_sum(bytes), 0)) % 65521 AS adler32 FROM (
SELECT doc_id, n, list_transform(regexp_extract_all(h, '..'), lambda x: CAST(instr('123456789ABCDEF', x[1]) * 16 + instr('123456789ABCDEF', x[2]) AS BIGINT)) AS bytes FROM (
SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents))""")
def adler_sums(spark, sf_dir):
    return _payloads(spark, sf_dir).select("doc_id", "n", adler32("value").alias("adler32"))


@query("crc_of_names", """
WITH t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
b AS (SELECT p_partkey, list_transform(range(0, strlen(p_name)), lambda i: CAST(instr('123456789ABCDEF', hex(encode(p_name))[2 * i + 1]) * 16 + instr('123456789ABCDEF', hex(encode(p_name))[2 * i + 2]) AS BIGINT)) AS bytes FROM part)
SELECT p_partkey, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda a, v: xor(a >> 8, tab[1 + xor(a, v) % 256])), 4294967295) AS crc32 FROM b, t""")
def crc_of_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", crc32(F.col("p_name").cast("binary")).alias("crc32"))


@query("group_means", """
SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS mean, median(l_quantity) AS middle, stddev_pop(l_quantity) AS spread
FROM lineitem GROUP BY ALL""")
def group_means(spark, sf_dir):
    q = F.col("l_quantity")
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg(q).alias("mean"), F.median(q).alias("middle"), F.stddev_pop(q).alias("spread"))


@query("harmonic_means", "SELECT l_returnflag, count(CASE WHEN l_discount > 0 THEN 1 END) / sum(CASE WHEN l_discount > 0 THEN 1 / l_discount END) AS harmonic FROM lineitem GROUP BY 1")
def harmonic_means(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(records.harmonic_mean(F.col("l_discount")).alias("harmonic"))


@query("nearest_rank", """
SELECT l_returnflag, v[1 + least(CAST(floor(len(v) * 0.5) AS BIGINT), len(v) - 1)] AS p50, v[1 + least(CAST(floor(len(v) * 0.9) AS BIGINT), len(v) - 1)] AS p90,
  v[1 + least(CAST(floor(len(v) * 0.99) AS BIGINT), len(v) - 1)] AS p99 FROM (SELECT l_returnflag, list(l_quantity ORDER BY l_quantity) AS v FROM lineitem GROUP BY 1)""")
def nearest_rank(spark, sf_dir):
    return records.nearest_rank(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("pivot_wide", """
SELECT l_returnflag, avg(CASE WHEN l_linestatus = 'F' THEN l_tax END) AS F, avg(CASE WHEN l_linestatus = 'O' THEN l_tax END) AS O FROM lineitem GROUP BY 1""")
def pivot_wide(spark, sf_dir):
    return records.wide(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], "l_tax")


@query("delta_to_base", """
WITH m AS (SELECT l_linenumber, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1)
SELECT l_linenumber, price, (price - b) / b * 100 AS delta FROM m, (SELECT price AS b FROM m WHERE l_linenumber = 1)""")
def delta_to_base(spark, sf_dir):
    means = _table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.avg("l_extendedprice").alias("price"))
    base = means.filter("l_linenumber = 1").select(F.col("price").alias("base"))
    return means.crossJoin(F.broadcast(base)).select("l_linenumber", "price", records.delta_percent(F.col("price"), F.col("base")).alias("delta"))


@query("variant_against_base", """
WITH m AS (SELECT event_type AS core, CASE WHEN user_id % 2 = 0 THEN 'x' ELSE 'x_vec' END AS strategy, avg(value) AS ms FROM events GROUP BY 1, 2)
SELECT v.core, v.strategy, v.ms, b.ms AS base, (v.ms - b.ms) / b.ms * 100 AS delta FROM m v JOIN m b ON v.core = b.core AND v.strategy = 'x_vec' AND b.strategy = 'x'""")
def variant_against_base(spark, sf_dir):
    strategy = F.when(F.col("user_id") % 2 == 0, "x").otherwise("x_vec")
    means = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("core"), strategy.alias("strategy")).agg(F.avg("value").alias("ms"))
    return records.against_base(means, "core", "strategy", "_vec", "ms")


@query("best_and_worst", """
WITH m AS (SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, arg_max(o_orderpriority, s) AS best, arg_min(o_orderpriority, s) AS worst FROM m GROUP BY 1""")
def best_and_worst(spark, sf_dir):
    sums = _table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    return records.best_and_worst(sums, ["o_orderstatus"], "o_orderpriority", "s")


@query("histogram", """
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM orders, s GROUP BY 1""")
def histogram(spark, sf_dir):
    return records.histogram(_table(spark, sf_dir, "orders"), "o_totalprice", 30)


@query("top_ten", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_ten(spark, sf_dir):
    top = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long"))


@query("parameter_grid", "SELECT r_name AS level, n_name AS sample, CAST(i AS BIGINT) AS repeat FROM region, nation, range(1, 4) t(i)")
def parameter_grid(spark, sf_dir):
    grid = _table(spark, sf_dir, "region").select(F.col("r_name").alias("level")).crossJoin(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("sample")))
    return grid.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))


@query("average_and_total_ratio", """
SELECT o_orderstatus, avg(o_totalprice / (o_custkey + 1)) AS mean_of_ratios, sum(o_totalprice) / sum(o_custkey + 1) AS ratio_of_sums FROM orders GROUP BY 1""")
def average_and_total_ratio(spark, sf_dir):
    part, whole = F.col("o_totalprice"), F.col("o_custkey") + 1
    return _table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.avg(part / whole).alias("mean_of_ratios"), (F.sum(part) / F.sum(whole)).alias("ratio_of_sums"))


@query("extracted_fields", r"SELECT event_id, TRY_CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS DOUBLE) AS k, substr(sha1(event_type), 1, 8) AS tag FROM events")
def extracted_fields(spark, sf_dir):
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).try_cast("double")
    return _table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.substring(F.sha1(F.col("event_type").cast("binary")), 1, 8).alias("tag"))


@query("share_of_total", "SELECT l_returnflag, 100 * sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER () AS share FROM lineitem GROUP BY 1")
def share_of_total(spark, sf_dir):
    sums = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("s"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("s").alias("all")))).select("l_returnflag", (100 * F.col("s") / F.col("all")).alias("share"))


def queries():
    return _QUERIES


def oracle_sql():
    return _SQL
