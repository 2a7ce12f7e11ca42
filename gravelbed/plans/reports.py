"""Queries over measurement logs and tables, with DuckDB SQL: the driver's tables stand in for runs, and files that a
scan reads are first written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravelbed import __version__
from gravelbed.functions import binary, text
from gravelbed.operators import blocks, records
from gravelbed.plans.catalogue import _payloads, _table, query
from gravelbed.scratch import scratch_path, written
from gravelbed.sources import files

#: Line items as runs of a measurement: times are missing where discount or tax is zero.
RUNS = """WITH runs AS (SELECT l_orderkey AS repeat, 'l' || l_linenumber AS level, l_returnflag AS alg, l_linestatus AS wg, 'part' || (l_partkey % 25) AS sample,
CAST(floor(l_extendedprice) AS BIGINT) AS orig, CAST(l_quantity AS BIGINT) * 100 AS comp, CASE WHEN l_discount > 0 THEN CAST(round(l_discount * 100) AS BIGINT) END AS comp_ms,
CASE WHEN l_tax > 0 THEN CAST(round(l_tax * 100) AS BIGINT) END AS decomp_ms FROM lineitem) """
METRICS = ["comp_ms", "decomp_ms", "orig"]


def runs(spark, sf_dir) -> DataFrame:
    def ms(c):
        return F.when(F.col(c) > 0, F.round(F.col(c) * 100).cast("long"))

    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("repeat"), F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("level"), F.col("l_returnflag").alias("alg"), F.col("l_linestatus").alias("wg"),
        F.concat(F.lit("part"), (F.col("l_partkey") % 25).cast("string")).alias("sample"), F.floor("l_extendedprice").cast("long").alias("orig"),
        (F.col("l_quantity").cast("long") * 100).alias("comp"), ms("l_discount").alias("comp_ms"), ms("l_tax").alias("decomp_ms"),
    )


def _logs(spark, sf_dir) -> str:
    """Writes the runs as logs comp=level/wg=wg/*; level l7 has neither key in its headers. Files that a scan has to leave out lie beside them."""
    root, rows = scratch_path(spark, "logs"), runs(spark, sf_dir)
    keys = F.when(F.col("level") != "l7", F.format_string("COMP=%s WG=%s ", "level", "wg")).otherwise("")
    comp = F.when(F.col("comp_ms").isNotNull(), F.format_string("[COMP ] orig=%d comp=%d kernel=%d ms\n", "orig", "comp", "comp_ms")).otherwise("")
    decomp = F.when(F.col("decomp_ms").isNotNull(), F.format_string("[DECOMP] kernel=%d ms\n", "decomp_ms")).otherwise("")
    line = F.concat(F.lit("# "), keys, F.format_string("SAMPLE=%s R=%d\n", "sample", "repeat"), comp, decomp)
    lines = rows.select(F.col("level").alias("comp"), F.col("wg"), line.alias("value"))
    lines.write.partitionBy("comp", "wg").text(root)
    lines.filter("comp = 'l1'").select("value").write.text(f"{root}/other=l1/wg=F")
    lines.filter("comp = 'l1'").select("value").write.option("header", True).csv(f"{root}/comp=csv/wg=F")
    return root


@query("log_tree_scan", RUNS + """SELECT level, 'none' AS mode, wg, sample, repeat, CAST(comp_ms AS DOUBLE) AS comp_ms, CAST(decomp_ms AS DOUBLE) AS decomp_ms,
CASE WHEN comp_ms IS NOT NULL THEN CAST(orig AS DOUBLE) END AS orig, CASE WHEN comp_ms IS NOT NULL THEN CAST(comp AS DOUBLE) END AS comp FROM runs WHERE comp_ms IS NOT NULL OR decomp_ms IS NOT NULL""")
def log_tree_scan(spark, sf_dir):
    return files.run_logs(spark, _logs(spark, sf_dir), ".txt").drop("path")


@query("profile_tree_scan", RUNS + """SELECT combo, tag, count(*) AS n, sum(value) AS total, min(value) AS least, max(value) AS most FROM (
SELECT level AS combo, 'COMP' AS tag, CAST(comp_ms AS DOUBLE) AS value FROM runs UNION ALL SELECT level, 'DECOMP', decomp_ms FROM runs) WHERE value IS NOT NULL GROUP BY 1, 2""")
def profile_tree_scan(spark, sf_dir):
    found = files.profiles(spark, _logs(spark, sf_dir), "comp", "kernel", ".txt")
    return found.groupBy("combo", "tag").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


def _summaries(spark, sf_dir) -> str:
    """Writes sums of the runs as CSV tables config=F and config=O, the second without the column decomp_ms."""
    root = scratch_path(spark, "summaries")
    sums = runs(spark, sf_dir).groupBy("alg", "level", F.col("wg").alias("config")).agg(F.sum("comp_ms").alias("comp_ms"), F.sum("decomp_ms").alias("decomp_ms"), F.sum("orig").alias("orig"))
    for config, columns in (("F", ["alg", "level", "comp_ms", "decomp_ms", "orig"]), ("O", ["orig", "alg", "level", "comp_ms"])):
        sums.filter(F.col("config") == config).select(*columns).write.option("header", True).csv(f"{root}/config={config}")
    return root


@query("csv_glob_scan", RUNS + """SELECT wg AS config, alg, level, CAST(sum(comp_ms) AS BIGINT) AS comp_ms, CASE WHEN wg = 'F' THEN CAST(sum(decomp_ms) AS BIGINT) END AS decomp_ms, CAST(sum(orig) AS BIGINT) AS orig FROM runs GROUP BY 1, 2, 3""")
def csv_glob_scan(spark, sf_dir):
    return files.csv_tables(spark, _summaries(spark, sf_dir), ["F", "O"], {"alg": "string", "level": "string", "comp_ms": "long", "decomp_ms": "long", "orig": "long"})


@query("csv_single_scan", RUNS + """SELECT alg, TRY_CAST(level AS BIGINT) AS level, CAST(sum(orig) AS BIGINT) AS orig, CAST(NULL AS DOUBLE) AS absent FROM runs WHERE wg = 'O' GROUP BY alg, runs.level""")
def csv_single_scan(spark, sf_dir):
    return files.csv_table(spark, f"{_summaries(spark, sf_dir)}/config=O", {"alg": "string", "level": "long", "orig": "long", "absent": "double"})


@query("missing_as_zero", RUNS + "SELECT alg, level, wg, avg(coalesce(comp_ms, 0.0)) AS comp_ms, avg(coalesce(decomp_ms, 0.0)) AS decomp_ms, avg(coalesce(orig, 0.0)) AS orig FROM runs GROUP BY 1, 2, 3")
def missing_as_zero(spark, sf_dir):
    return records.means_by(runs(spark, sf_dir), ["alg", "level", "wg"], METRICS, 0.0)


@query("wide_with_deltas", RUNS + """, w AS (SELECT alg, level, avg(CASE WHEN wg = 'F' THEN comp_ms END) AS F_comp_ms, avg(CASE WHEN wg = 'F' THEN decomp_ms END) AS F_decomp_ms,
avg(CASE WHEN wg = 'O' THEN comp_ms END) AS O_comp_ms, avg(CASE WHEN wg = 'O' THEN decomp_ms END) AS O_decomp_ms FROM runs GROUP BY 1, 2)
SELECT *, (O_comp_ms - F_comp_ms) / F_comp_ms * 100 AS delta_O_comp_ms, (O_decomp_ms - F_decomp_ms) / F_decomp_ms * 100 AS delta_O_decomp_ms FROM w""")
def wide_with_deltas(spark, sf_dir):
    return records.wide_against(runs(spark, sf_dir), ["alg", "level"], "wg", ["F", "O"], ["comp_ms", "decomp_ms"], "F")


@query("long_statistics", RUNS + """SELECT alg, metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS spread, min(value) AS least, max(value) AS most FROM (
SELECT alg, 'comp_ms' AS metric, CAST(comp_ms AS DOUBLE) AS value FROM runs UNION ALL SELECT alg, 'decomp_ms', decomp_ms FROM runs UNION ALL SELECT alg, 'orig', orig FROM runs) WHERE value IS NOT NULL GROUP BY 1, 2""")
def long_statistics(spark, sf_dir):
    rows = runs(spark, sf_dir).select("alg", *(F.col(m).cast("double").alias(m) for m in METRICS))
    return records.long_statistics(rows, ["alg"], METRICS)


@query("throughput", RUNS + "SELECT alg, wg, avg(orig) / (avg(comp_ms) / 1000) / 1048576 AS comp_speed, CASE WHEN avg(decomp_ms) > 0 THEN avg(orig) / (avg(decomp_ms) / 1000) / 1048576 END AS decomp_speed FROM runs GROUP BY 1, 2")
def throughput(spark, sf_dir):
    means = records.means_by(runs(spark, sf_dir), ["alg", "wg"], METRICS)
    return means.select("alg", "wg", *(text.megabytes_per_second(F.col("orig"), F.col(f"{k}_ms")).alias(f"{k}_speed") for k in ("comp", "decomp")))


@query("cleaned_rows", """
SELECT event_id, coalesce(nullif(CASE WHEN user_id % 3 = 0 THEN '' ELSE event_type END, ''), 'user' || user_id) AS name, coalesce(CASE WHEN user_id % 5 <> 0 THEN event_type END, 'none') AS strategy, value
FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT (user_id % 7 = 0 AND event_type = 'click') AND value > 0""")
def cleaned_rows(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("key", F.when(~((F.col("user_id") % 7 == 0) & (F.col("event_type") == "click")), F.col("user_id")))
    rows = rows.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))).dropna(subset=["key", "event_type", "value"]).filter("value > 0")
    name = text.or_else(F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("event_type")), F.concat(F.lit("user"), F.col("user_id").cast("string")))
    strategy = F.coalesce(F.when(F.col("user_id") % 5 != 0, F.col("event_type")), F.lit("none"))
    return rows.select("event_id", name.alias("name"), strategy.alias("strategy"), "value")


@query("derived_columns", RUNS + """SELECT repeat, level, alg || '__threads=' || wg AS key, ln(1 + orig) AS log_orig, comp / CAST(1000 AS DOUBLE) AS comp_mhz, CASE WHEN comp > 1500 THEN orig / CAST(comp AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS ratio,
CASE WHEN substr(level, 2) IN ('1', '2', '3') THEN 'fast' WHEN substr(level, 2) IN ('4', '5', '6') THEN 'medium' ELSE 'high' END AS level_group, CAST(0 AS DOUBLE) AS comp_speed,
CASE WHEN comp = 0 THEN '0.0' WHEN 100.0 * comp / 4096 <= 100 - 1 / 16.0 THEN lpad(printf('%.1f', 100.0 * comp / 4096), 4, ' ') ELSE CAST(CAST(floor(100.0 * comp / 4096 + 0.5) AS BIGINT) AS VARCHAR) END AS percent FROM runs""")
def derived_columns(spark, sf_dir):
    level = F.substring("level", 2, 1).cast("int")
    return runs(spark, sf_dir).select(
        "repeat", "level", F.concat("alg", F.lit("__threads="), "wg").alias("key"), F.log1p(F.col("orig").cast("double")).alias("log_orig"), (F.col("comp") / 1000).alias("comp_mhz"),
        text.safe_ratio(F.col("orig"), F.col("comp"), 1500).alias("ratio"), text.level_group(level).alias("level_group"), F.lit(0.0).alias("comp_speed"), text.percent_text(100 * F.col("comp") / 4096).alias("percent"),
    )


@query("report_header", "SELECT count(*) AS n, sum(o_totalprice) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, avg(o_totalprice) AS mean, median(o_totalprice) AS middle FROM orders")
def report_header(spark, sf_dir):
    v = F.col("o_totalprice")
    return _table(spark, sf_dir, "orders").agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.median(v).alias("middle"))


@query("block_maxima", RUNS + "SELECT alg, CAST(sum(most) AS BIGINT) AS total FROM (SELECT alg, sample, max(comp) AS most FROM runs GROUP BY 1, 2) GROUP BY 1")
def block_maxima(spark, sf_dir):
    most = runs(spark, sf_dir).groupBy("alg", "sample").agg(F.max("comp").alias("most"))
    return most.groupBy("alg").agg(F.sum("most").alias("total"))


@query("request_statistics", RUNS + "SELECT level, count(*) AS requests, CAST(sum(coalesce(comp_ms, 0)) AS BIGINT) AS total_ms, sum(coalesce(comp_ms, 0)) / CAST(count(*) AS DOUBLE) AS mean_ms, CAST(sum(greatest(orig - comp, 0)) AS BIGINT) AS saved FROM runs GROUP BY 1")
def request_statistics(spark, sf_dir):
    ms = F.sum(F.coalesce("comp_ms", F.lit(0)))
    return runs(spark, sf_dir).groupBy("level").agg(F.count("*").alias("requests"), ms.alias("total_ms"), (ms / F.count("*")).alias("mean_ms"), F.sum(F.greatest(F.col("orig") - F.col("comp"), F.lit(0))).alias("saved"))


@query("distinct_configs", RUNS + "SELECT config, row_number() OVER (ORDER BY config) AS place FROM (SELECT DISTINCT alg || '_' || wg AS config FROM runs)")
def distinct_configs(spark, sf_dir):
    return records.placed(runs(spark, sf_dir).select(F.concat("alg", F.lit("_"), "wg").alias("config")).distinct(), F.col("config"))


@query("byte_histogram", """
SELECT CAST(instr('123456789ABCDEF', x[1]) * 16 + instr('123456789ABCDEF', x[2]) AS BIGINT) AS byte, count(*) AS n FROM (
SELECT unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS x FROM documents) GROUP BY 1""")
def byte_histogram(spark, sf_dir):
    each = _payloads(spark, sf_dir).select(F.posexplode(binary.byte_counts("value")).alias("byte", "n")).filter("n > 0")
    return each.groupBy(F.col("byte").cast("long").alias("byte")).agg(F.sum("n").alias("n"))


@query("histogram_of_values", """
WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1""")
def histogram_of_values(spark, sf_dir):
    return records.histogram(_table(spark, sf_dir, "lineitem"), "l_quantity", 50)


@query("sorted_means", RUNS + ", m AS (SELECT alg, level, wg, avg(orig) AS orig FROM runs GROUP BY 1, 2, 3) SELECT *, row_number() OVER (ORDER BY alg, level) AS by_two, row_number() OVER (ORDER BY wg DESC, level, alg) AS place FROM m WHERE wg = 'F'")
def sorted_means(spark, sf_dir):
    means = records.means_by(runs(spark, sf_dir).filter("wg = 'F'"), ["alg", "level", "wg"], ["orig"])
    two = records.placed(means, F.col("alg"), F.col("level")).withColumnRenamed("place", "by_two")
    return records.placed(two, F.desc("wg"), F.col("level"), F.col("alg"))


@query("numeric_order", "SELECT label, row_number() OVER (ORDER BY TRY_CAST(label AS BIGINT) NULLS LAST, label) AS place FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS label FROM part UNION SELECT DISTINCT p_brand FROM part)")
def numeric_order(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    labels = parts.select(F.col("p_size").cast("string").alias("label")).union(parts.select("p_brand")).distinct()
    return records.placed(labels, text.sort_number(F.col("label")))


@query("first_paths", "SELECT path, name, row_number() OVER (ORDER BY path) AS place FROM (SELECT url AS path, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages) ORDER BY path LIMIT 10")
def first_paths(spark, sf_dir):
    paths = _table(spark, sf_dir, "pages").select(F.col("url").alias("path"), text.basename(F.col("url")).alias("name"))
    return records.placed(paths.orderBy("path").limit(10), F.col("path"))


@query("ranked_lists", """
WITH o AS (SELECT o_orderkey, o_totalprice AS price, o_custkey AS cust FROM orders)
SELECT * FROM (SELECT 'highest price' AS list, o_orderkey, CAST(price AS DOUBLE) AS score, row_number() OVER (ORDER BY price DESC, o_orderkey) AS place FROM o) WHERE place <= 10
UNION ALL SELECT * FROM (SELECT 'lowest price', o_orderkey, CAST(price AS DOUBLE), row_number() OVER (ORDER BY price, o_orderkey) AS place FROM o) WHERE place <= 15
UNION ALL SELECT * FROM (SELECT 'highest customer', o_orderkey, CAST(cust AS DOUBLE), row_number() OVER (ORDER BY cust DESC, o_orderkey) AS place FROM o) WHERE place <= 15""")
def ranked_lists(spark, sf_dir):
    out = None
    for name, column, count, rising in (("highest price", "o_totalprice", 10, False), ("lowest price", "o_totalprice", 15, True), ("highest customer", "o_custkey", 15, False)):
        rows = _table(spark, sf_dir, "orders").select(F.lit(name).alias("list"), "o_orderkey", F.col(column).cast("double").alias("score"))
        top = records.best(rows, "score", "o_orderkey", count, rising)
        out = top if out is None else out.unionByName(top)
    return out


@query("table_line_scan", RUNS + """, t AS (SELECT alg AS method, sample AS file, CAST(sum(orig) AS BIGINT) AS length, CAST(sum(comp) AS BIGINT) AS packed, sample <> 'part3' AS consistent FROM runs GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY file) AS by_name FROM t)
SELECT method, file, length, packed, consistent, by_name FROM r
UNION ALL SELECT method, '(total)', CAST(sum(length) AS BIGINT), CAST(sum(packed) AS BIGINT), bool_and(consistent), NULL FROM t GROUP BY 1""")
def table_line_scan(spark, sf_dir):
    """Lines are written with the right percentage but for one file, so the check has something to find."""
    root = scratch_path(spark, "tables")
    sums = runs(spark, sf_dir).groupBy("alg", "sample").agg(F.sum("orig").alias("n"), F.sum("comp").alias("c"))
    percent = F.when(F.col("sample") == "part3", 77.7 + 100 * F.col("c") / F.col("n")).otherwise(100 * F.col("c") / F.col("n"))
    line = F.format_string("%s| %s %d %d %d %.2f %.1f %.1f |", "alg", "sample", "n", F.lit(1), "c", percent, F.lit(0.0), F.lit(0.0))
    sums.select(line.alias("value")).union(sums.select(F.lit("-----"))).write.text(root)
    rows = files.table_lines(spark, root).select("method", "file", "length", "packed", "consistent")
    total = rows.groupBy("method").agg(F.lit("(total)").alias("file"), F.sum("length").alias("length"), F.sum("packed").alias("packed"), F.bool_and("consistent").alias("consistent"))
    named = rows.withColumn("by_name", F.row_number().over(Window.partitionBy("method").orderBy("file")).cast("long"))
    return named.unionByName(total.withColumn("by_name", F.lit(None).cast("long")))


@query("report_scan", "SELECT r_name AS name, 'Region ' || r_name AS title, list_reduce(list('- ' || n_name || chr(10) ORDER BY n_name), lambda a, b: a || b) AS listed FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def report_scan(spark, sf_dir):
    """Writes a report for each region and reads them all back."""
    root = scratch_path(spark, "reports")
    nations = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    body = F.concat(F.lit("# Region "), "r_name", F.lit("\n\n"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("- "), x)), "\n"))
    regions = _table(spark, sf_dir, "region").join(F.broadcast(nations), "r_regionkey")
    regions.select(F.col("r_name").alias("region"), body.alias("value")).write.partitionBy("region").text(root)
    found = files.reports(spark, root, "region", ".txt")
    return found.select("name", "title", F.regexp_replace("body", r"(?s)^.*?\n\n", "").alias("listed"))


@query("whole_file_scan", "SELECT r_name AS name, CAST(2 * strlen(r_name) + 2 AS BIGINT) AS length, substr(r_name, 1, 3) AS head, true AS regular FROM region")
def whole_file_scan(spark, sf_dir):
    root = scratch_path(spark, "whole")
    _table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.concat("r_name", F.lit("\n"), "r_name").alias("value")).write.partitionBy("region").text(root)
    found = files.whole_files(spark, root, "*.txt", 3)
    return found.select(files.path_key(F.col("path"), "region").alias("name"), "length", F.col("content").cast("string").alias("head"), F.col("length").isNotNull().alias("regular"))


@query("made_inputs", """
SELECT 'zeros' AS pattern, i AS size, CAST(CASE WHEN i > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_distinct FROM range(51) r(i)
UNION ALL SELECT 'repeat', CAST(1024 << (2 * i) AS BIGINT), 64 FROM range(4) r(i)
UNION ALL SELECT 'drawn', CAST(1024 << i AS BIGINT), 256 FROM range(3, 7) r(i)""")
def made_inputs(spark, sf_dir):
    """Short files, files of a repeated pattern, and files of bytes drawn by a keyed hash, which no packer shortens."""
    short = spark.range(51).select(F.lit("zeros").alias("pattern"), F.col("id").alias("size"), F.expr("unhex(repeat('00', cast(id as int)))").alias("value"))
    tile = "".join(f"{(7 * i + 3) % 256:02x}" for i in range(64))
    sizes = spark.range(4).select(F.expr("cast(1024 << cast(2 * id as int) as bigint)").alias("size"))
    tiled = sizes.select(F.lit("repeat").alias("pattern"), "size", F.expr(f"unhex(repeat('{tile}', cast(size / 64 as int)))").alias("value"))
    drawn = spark.range(3, 7).select(F.expr("cast(1024 << cast(id as int) as bigint)").alias("size"))
    digits = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.expr("cast(size / 32 as bigint)")), lambda i: F.sha2(F.concat(F.lit("seed 42:"), i.cast("string")).cast("binary"), 256)), "")
    drawn = drawn.select(F.lit("drawn").alias("pattern"), "size", F.unhex(digits).alias("value"))
    every = short.unionByName(tiled).unionByName(drawn)
    return every.select("pattern", F.octet_length("value").cast("long").alias("size"), F.size(F.filter(binary.byte_counts("value"), lambda n: n > 0)).cast("long").alias("n_distinct"))


@query("host_block_plan", """
WITH d AS (SELECT doc_id, 700 * strlen(coalesce(text, '')) AS n FROM documents),
a AS (SELECT doc_id, n, CAST(least(greatest(ceil(ceil(n / CAST(greatest(least(1024, n), 1) AS DOUBLE)) / 16384) * 16384, 65536), 262144) AS BIGINT) AS blk FROM d),
b AS (SELECT doc_id, n, CASE WHEN ceil(n / CAST(blk AS DOUBLE)) < 8 THEN CAST(least(greatest(ceil(ceil(n / 8.0) / 16384) * 16384, 65536), 262144) AS BIGINT) ELSE blk END AS blk, greatest(8, CAST(ceil(n / CAST(blk AS DOUBLE)) AS BIGINT)) AS k FROM a)
SELECT doc_id, n, CASE WHEN k > 1 AND n - blk * (k - 1) < blk // 4 AND n >= blk * (k - 1) THEN CAST(least(greatest(ceil(ceil(n / CAST(k AS DOUBLE)) / 16384) * 16384, 65536), 262144) AS BIGINT) ELSE blk END AS host,
CAST(least(greatest(ceil(ceil(n / CAST(greatest(least(1024, n), 1) AS DOUBLE)) / 65536) * 65536, 65536), 131072) AS BIGINT) AS daemon FROM b""")
def host_block_plan(spark, sf_dir):
    rows = _payloads(spark, sf_dir).select("doc_id", (700 * F.col("n")).alias("n"))
    return rows.select("doc_id", "n", blocks.host_block_size(F.col("n"), 8).alias("host"), blocks.daemon_block_size(F.col("n"), 8).alias("daemon"))


@query("verify_against_reference", """
SELECT doc_id, i = 0 AS same, CASE WHEN i > 0 THEN strlen(substr(x, 1, i - 1)) END AS first_mismatch FROM (SELECT doc_id, coalesce(text, '') AS x, instr(coalesce(text, ''), 'e') AS i FROM documents)""")
def verify_against_reference(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("x"))
    off = binary.first_mismatch(F.col("x").cast("binary"), F.regexp_replace("x", "e", "E").cast("binary"))
    return rows.select("doc_id", off.alias("first_mismatch")).select("doc_id", F.col("first_mismatch").isNull().alias("same"), "first_mismatch")


@query("container_faults", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'too small' WHEN 1 THEN 'bad magic' WHEN 2 THEN CASE WHEN n > 0 THEN 'short length table' ELSE 'ok' END WHEN 3 THEN CASE WHEN n > 0 THEN 'short payload' ELSE 'ok' END ELSE 'ok' END AS status
FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)""")
def container_faults(spark, sf_dir):
    """Reading without a reference: the status of containers, four in five of them damaged."""
    rows = _payloads(spark, sf_dir)
    cut = blocks.sliced(rows, "value", 4096).withColumnRenamed("block", "payload")
    c, k = F.col("container"), F.col("doc_id") % 5
    size = F.octet_length(c)
    hurt = F.when(k == 0, F.substring(c, 1, 9)).when(k == 1, F.concat(F.lit(b"XX"), F.substring(c, F.lit(3), size))).when((k == 2) & (size > 14), F.substring(c, 1, 15)).when((k == 3) & (size > 14), F.substring(c, F.lit(1), size - 1)).otherwise(c)
    made = written(blocks.containers(rows, cut, "doc_id", F.col("n"), F.lit(4096)).select("doc_id", hurt.alias("container")), "containers")
    return blocks.parsed(made, "doc_id").groupBy("doc_id").agg(F.first("status").alias("status"))


#: Methods by id, name and group.
METHODS = [(1, "fast", "quick"), (2, "plain", "quick"), (9, "dense", "slow"), (99, "best", "slow"), (0, "copy", "none")]


@query("method_lookup", """
WITH m AS (SELECT * FROM (VALUES (1, 'fast', 'quick'), (2, 'plain', 'quick'), (9, 'dense', 'slow'), (99, 'best', 'slow'), (0, 'copy', 'none')) t(id, name, grp)),
w AS (SELECT r_regionkey, unnest(string_split(CASE r_regionkey WHEN 0 THEN 'all' WHEN 1 THEN 'fast,quick,1' WHEN 2 THEN '99,slow' WHEN 3 THEN 'COPY' ELSE 'missing,plain' END, ',')) AS wanted FROM region)
SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS request, CAST(id AS BIGINT) AS id, name FROM w, m WHERE lower(wanted) IN ('all', name, grp, CAST(id AS VARCHAR))""")
def method_lookup(spark, sf_dir):
    methods = spark.createDataFrame(METHODS, "id long, name string, grp string")
    terms = methods.select("id", "name", F.explode(F.array(F.lit("all"), "name", "grp", F.col("id").cast("string"))).alias("wanted"))
    lists = F.when(F.col("r_regionkey") == 0, "all").when(F.col("r_regionkey") == 1, "fast,quick,1").when(F.col("r_regionkey") == 2, "99,slow").when(F.col("r_regionkey") == 3, "COPY").otherwise("missing,plain")
    requests = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("request"), F.explode(F.split(F.lower(lists), ",")).alias("wanted"))
    return requests.join(F.broadcast(terms), "wanted").select("request", "id", "name").dropDuplicates()


@query("dimension_lookup", RUNS + "SELECT sample, repeat, n_name, n_name IS NOT NULL AS known FROM runs LEFT JOIN nation ON 'part' || n_nationkey = sample AND n_nationkey < 20")
def dimension_lookup(spark, sf_dir):
    names = _table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("part"), F.col("n_nationkey").cast("string")).alias("sample"), "n_name")
    return runs(spark, sf_dir).join(F.broadcast(names), "sample", "left").select("sample", "repeat", "n_name", F.col("n_name").isNotNull().alias("known"))


#: Expected CRC-32 and Adler-32 of 128 KiB of zero bytes, and of no bytes.
GOLDEN = [("zeros", 0x7EE8CDCD, 0x001E0001), ("none", 0, 1)]


@query("golden_values", "SELECT * FROM (VALUES ('zeros', true, true), ('none', true, true)) t(name, known, matches)")
def golden_values(spark, sf_dir):
    values = spark.range(1).select(F.lit("zeros").alias("name"), F.expr("unhex(repeat('00', 131072))").alias("v")).union(spark.range(1).select(F.lit("none"), F.expr("unhex('')")))
    golden = spark.createDataFrame(GOLDEN, "name string, crc long, adler long")
    both = values.join(F.broadcast(golden), "name", "left")
    return both.select("name", F.col("crc").isNotNull().alias("known"), ((binary.crc32(F.col("v")) == F.col("crc")) & (binary.adler32("v") == F.col("adler"))).alias("matches"))


@query("engine_version", f"SELECT '{__version__}' AS version")
def engine_version(spark, sf_dir):
    return spark.range(1).select(F.lit(__version__).alias("version"))


@query("file_names", """
SELECT p_partkey, p_name || '.pk' AS packed, p_name AS plain, p_name || '.raw' AS other, regexp_replace(p_name, '[^A-Za-z0-9.-]+', '_', 'g') || '_' || substr(sha1(p_name), 1, 8) AS safe, lower(p_name) = lower(upper(p_name)) AS same_name,
p_size * 1024 AS bytes, CAST(NULL AS BIGINT) AS no_size FROM part""")
def file_names(spark, sf_dir):
    name = F.col("p_name")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", text.packed_name(name, ".pk").alias("packed"), text.plain_name(text.packed_name(name, ".pk"), ".pk").alias("plain"), text.plain_name(name, ".pk").alias("other"), text.safe_name(name).alias("safe"),
        (F.lower(name) == F.lower(F.upper(name))).alias("same_name"), text.byte_size(F.concat(F.col("p_size").cast("string"), F.lit("k"))).alias("bytes"), text.byte_size(F.concat(F.lit("x"), F.col("p_size").cast("string"))).alias("no_size"),
    )


@query("run_stamps", "SELECT user_id, strftime(min(ts), '%Y%m%d_%H%M%S') AS stamp, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS seconds FROM events GROUP BY 1")
def run_stamps(spark, sf_dir):
    spans = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))
    return spans.select("user_id", text.run_stamp(F.col("start")).alias("stamp"), text.elapsed_seconds(F.col("start"), F.col("stop")).alias("seconds"))


@query("json_snapshot", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS governor, CAST(user_id AS BIGINT) AS cpu FROM events""")
def json_snapshot(spark, sf_dir):
    """Host snapshots as JSON texts with a list of units, read by schema."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("props").alias("own"), F.to_json(F.struct(F.lit("t").alias("timestamp"), F.array(F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("gov"))).alias("cpus"))).alias("snapshot"))
    state = rows.select("event_id", F.from_json("own", "k long").alias("own"), F.explode(F.from_json("snapshot", "timestamp string, cpus array<struct<id: string, gov: string>>")["cpus"]).alias("c"))
    return state.select("event_id", F.col("own.k").alias("k"), F.col("c.gov").alias("governor"), F.col("c.id").cast("long").alias("cpu"))


@query("fixed_width_fields", "SELECT o_orderkey, o_orderkey * 7 AS big, o_orderkey * 7 AS little, hex(o_custkey % 256) AS last FROM orders")
def fixed_width_fields(spark, sf_dir):
    n = (F.col("o_orderkey") * 7).cast("long")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", binary.put_be(n, 8).alias("b"), binary.put_le(n, 8).alias("l"))
    return rows.select("o_orderkey", binary.be(F.col("b"), 0, 8).alias("big"), binary.le(F.col("l"), 0, 8).alias("little"), F.hex((F.col("o_custkey") % 256).cast("long")).alias("last"))
