"""Scans of run logs, profiles, CSV tables, table lines, reports and whole files.

Text scans read a file as one value (logs and reports are small; their number is what grows), so they are one
task for each group of files. Keys come from the path, as key=value or key_value in a folder's name, and
from a section's header line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _texts(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path, value of the files below root whose names end in suffix."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def path_key(path: Column, key: str) -> Column:
    """What follows key= or key_ in the name of a folder of the path (a URI); null if there is none."""
    found = F.regexp_extract(path, rf"/{key}[=_]([^/]+)/", 1)
    return F.nullif(F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))), F.lit(""))


def header_key(header: Column, key: str) -> Column:
    """KEY=value in a header line; null if there is none."""
    return F.nullif(F.regexp_extract(header, rf"(?:^|\s){key}=(\S+)", 1), F.lit(""))


def metric(section: Column, tag: str, name: str) -> Column:
    """The number after name= in the first line that begins with [tag]; null if there is none or it is no number."""
    return F.regexp_extract(section, rf"(?m)^\[{tag} *\][^\n]*?\b{name}=(-?[0-9.]+)", 1).try_cast("double")


def run_logs(spark: SparkSession, root: str, suffix: str = ".log", first: str = "comp") -> DataFrame:
    """One row for each run in the logs below folders first=... or first_...: path, level, mode, wg, sample, repeat,
    comp_ms, decomp_ms, orig, comp. A run begins at a line # KEY=value ...; what its header lacks comes from the path.
    Other folders and files are left out, and runs without either time."""
    files = _texts(spark, root, suffix).filter(path_key(F.col("path"), first).isNotNull())
    runs = F.filter(F.split("value", r"(?m)^(?=# )"), lambda s: s.startswith("# "))
    each = files.select("path", F.explode(runs).alias("run")).withColumn("header", F.substring_index("run", "\n", 1))
    keys = {"level": "COMP", "mode": "MAP_MODE", "wg": "WG"}
    paths = {"level": first, "mode": "map", "wg": "wg"}
    out = each.select(
        "path", *(F.coalesce(header_key(F.col("header"), keys[k]), path_key(F.col("path"), paths[k]), F.lit("none")).alias(k) for k in keys),
        header_key(F.col("header"), "SAMPLE").alias("sample"), header_key(F.col("header"), "R").try_cast("long").alias("repeat"),
        metric(F.col("run"), "COMP", "kernel").alias("comp_ms"), metric(F.col("run"), "DECOMP", "kernel").alias("decomp_ms"),
        metric(F.col("run"), "COMP", "orig").alias("orig"), metric(F.col("run"), "COMP", "comp").alias("comp"),
    )
    return out.filter(F.coalesce("comp_ms", "decomp_ms").isNotNull())


def profiles(spark: SparkSession, root: str, folder: str, name: str, suffix: str = ".log") -> DataFrame:
    """combo, tag, value: every [TAG] ... name=number of all files, the combo being the folder's key; all matches, not only the first."""
    pattern = F.lit(rf"(?m)^\[(\w+) *\][^\n]*?\b{name}=(-?[0-9.]+)")
    files = _texts(spark, root, suffix).select(path_key(F.col("path"), folder).alias("combo"), "value").filter("combo IS NOT NULL")
    both = F.arrays_zip(F.regexp_extract_all("value", pattern, F.lit(1)).alias("tag"), F.regexp_extract_all("value", pattern, F.lit(2)).alias("number"))
    return files.select("combo", F.explode(both).alias("m")).select("combo", F.col("m.tag").alias("tag"), F.col("m.number").try_cast("double").alias("value"))


def last_match(text: Column, pattern: str) -> Column:
    """The first group of the last match; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def csv_table(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """The columns of schema (name to type) of CSV files with headers. Values that do not fit their type and
    columns that the files lack are null; other columns are left out."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    return raw.select(*(F.col(f"`{c}`").try_cast(t).alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()))


def csv_tables(spark: SparkSession, root: str, configs: list[str], schema: dict[str, str], folder: str = "config") -> DataFrame:
    """config and the columns of schema of the CSV files of each folder root/folder=config, whose own columns may differ."""
    out = None
    for config in configs:
        each = csv_table(spark, f"{root}/{folder}={config}", schema).select(F.lit(config).alias("config"), *schema)
        out = each if out is None else out.unionByName(each)
    return out


#: Fixed value: the layout of a table line.
TABLE_LINE = r"^\s*(\S+)\|\s*(\S+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+\.?\d*)\s+(\d+\.?\d*)\s+(\d+\.?\d*)\s*\|\s*$"


def table_lines(spark: SparkSession, root: str) -> DataFrame:
    """method, file, length, blocks, packed, percent, comp_speed, decomp_speed of text lines laid out as method| file ... |;
    consistent: whether the percentage is that of the lengths, to a tenth. Other lines are left out."""
    lines = spark.read.option("recursiveFileLookup", True).text(root).filter(F.col("value").rlike(TABLE_LINE))
    names = ["method", "file", "length", "blocks", "packed", "percent", "comp_speed", "decomp_speed"]
    kinds = ["string", "string", "long", "long", "long", "double", "double", "double"]
    out = lines.select(*(F.regexp_extract("value", TABLE_LINE, i + 1).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))))
    right = F.when(F.col("length") > 0, 100 * F.col("packed") / F.col("length")).otherwise(0.0)
    return out.withColumn("consistent", F.abs(right - F.col("percent")) <= 0.1)


def reports(spark: SparkSession, root: str, folder: str, suffix: str = ".md") -> DataFrame:
    """name (the folder's key), title (the first heading) and body of the reports below root."""
    files = _texts(spark, root, suffix)
    title = F.nullif(F.regexp_extract("value", r"(?m)^# +([^\n]+)", 1), F.lit(""))
    return files.select(path_key(F.col("path"), folder).alias("name"), title.alias("title"), F.col("value").alias("body"))


def whole_files(spark: SparkSession, root: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """path, length, content (the first most bytes of it, if given) of the regular files below root whose names fit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    content = F.col("content") if most is None else F.substring("content", 1, most)
    return files.select("path", "length", content.alias("content"))
