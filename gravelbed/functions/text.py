"""Names, sizes, percentages, units and stamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def safe_name(name: Column) -> Column:
    """name with each run of characters other than letters, digits, dots and hyphens as one underscore, and a short hash of the whole."""
    return F.concat(F.regexp_replace(name, "[^A-Za-z0-9.-]+", "_"), F.lit("_"), F.substring(F.sha1(name.cast("binary")), 1, 8))


def byte_size(literal: Column) -> Column:
    """Bytes of a literal such as 64, 16k, 4M or 2G; null for anything else."""
    number = F.regexp_extract(literal, r"^\s*(\d+)\s*([kKmMgG]?)[bB]?\s*$", 1).try_cast("long")
    unit = F.lower(F.regexp_extract(literal, r"^\s*(\d+)\s*([kKmMgG]?)[bB]?\s*$", 2))
    return number * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)


def packed_name(path: Column, suffix: str) -> Column:
    """The name of a packed file: suffix added."""
    return F.concat(path, F.lit(suffix))


def plain_name(path: Column, suffix: str) -> Column:
    """The name of an unpacked file: suffix taken off, or .raw added where it is missing."""
    return F.when(path.endswith(suffix) & (F.length(path) > len(suffix)), F.substring(path, F.lit(1), F.length(path) - len(suffix))).otherwise(F.concat(path, F.lit(".raw")))


def percent_text(percent: Column) -> Column:
    """A percentage as a table shows it: 0.0 up to zero, one decimal up to 100 - 1/16, then whole numbers up to 9999."""
    whole = F.floor(percent + 0.5)
    return F.when(percent <= 0, "0.0").when(percent <= 100 - 1 / 16, F.lpad(F.format_string("%.1f", percent), 4, " ")).otherwise(F.least(whole, F.lit(9999)).cast("string"))


def level_group(level: Column) -> Column:
    """The group of a compression level."""
    return F.when(level.between(1, 3), "fast").when(level.between(4, 6), "medium").when(level.between(7, 8), "high").otherwise("best")


def safe_ratio(part: Column, whole: Column, least: float = 1e-5) -> Column:
    """part / whole, zero where whole is not above least."""
    return F.when(whole > least, part / whole).otherwise(0.0)


def megabytes_per_second(total_bytes: Column, total_ms: Column) -> Column:
    """MiB in a second; null without a time."""
    return F.when(total_ms > 0, total_bytes / (total_ms / 1000) / (1 << 20))


def sort_number(label: Column) -> Column:
    """Sort key of labels, numbers before others and by value: (not a number, number, label)."""
    number = F.when(label.rlike("^[0-9]+$"), label.cast("long"))
    return F.struct(number.isNull().alias("text"), number.alias("number"), label.alias("label"))


def or_else(first: Column, second: Column) -> Column:
    """first, or second where first is null or an empty string."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def run_stamp(at: Column) -> Column:
    """A time as a run's stamp, such as 20240131_235959."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def elapsed_seconds(start: Column, stop: Column) -> Column:
    return F.unix_micros(stop.cast("timestamp")) / 1e6 - F.unix_micros(start.cast("timestamp")) / 1e6
