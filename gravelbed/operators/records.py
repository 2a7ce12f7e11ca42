"""Measurement records: grouping, pivots, deltas, harmonic means, nearest-rank percentiles, histograms, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def harmonic_mean(value: Column) -> Column:
    """Harmonic mean of the positive values; null if there is none."""
    positive = F.when(value > 0, value)
    return F.count(positive) / F.sum(1 / positive)


def delta_percent(value: Column, base: Column) -> Column:
    """100 * (value - base) / base; zero where the base is zero."""
    return F.when(base != 0, (value - base) / base * 100).when(base == 0, 0.0)


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], parts: int = 32) -> DataFrame:
    """For each group the value at place floor(n * share), at most n - 1, in rising order.

    Values are counted first, so a group is as many rows as it has distinct values. Those are dealt by ranges of (keys, value),
    so a group may span many tasks; a table of each range's sums (parts rows a group at most) gives what comes before it."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    dealt = counts.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy(*keys)
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_sum"))
    sums = sums.withColumns({"_n": F.sum("_sum").over(own), "_before": F.coalesce(F.sum("_sum").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    each = dealt.alias("r").join(F.broadcast(sums.alias("s")), [F.col("r._part") == F.col("s._part"), *same]).select("r.*", "_n", "_before")
    upto = each.withColumn("_to", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))

    def at(share: float) -> Column:
        place = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)
        return F.max(F.when((F.col("_to") > place) & (F.col("_to") - F.col("_c") <= place), F.col(value)))

    return upto.groupBy(*keys).agg(*(at(q).alias(name) for name, q in shares.items()))


def wide(rows: DataFrame, keys: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """A column for each of the given values with the mean of value; the list keeps the plan lazy."""
    return rows.groupBy(*keys).pivot(column, values).agg(F.avg(value))


def best_and_worst(rows: DataFrame, keys: list[str], name: str, score: str) -> DataFrame:
    """The names with the highest and lowest score of each group; of equal ones the first name."""
    return rows.groupBy(*keys).agg(F.min_by(name, F.struct(-F.col(score), name)).alias("best"), F.min_by(name, F.struct(score, name)).alias("worst"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0), n of equal-width bins from the least to the greatest value, which falls in the last one."""
    span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    each = rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    return each.groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def against_base(rows: DataFrame, key: str, variant: str, suffix: str, value: str) -> DataFrame:
    """Each variant whose name ends in suffix beside the one of the same key without it: key, variant, value, base, delta."""
    v = rows.filter(F.col(variant).endswith(suffix)).withColumn("_base", F.substring(F.col(variant), F.lit(1), F.length(variant) - len(suffix)))
    b = rows.select(F.col(key), F.col(variant).alias("_base"), F.col(value).alias("base"))
    return v.join(b, [key, "_base"]).select(key, variant, value, "base", delta_percent(F.col(value), F.col("base")).alias("delta"))


def means_by(rows: DataFrame, keys: list[str], values: list[str], missing: float | None = None) -> DataFrame:
    """Means of values by keys; with missing, a missing value counts as that number."""
    return rows.groupBy(*keys).agg(*(F.avg(F.col(v) if missing is None else F.coalesce(v, F.lit(missing))).alias(v) for v in values))


def wide_against(rows: DataFrame, keys: list[str], column: str, values: list[str], metrics: list[str], base: str) -> DataFrame:
    """Keys, then for each of the given values and metrics a column value_metric with its mean, and delta_value_metric with
    its difference in per cent from the value base."""
    out = rows.groupBy(*keys).pivot(column, values).agg(*(F.avg(m).alias(m) for m in metrics))
    deltas = {f"delta_{v}_{m}": delta_percent(F.col(f"`{v}_{m}`"), F.col(f"`{base}_{m}`")) for v in values if v != base for m in metrics}
    return out.withColumns(deltas)


def long_statistics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Keys, metric, n, mean, spread (of the population), least, most: a row for each group and metric, missing values left out."""
    long = rows.unpivot(keys, metrics, "metric", "value").filter("value IS NOT NULL AND NOT isnan(value)")
    v = F.col("value")
    return long.groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("spread"), F.min(v).alias("least"), F.max(v).alias("most"))


def best(rows: DataFrame, score: str, tie: str, count: int, rising: bool = False) -> DataFrame:
    """The count rows of the highest (or, rising, lowest) scores with their place from 1; missing and NaN scores left out."""
    order = [F.col(score).asc() if rising else F.col(score).desc(), F.col(tie)]
    top = rows.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).orderBy(*order).limit(count)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """A small table (of groups, not of rows) with each row's place from 1 in an order."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
