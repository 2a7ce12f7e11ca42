"""Mixing sources to target weights: raking (iterative proportional fitting) and sampling.

Documents are summed to cells, one for each combination of the dimensions' values. Raking finds a
probability for each cell such that the expected kept tokens meet the target of every value of
every dimension: each round scales the cells of a value, for each dimension in turn, to its target. No probability
exceeds 1: cells at 1 count as they are and the others of the value are scaled to the rest of its target.
It ends when every marginal is within TOLERANCE of its target. A document is kept with its cell's probability.

Targets are shares of the kept tokens; keep_share of all tokens is aimed at, and less where a value has
fewer tokens than its share would need. Default targets are each value's tokens to the power
TEMPERATURE, and at most FILL of what the value has, which leaves the other dimensions some room. Targets of several dimensions can contradict each other (a source that is the only
one of its language, say); then rounds end at ROUNDS, calibrated is false for all rows, and marginals() shows what is off.
Cells are a bounded table for bounded dimensions: up to CELLS of them are raked on the driver in numpy, more by
grouped sums and joins in Spark, by the same rule.

Nulls in a dimension are a value of their own (NULL); a null doc_id draws by a constant. Null
and empty texts have no tokens; they take part in sampling with their cell's probability, keep_share where
the cell has no tokens at all. Repeated rows of one id draw alike. Extra columns pass through
unless they have the name of an added one, which replaces them. A topic, where a corpus carries none, comes from the
whole text: the bucket of a hash that most of its words of seven or more characters fall in (ties: the lowest).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, forget, text_of, written

DIMENSIONS = ("source", "lang", "topic")
#: Default targets are each value's token share to this power, so large sources shrink and small ones grow.
TEMPERATURE = 0.7
#: Most of a value's tokens that a default target asks for (keep_share where that is more).
FILL = 0.9
KEEP_SHARE, SEED, TOPICS = 0.8, 20, 8
#: Largest deviation of a marginal from its target at the end, that which counts as calibrated, and rounds at most.
TOLERANCE, CALIBRATED, ROUNDS = 1e-6, 1e-3, 200
#: Cells up to which raking runs on the driver and probabilities are broadcast (about 100 bytes each).
CELLS = 20_000
NULL = "∅"
ADDED = ("n_tokens", "probability", "calibrated", "kept")


def with_topic(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """docs with a topic: the bucket of most long words of the text, none where there are no such words."""
    buckets = F.transform(F.regexp_extract_all(F.lower(text_of(docs)), F.lit(f"{WORD}{{7,}}"), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(topics)))
    counts = F.aggregate(buckets, F.array_repeat(F.lit(0), topics), lambda n, b: F.transform(n, lambda x, i: x + (i == b).cast("int")))
    topic = F.array_position("_counts", F.array_max("_counts"))
    out = docs.withColumn("_counts", counts)
    return out.withColumn("topic", F.when(F.array_max("_counts") > 0, F.concat(F.lit("t"), (topic - 1).cast("string"))).otherwise("none")).drop("_counts")


def _measured(docs: DataFrame, dimensions) -> DataFrame:
    named = {d: F.coalesce(F.col(f"`{d}`").cast("string"), F.lit(NULL)) for d in dimensions}
    return docs.withColumns(named | {"n_tokens": F.regexp_count(text_of(docs), F.lit(f"{WORD}+")).cast("long")})


def tempered(cells: DataFrame, dimension: str, power: float = TEMPERATURE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """value, share: each value's tokens to the power, as shares of the tokens to keep; of a value's
    tokens FILL at most, and the others share the rest in the same proportions."""
    n, fill = F.sum("n_tokens").cast("double"), max(FILL, keep_share)
    sums = written(cells.groupBy(dimension).agg((n * fill).alias("n"), F.pow(n, F.lit(power)).alias("p")).filter("n > 0").withColumnRenamed(dimension, "value"), "marginal")
    goal = keep_share / fill * (sums.agg(F.sum("n")).first()[0] or 0.0)
    factor = 0.0
    while True:  # each turn fills up at least one value more
        want = F.col("p") * factor
        full = F.col("n") <= want
        have, rest = sums.agg(F.sum(F.when(full, F.col("n")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("p")))).first()
        after = max(factor, (goal - have) / rest) if rest else factor
        if after <= factor * (1 + 1e-12):
            return sums.select("value", (F.least("n", F.col("p") * factor) / (goal or 1.0)).alias("share"))
        factor = after


def _goals(cells: DataFrame, targets: dict[str, DataFrame], keep_share: float) -> dict[str, DataFrame]:
    """For each dimension, its values with tokens and the tokens of each to keep (goal)."""
    shares, kept = {}, keep_share * (cells.agg(F.sum("n_tokens")).first()[0] or 0)
    for d, target in targets.items():
        there = cells.groupBy(F.col(d).alias("value")).agg(F.sum("n_tokens").alias("n")).filter("n > 0").join(target, "value", "left").select("value", "n", F.coalesce("share", F.lit(0.0)).alias("share"))
        total, reach = there.agg(F.sum("share"), F.min(F.when(F.col("share") > 0, F.col("n") / F.col("share")))).first()
        if not total:
            raise ValueError(f"no value of {d} has a target")
        shares[d], kept = there.withColumn("share", F.col("share") / total), min(kept, reach * total)
    return {d: written(x.select(F.col("value").alias(d), (F.col("share") * kept).alias("goal")), "goals") for d, x in shares.items()}


def _raked_here(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float, rounds: int) -> DataFrame:
    rows = cells.select(*goals, "n_tokens").collect()
    n, weight = np.array([r["n_tokens"] for r in rows], float), np.ones(len(rows))
    plans = []
    for d, goal in goals.items():
        goal = {r[d]: r["goal"] for r in goal.collect()}
        values = {v: i for i, v in enumerate(goal)}
        plans.append((np.array([values[r[d]] for r in rows]), np.array(list(goal.values()))))
    worst = 0.0
    for _ in range(rounds):
        for place, goal in plans:
            free = weight < 1
            full, rest = (np.bincount(place, n * x, len(goal)) for x in (~free, np.where(free, weight, 0.0)))
            with np.errstate(divide="ignore", invalid="ignore"):
                # nothing left to scale: all go down together
                factor = np.where((rest > 0) & (goal > full), (goal - full) / rest, goal / (full + rest))
            weight = np.where(free | ((goal <= full) | (rest <= 0))[place], weight * factor[place], weight)
        worst = max((np.abs(np.bincount(place, n * np.minimum(weight, 1), len(goal)) - goal) / np.maximum(goal, 1)).max() for place, goal in plans)
        if worst <= tolerance:
            break
    # as an Arrow table it needs no Python workers; those for a list of rows would be others than the stages' own, and stay
    data = {d: pa.array([r[d] for r in rows], pa.string()) for d in goals}
    data |= {"probability": pa.array(np.minimum(weight, 1.0), pa.float64()), "calibrated": pa.array([bool(worst <= CALIBRATED)] * len(rows), pa.bool_())}
    return cells.join(F.broadcast(cells.sparkSession.createDataFrame(pa.table(data))), list(goals))


def _raked_there(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float, rounds: int) -> DataFrame:
    now, worst = written(cells.withColumn("probability", F.lit(1.0)), "cells"), 0.0
    p, n = F.col("probability"), F.col("n_tokens")
    for _ in range(rounds):
        after = now
        for d, goal in goals.items():
            sums = after.groupBy(d).agg(F.sum(F.when(p >= 1, n).otherwise(0.0)).alias("full"), F.sum(F.when(p < 1, n * p).otherwise(0.0)).alias("rest")).join(goal, d)
            part = (F.col("rest") > 0) & (F.col("goal") > F.col("full"))
            factor = F.when(part, (F.col("goal") - F.col("full")) / F.col("rest")).otherwise(F.col("goal") / (F.col("full") + F.col("rest")))
            after = after.join(sums.select(d, factor.alias("factor"), part.alias("part")), d)
            after = after.withColumn("probability", F.when((p < 1) | ~F.col("part"), p * F.col("factor")).otherwise(p)).drop("factor", "part")
        after = written(after, "raked")
        forget(now)
        now, off = after, None
        for d, goal in goals.items():
            each = now.groupBy(d).agg(F.sum(n * F.least(p, F.lit(1.0))).alias("sum")).join(goal, d).select((F.abs(F.col("sum") - F.col("goal")) / F.greatest("goal", F.lit(1.0))).alias("off"))
            off = each if off is None else off.unionByName(each)
        worst = off.agg(F.max("off")).first()[0] or 0.0
        if worst <= tolerance:
            break
    return now.withColumns({"probability": F.least(p, F.lit(1.0)), "calibrated": F.lit(worst <= CALIBRATED)})


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep_share: float = KEEP_SHARE, tolerance: float = TOLERANCE, rounds: int = ROUNDS, here: int = CELLS) -> DataFrame:
    """cells (dimensions, n_tokens) with probability and calibrated.

    targets: value and share for each dimension. Values without tokens are left out and the
    shares of the others taken to 1; values without a target get none."""
    held = cells.filter("n_tokens > 0")
    if held.isEmpty():
        return cells.withColumns({"probability": F.lit(keep_share), "calibrated": F.lit(True)})
    goals = _goals(cells, targets, keep_share)
    raked = _raked_here if held.count() <= here else _raked_there
    done = raked(held, goals, tolerance, rounds)
    rest = cells.filter("n_tokens = 0").withColumns({"probability": F.lit(keep_share), "calibrated": F.lit(True)})
    return done.unionByName(rest)


def marginals(kept: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """dimension, value, expected: the tokens of mixed() rows that are expected to stay, by each dimension's values."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions))).alias("of")
    return kept.select(each, (F.col("n_tokens") * F.col("probability")).alias("expected")).groupBy("of.dimension", "of.value").agg(F.sum("expected").alias("expected"))


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, dimensions=DIMENSIONS, keep_share: float = KEEP_SHARE, seed: int = SEED, here: int = CELLS) -> DataFrame:
    """docs with n_tokens, probability, calibrated and kept; dimensions as strings."""
    measured = _measured(docs.drop(*ADDED), dimensions)
    cells = written(measured.groupBy(*dimensions).agg(F.sum("n_tokens").alias("n_tokens")), "sums")
    raked = written(rake(cells, targets or {d: tempered(cells, d, TEMPERATURE, keep_share) for d in dimensions}, keep_share, here=here), "probabilities")
    table = raked.select(*dimensions, "probability", "calibrated")
    table = F.broadcast(table) if table.count() <= CELLS else table
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))), 11) / F.lit(float(1 << 53))
    return measured.join(table, list(dimensions)).withColumn("kept", draw < F.col("probability"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of docs with their own columns, whatever their names."""
    needed = [c for c in ("doc_id", "text", *DIMENSIONS) if c in docs.columns]
    whole = docs.select(*needed, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    own = [F.col(f"_row.`{c}`") for c in docs.columns]
    return mixed(whole if "topic" in docs.columns else with_topic(whole), **options).filter("kept").select(*own)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = with_topic(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))
    return mixed(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "calibrated", "kept")
