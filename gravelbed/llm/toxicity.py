"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed insult lexicon and of terms learnt from the
training labels, nearness of both to second-person words, capitals, punctuation and
obfuscation rates. Trees and calibration are Spark ML's; language, source, id and labels
are never inputs of a score.

Fitting uses a bounded sample of labelled rows (SAMPLE, chosen by a hash of the id), so
the sample's ids are broadcast under that bound; scoring covers every row.

Nulls: a null or empty text has zero counts and is scored like any other. Labels with a
null toxic are skipped; of repeated labels the largest counts. Repeated rows are scored
alike; extra columns of accepted() pass through whatever their names. Without rows of both classes in the training folds the score is the share of hits in
the fixed lexicon, 1 - 1 / (1 + hits per 100 words).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import crc_fold, mapped, written

#: Labelled rows that a model is fitted on at most.
SAMPLE = 20_000
#: Learnt terms at most, and the toxic rows that a term needs.
TERMS, TERM_ROWS = 400, 5
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7

#: Insults in four languages.
LEXICON = frozenset(
    (
        "idiot idiots moron morons imbecile stupid dumb fool foolish loser losers pathetic worthless useless trash garbage scum filth filthy disgusting clown clowns "
        "jerk creep coward liar pig rat vermin parasite freak ugly hate kill die shut crap damn hell bastard bitch asshole dickhead wanker twat retard retarded slut whore "
        "crétin crétine abruti abrutie imbécile débile con connard connasse salaud salope ordure minable nul dégueulasse pourriture bouffon "
        "dummkopf trottel arschloch schwachkopf vollidiot blödmann drecksau abschaum erbärmlich wertlos ekelhaft verlierer dumm "
        "estúpido estúpida imbécil tonto tonta pendejo cabrón basura escoria patético patética inútil asqueroso asquerosa payaso perdedor gilipollas"
    ).split()
)
#: Words that address the reader.
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer eure tú ti usted ustedes vosotros vuestro".split())

_STRIP = ".,;:!?\"'()[]{}*_-"
_LEET = str.maketrans("013457@$!", "oieastasi")
_MIXED = re.compile(rb"[A-Za-z][0-9@$*!]+[A-Za-z]")
_STRETCHED = re.compile(rb"([A-Za-z])\1\1")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT, _SYMBOL = b".,;:'\"()-", b"#*$%&|<>@^~"
FEATURES = (
    "fixed_rate fixed_count learnt_rate learnt_count learnt_weight learnt_top near_you capitals shouted exclaims questions "
    "punctuation digits symbols mixed hidden stretched words word_length"
).split()


def terms(words: list[str]) -> set[str]:
    """What a text offers the learnt lexicon: its words and the beginnings of the longer ones."""
    found = set(words)
    return found | {f"{w[:5]}~" for w in found if len(w) > 5} | {f"{w[:7]}~" for w in found if len(w) > 7}


def words_of(text: bytes) -> list[str]:
    return [w.strip(_STRIP) for w in text.decode("utf-8", "replace").lower().split()]


def features(text: bytes, learnt: dict[str, float]) -> list[float]:
    """One number for each name in FEATURES."""
    words = words_of(text)
    n, size = max(1, len(words)), max(1, len(text))
    fixed = [i for i, w in enumerate(words) if w in LEXICON]
    hits = {i: learnt[w] for i, w in enumerate(words) if w in learnt}
    for width in (5, 7):
        for i, w in enumerate(words):
            if len(w) > width and (k := f"{w[:width]}~") in learnt:
                hits[i] = max(hits.get(i, 0.0), learnt[k])
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - 3) : i + 4]) for i in {*fixed, *hits})
    hidden = sum((c := w.translate(_LEET)) != w and c in LEXICON for w in words if not w.isalpha())

    def share(chars: bytes) -> float:
        return (len(text) - len(text.translate(None, chars))) / size

    shouted = sum(w.isupper() and len(w) > 1 for w in text.split())
    return [
        len(fixed) / n, math.log1p(len(fixed)), len(hits) / n, math.log1p(len(hits)), sum(hits.values()) / n, max(hits.values(), default=0.0), near / n,
        share(_UPPER), shouted / n, share(b"!"), share(b"?"), share(_PUNCT), share(_DIGIT), share(_SYMBOL),
        len(_MIXED.findall(text)) / n, hidden / n, len(_STRETCHED.findall(text)) / n, math.log1p(len(words)), size / n,
    ]


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, text, label of at most limit labelled rows of the training folds, the same for the same ids."""
    there = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    chosen = there.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")


def learnt_terms(rows: DataFrame) -> dict[str, float]:
    """Log odds of the terms that speak most clearly for label 1."""

    def count(batches):
        for batch in batches:
            seen: dict[float, Counter] = {0.0: Counter(), 1.0: Counter()}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen[label].update(terms(words_of(text or b"")))
            names = list(seen[0.0] | seen[1.0])
            yield pa.record_batch([pa.array(names, pa.string()), pa.array([seen[0.0][x] for x in names], pa.int64()), pa.array([seen[1.0][x] for x in names], pa.int64())], names=["term", "clean", "toxic"])

    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = totals.get(0.0, 0), totals.get(1.0, 0)
    found = mapped(rows.select("text", "label"), count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    best = found.filter((F.col("toxic") >= TERM_ROWS) & (F.length("term") > 1)).select("term", odds.alias("odds")).filter("odds > 2.5")
    return {r["term"]: r["odds"] for r in best.orderBy(F.desc("odds"), "term").limit(TERMS).collect()}


def with_features(docs: DataFrame, learnt: dict[str, float], keep: list[str]) -> DataFrame:
    """The columns in keep, and features (array of double) of the column text."""
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add("features", ArrayType(DoubleType()))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = [features(x or b"", learnt) for x in part.column("_text").to_pylist()]
                yield pa.record_batch([*(part.column(c) for c in keep), pa.array(values, pa.list_(pa.float64()))], names=[*keep, "features"])

    return mapped(docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("binary").alias("_text")), run, schema)


class Model:
    """Learnt terms, trees and calibration; trees is None where the training folds lack a class."""

    def __init__(self, learnt, trees, calibration):
        self.learnt, self.trees, self.calibration = learnt, trees, calibration

    def score(self, featured: DataFrame) -> DataFrame:
        """featured with score instead of features."""
        if self.trees is None:
            hits = F.col("features")[0] * 100
            return featured.withColumn("score", hits / (hits + 1)).drop("features")
        kept = [F.col(f"`{c}`") for c in featured.columns if c != "features"]
        raw = self.trees.transform(featured.withColumn("_vector", array_to_vector("features")))
        raw = raw.select(*kept, vector_to_array("_probability")[1].alias("_raw"))
        out = self.calibration.transform(raw)
        return out.select(*kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score"))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Terms and trees learn from three quarters of the sampled rows, the calibration from the rest."""
    rows = written(training_rows(docs, labels, limit), "labelled")
    rows = rows.withColumn("label", (F.col("label") > 0).cast("double"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4))
    learnt = learnt_terms(rows.filter(fold != 0))
    table = written(with_features(rows.withColumn("fold", fold), learnt, ["doc_id", "label", "fold"]), "features").withColumn("_vector", array_to_vector("features"))
    parts = table.orderBy("doc_id")
    seen = {(r["own"], r["label"]) for r in table.select((F.col("fold") != 0).alias("own"), "label").distinct().collect()}
    if len(seen) < 4:
        return Model(learnt, None, None)
    trees = GBTClassifier(
        featuresCol="_vector", labelCol="label", predictionCol="_predicted",
        maxIter=20, maxDepth=3, stepSize=0.2, minInstancesPerNode=3, seed=7, checkpointInterval=-1,
    ).fit(parts.filter("fold <> 0").coalesce(4))
    trees = trees.setProbabilityCol("_probability").setRawPredictionCol("_margin")
    raw = trees.transform(parts.filter("fold = 0")).select("label", vector_to_array("_probability")[1].alias("_raw")).coalesce(1)
    return Model(learnt, trees, IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_score").fit(raw))


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], limit: int = SAMPLE) -> DataFrame:
    """The columns in keep, and held_out, score and predicted."""
    model = fit(docs, labels, limit)
    keep = [c for c in keep if c not in ("features", "score", "predicted", "held_out", "_text")]
    out = model.score(with_features(docs, model.learnt, keep))
    return out.withColumns({"held_out": crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic; all columns stay, whatever their names."""
    whole = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return scored(whole, labels, ["doc_id", "_row"]).filter("predicted = 0").select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return scored(docs, labels, ["doc_id"]).select("doc_id", "held_out", "score", "predicted")
