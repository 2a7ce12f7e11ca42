"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every measure is a built-in expression over the row's own text, so the operator adds
no shuffle and no Python: Spark fuses measures, thresholds and verdict into one scan.

Null and empty texts have no words and fail the base rule. Ties and repeated rows
cannot matter, as rows are judged alone. Extra columns pass through unless their
name is one of the added ones, which replaces them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

#: Frequent function words of the four languages.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or that the their they this to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour que qui sa se ses son sur un une vous "
    "aber als auch auf aus bei bis das dass dem den der des die du ein eine einer er es für hat ich im ist mit nach nicht noch oder sich sie sind so um und uns von vor war wie wir zu zum zur "
    "al como con del desde donde el ella era es esta este fue ha hay las lo los más me mi muy no nos o para pero por porque sin sobre su sus también todo y ya"
).split()


class Rule(NamedTuple):
    """Keeps a text while low% <= 100 * part / whole <= high%; None: no bound on that side."""

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None


#: Production thresholds, in per cent of the second measure.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 20),
    Rule("exclamations", "n_exclaims", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 3, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
)

WINDOW = 8


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of width words found twice or more in the array.

    Windows compare by a 64-bit hash of their words' hashes. Texts without a repeated
    hash, found by a hash set, skip the sort that locates the repeats (n log n)."""

    def located(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            def same(e: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))

            hits = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))
            starts = F.sort_array(F.transform(hits, lambda e: e["i"]))
            none = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(
                starts,
                none,
                lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, covered)).otherwise(0)

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashed) - (width - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, width)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > width, let(let(hashed, windows), located)).otherwise(0).cast("long")


def measures(text: str = "text", stop_words: list[str] | None = None) -> dict[str, Column]:
    """Measures by name, over the text column and the columns _words and _lines."""
    t, words, lines = F.coalesce(F.col(text), F.lit("")), F.col("_words"), F.col("_lines")

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, f"[^{pattern}]+", ""))

    stops = [*(stop_words or STOP_WORDS)]
    return {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": count("#*$%&|<>"),
        "n_exclaims": count("!"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(stops))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))),
        "n_repeat_words": repeated_window_words(words),
    }


def compiled(rules=RULES) -> dict[str, Column]:
    """One boolean expression for each rule, in whole numbers so that no rounding enters."""
    out = {}
    for r in rules:
        part, whole, held = F.col(r.part) * 100, F.col(r.whole), F.lit(True)
        if r.low is not None:
            held = held & (part >= whole * r.low)
        if r.high is not None:
            held = held & (part <= whole * r.high)
        out[r.name] = held
    return out


def judge(docs: DataFrame, rules=RULES, text: str = "text", min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """docs with all measures (long), base_failed, failed_rules (names) and kept.

    base_failed: fewer than min_words words, or over max_repeat per cent of them in
    repeated windows. kept: not base_failed, and no rule of the table failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = {k: v.cast("long").alias(k) for k, v in measures(text).items()}
    added = {"_words", "_lines", "base_failed", "failed_rules", "kept", *whole}
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    split = docs.withColumns({"_words": F.array_remove(F.split(t, f"{SPACE}+"), ""), "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    measured = split.select(*own, *whole.values())
    failed = F.array_compact(F.array(*(F.when(~held, F.lit(name)) for name, held in compiled(rules).items())))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    return measured.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    def bounds(r: Rule) -> list[str]:
        return [f"100 * {r.part} >= {r.low} * {r.whole}"] * (r.low is not None) + [f"100 * {r.part} <= {r.high} * {r.whole}"] * (r.high is not None)

    rules = " AND ".join(x for r in RULES for x in bounds(r))
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(i - p, 8))) AS n FROM
      (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims,
        len(list_filter(words, lambda x: lower(rtrim(x, '.,;:!?')) IN ({stops}))) AS n_stop_words,
        len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        len(list_filter(lines, lambda x: suffix(x, '...') OR suffix(x, chr(8230)))) AS n_ellipsis_lines,
        len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*' || chr(8226) || ']'))) AS n_bullet_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM b"""


ORACLE_SQL = _sql()
