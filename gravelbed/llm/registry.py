"""Queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, maxent, mixing, pieces, quality_rules, repeats, simhash, surrogates, toxicity, warc

_QUERIES = {
    "op2_mixing": mixing.op2_mixing,
    "op9_pieces": pieces.op9_pieces,
    "op10_surrogates": surrogates.op10_surrogates,
    "op3_maxent": maxent.op3_maxent,
    "op4_warc": warc.op4_warc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op1_simhash": simhash.op1_simhash,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_suffix_dedup": repeats.op7_suffix_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
}

_SQL = {
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_quality_rules": quality_rules.ORACLE_SQL,
}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
