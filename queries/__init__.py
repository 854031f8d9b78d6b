"""Registered queries and their SQL counterparts, by family."""

from __future__ import annotations

from queries import q_analysis, q_corpus, q_dialect, q_lexicon, q_scan

FAMILIES = (q_corpus, q_scan, q_lexicon, q_dialect, q_analysis)


def all_queries() -> dict:
    return {name: fn for family in FAMILIES for name, fn in family.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
