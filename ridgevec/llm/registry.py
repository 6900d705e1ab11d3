"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from ridgevec.llm import clusters, leaks, neighbours, spam, tokenize


def queries() -> dict:
    return {
        "p1_found": clusters.p1_found,
        "p1_clusters": clusters.p1_clusters,
        "p1_leaves": clusters.p1_leaves,
        "p3_found": neighbours.p3_found,
        "p3_neighbours": neighbours.p3_neighbours,
        "p3_similar": neighbours.p3_similar,
        "p6_ids": tokenize.p6_ids,
        "p6_roundtrip": tokenize.p6_roundtrip,
        "p7_found": leaks.p7_found,
        "p7_items": leaks.p7_items,
        "p8_found": spam.p8_found,
        "p8_scores": spam.p8_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {"p6_roundtrip": tokenize.ROUNDTRIP_SQL}
