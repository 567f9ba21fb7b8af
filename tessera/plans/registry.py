"""Registered queries of the linkage engine and their SQL oracles."""

from __future__ import annotations

from tessera.plans import queries as linkage

FLAGSHIP = "er_block_reserved_topk"


def queries() -> dict:
    return linkage.queries()


def oracle_sql() -> dict[str, str]:
    return linkage.oracle_sql()
