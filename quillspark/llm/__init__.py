"""Training-data operators.  Nothing else in the library imports this subpackage."""

from __future__ import annotations

from quillspark.llm import decontaminate, html, langid, lexical, lines, packing, pii, quality, resample, secrets, sharding, simhash, substring

_MODULES = (langid, secrets, html, decontaminate, substring, pii, sharding, simhash, quality, packing, lexical, lines, resample)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
