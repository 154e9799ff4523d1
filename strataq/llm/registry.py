"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from strataq.llm import embedding_dedup, exact_dedup, language, mixing, packing, secrets, simhash, suffix_dedup, toxicity, url_filter

_MODULES = [mixing, embedding_dedup, toxicity, suffix_dedup, exact_dedup, language, simhash, secrets, packing, url_filter]


def _each(kind):
    for m in _MODULES:
        name = next(n for n in vars(m) if n.startswith("op") and n[2].isdigit())
        yield name, m


def queries() -> dict:
    return {name: getattr(m, name) for name, m in _each("q")}


def oracle_sql() -> dict:
    return {name: m.SQL for name, m in _each("s") if getattr(m, "SQL", None)}
