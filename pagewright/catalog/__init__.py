"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import cjk, documents, events, geometry, headers, html, pages, regression, routing, tables, text

MODULES = (text, cjk, tables, pages, headers, routing, geometry, events, regression, html, documents)


def queries() -> dict:
    return {n: f for m in MODULES for n, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in MODULES for n, (_, s) in m.QUERIES.items() if s}
