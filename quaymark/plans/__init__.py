"""The registered queries of this engine: importing this package fills the registry."""

from . import aggregates, audit, changes, decisions, filters, functions, imports, joins, news, pages, series, sets, signals, streams, text  # noqa: F401
from .bindings import ctes
from .registry import QUERIES, SQL


def oracle() -> dict[str, str]:
    return {name: ctes(sql) for name, sql in SQL.items()}
