"""Registered queries, one module a family; ``registry`` holds them."""

from . import registry
from . import prices, metrics, timeaxis, joins, windows, ledger, text, linking, reports, quality, news, models, streams, sources  # noqa: E402,F401

queries, oracle_sql = registry.queries, registry.oracle_sql
