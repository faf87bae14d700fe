"""All registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "A09_common_word"
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    _QUERIES[name] = query
    if oracle is not None:
        _ORACLES[name] = oracle


def queries() -> dict[str, Query]:
    load()
    return _QUERIES


def oracles() -> dict[str, str]:
    load()
    return _ORACLES


def load() -> None:
    """Import all modules that register queries."""
    from lamplight.plans import audit_queries, dialogue_queries, excerpt_queries, finding_queries, judging_queries, more_queries, quote_queries, repetition_queries, report_queries, scalar_queries, state_queries, story_queries, thrash_queries  # noqa: F401
