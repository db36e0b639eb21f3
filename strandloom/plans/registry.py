"""Named queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .contact_queries import register as _contacts
from .source_queries import register as _sources
from .structure_queries import register as _structures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


_contacts(_add)
_structures(_add)
_sources(_add)
