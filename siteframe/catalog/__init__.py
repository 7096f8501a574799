"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from siteframe.core import ship
from siteframe.domain import Domain, expand

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SECTIONS = ("ingest", "objects", "layout", "images", "segments", "measures", "maps", "tools")


def query(name: str, oracle: str | None = None):
    """Register ``fn(domain) -> DataFrame`` under `name`."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Domain(ship(spark), folder))
        if oracle is not None:
            ORACLES[name] = expand(oracle)
        return fn
    return register


def load() -> None:
    for section in _SECTIONS:
        import_module(f"siteframe.catalog.{section}")
