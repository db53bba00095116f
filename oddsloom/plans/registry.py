"""Named queries over the supplied tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from oddsloom.session import prepare


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame`; `covers` lists the inventory ids it exercises."""

    def keep(fn):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            from oddsloom.plans.analogs import Tables

            return fn(Tables(prepare(spark), sf_dir))

        build.__name__ = name
        CATALOG[name] = Query(name, tuple(covers.split()), build, sql)
        return fn

    return keep
