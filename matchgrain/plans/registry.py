"""Registry of named queries and the DuckDB text that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register `fn(bridge) -> DataFrame`; `uses` names the bridge views of `sql`."""

    def wrap(fn: Callable) -> Callable:
        from matchgrain.plans.bridge import Bridge
        from matchgrain.plans.bridge_sql import with_views

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark, sf_dir: str) -> DataFrame:
            return fn(Bridge(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, uses.split())
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double; both sides of a check do the same."""
    from pyspark.sql import functions as F

    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
