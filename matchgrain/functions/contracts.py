"""Column contracts checked on the driver, and row guards checked inside the job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, columns: Iterable[str], what: str = "columns") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing {what}: {missing}")


def first_present(df: DataFrame, *names: str) -> str | None:
    """The first of several alternative column names that the table has."""
    return next((name for name in names if name in df.columns), None)


def guard(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Fail the job on the first row that breaks `ok` (null counts as broken)."""
    broken = F.raise_error(F.lit(message)).cast("boolean")
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(broken))


def seconds(ts) -> Column:
    """Epoch seconds with fraction; timestamps are UTC instants (session zone UTC)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)


def days_between(later, earlier) -> Column:
    return (seconds(later) - seconds(earlier)) / F.lit(86400.0)
