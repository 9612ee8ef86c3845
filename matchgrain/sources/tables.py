"""History files, tables by format, atomic writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrain.functions.contracts import require

# Short source codes and the long names used everywhere else.
HISTORY_NAMES = {
    "Div": "Division", "Date": "MatchDate", "Time": "KickoffTime", "FTHG": "FullTimeHomeGoals", "FTAG": "FullTimeAwayGoals",
    "FTR": "FullTimeResult", "HTHG": "HalfTimeHomeGoals", "HTAG": "HalfTimeAwayGoals", "HTR": "HalfTimeResult", "HS": "HomeShots",
    "AS": "AwayShots", "HST": "HomeShotsOnTarget", "AST": "AwayShotsOnTarget", "HC": "HomeCorners", "AC": "AwayCorners", "HF": "HomeFouls",
    "AF": "AwayFouls", "HY": "HomeYellowCards", "AY": "AwayYellowCards", "HR": "HomeRedCards", "AR": "AwayRedCards",
}
HISTORY_REQUIRED = ("MatchDate", "HomeTeam", "AwayTeam", "FullTimeHomeGoals", "FullTimeAwayGoals", "FullTimeResult")
INTEGER_CODES = {"FTHG", "FTAG", "HTHG", "HTAG", "HS", "AS", "HST", "AST", "HC", "AC", "HF", "AF", "HY", "AY", "HR", "AR"}


def read_history(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A1: tab-separated history with a header; text is read as is and counts are cast.

    Only the header line decides the schema, so no inference pass over the data is made.
    """
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    typed = raw.select(*[F.col(f"`{c}`").try_cast("int").alias(c) if c in INTEGER_CODES else F.col(f"`{c}`") for c in raw.columns])
    named = typed.withColumnsRenamed(HISTORY_NAMES)
    require(named, HISTORY_REQUIRED, "history columns")
    return named


def write_history(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def union_seasons(seasons: Mapping[str, DataFrame], league: str) -> DataFrame:
    """A2: stacked seasons with differing columns, a season and a league tag, dates parsed.

    A season without the required columns is skipped; none left is an error.
    """
    from matchgrain.functions.scalars import parse_match_dates

    good = {k: df for k, df in seasons.items() if set(HISTORY_REQUIRED) <= set(df.columns)}
    if not good:
        raise ValueError("No usable season")
    out = None
    for name, df in good.items():
        tagged = df.withColumn("MatchDate", parse_match_dates("MatchDate")).withColumn("SeasonFile", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.withColumn("League", F.lit(league))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A3: parquet, csv, tsv, json or jsonl by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == "parquet":
        return reader.parquet(path)
    if suffix in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="\t" if suffix == "tsv" else ",", inferSchema=schema is None)
    if suffix == "jsonl":
        return reader.json(path)
    if suffix == "json":
        df = reader.json(path, multiLine=True)
        if df.columns == ["_corrupt_record"]:
            raise ValueError(f"JSON is not tabular: {path}")
        return df
    raise ValueError(f"Unsupported table format: {suffix!r}")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> int:
    """A4: parquet through the commit protocol, so readers never see half a table; returns the row count."""
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    observed.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return int(seen.get["rows"])


def prepare_history(history: DataFrame, *, league: str, zone: str, start_month: int = 7) -> DataFrame:
    """File rows to canonical matches: dates, UTC kickoff, ids, season."""
    from matchgrain.functions import scalars as S

    rows = S.completed_match_rows(history)
    clock = F.col("KickoffTime") if "KickoffTime" in history.columns else F.lit(None).cast("string")
    rows = rows.withColumn("kickoff_utc", S.kickoff_utc("MatchDate", clock, zone))
    team = lambda c: F.concat(F.lit(f"{league}:"), S.slug(c))
    season = S.season_id("kickoff_utc", zone, start_month)
    return rows.select(
        S.stable_fixture_id(F.concat(F.lit(f"{league}:"), season), F.lit("history"), F.concat_ws(":", F.date_format("kickoff_utc", "yyyyMMdd'T'HHmm"), S.slug("HomeTeam"), S.slug("AwayTeam"))).alias("fixture_id"),
        F.concat(F.lit(f"{league}:"), season).alias("edition_id"), "kickoff_utc", team("HomeTeam").alias("home_team_id"), team("AwayTeam").alias("away_team_id"),
        F.col("FullTimeHomeGoals").cast("int").alias("home_goals"), F.col("FullTimeAwayGoals").cast("int").alias("away_goals"),
    )
