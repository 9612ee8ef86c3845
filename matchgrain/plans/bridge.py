"""Match-shaped views of the provided tables, as lazy DataFrames.

A customer plays the part of a team, a nation of a league, an order of a fixture.
Every view is rebuilt from the tables it reads, so its size follows theirs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrain.functions.storage import stored_once
from matchgrain.operators.ordered import prior_totals

CUSTOMER_BUCKET = 65536


def shifted(ts: str, *, days=None, minutes=None):
    days = F.lit(0) if days is None else days.cast("int")
    minutes = F.lit(0) if minutes is None else minutes.cast("int")
    return F.col(ts) + F.make_dt_interval(days, F.lit(0), minutes, F.lit(0))


class Bridge:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def customers(self) -> DataFrame:
        base = self.table("customer").select("c_custkey", "c_nationkey")
        placed = prior_totals(
            base,
            ["c_nationkey"],
            ["c_custkey"],
            F.floor(F.col("c_custkey") / CUSTOMER_BUCKET),
            position="pos",
        )
        sizes = base.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
        return placed.join(sizes, "c_nationkey").withColumn("pos", F.col("pos") - 1)

    def stored(self, name: str, build) -> DataFrame:
        return stored_once(self.spark, f"{self.sf_dir}|{name}", build)

    @cached_property
    def matches(self) -> DataFrame:
        """The canonical match table; written once per session, as a real one would be."""
        return self.stored("matches", self._matches)

    def _matches(self) -> DataFrame:
        home = self.customers.where("n >= 2")
        away = self.customers.select(
            F.col("c_custkey").alias("away_team_id"),
            F.col("c_nationkey").alias("league_id"),
            F.col("pos").alias("away_pos"),
        )
        key = F.col("o_orderkey")
        done = F.col("o_orderstatus") != "O"
        return (
            self.table("orders")
            .join(home, F.col("o_custkey") == F.col("c_custkey"))
            .withColumn("league_id", F.col("c_nationkey"))
            .withColumn("away_pos", (F.col("pos") + 1 + key % (F.col("n") - 1)) % F.col("n"))
            .join(away, ["league_id", "away_pos"])
            .select(
                key.alias("fixture_id"),
                "league_id",
                F.concat(
                    F.lit("L"), F.col("league_id").cast("string"), F.lit(":"),
                    F.year("o_orderdate").cast("string"),
                ).alias("edition_id"),
                shifted("o_orderdate", minutes=key % 1440).alias("kickoff_utc"),
                F.col("c_custkey").alias("home_team_id"),
                "away_team_id",
                F.when(done, F.floor("o_totalprice") % 5).cast("bigint").alias("home_goals"),
                F.when(done, F.floor(F.col("o_totalprice") / 7) % 4).cast("bigint").alias("away_goals"),
                F.when(done, F.lit("completed")).otherwise(F.lit("scheduled")).alias("status"),
            )
        )

    @cached_property
    def completed(self) -> DataFrame:
        return self.matches.where(F.col("home_goals").isNotNull())

    @cached_property
    def quotes(self) -> DataFrame:
        return self.stored("quotes", self._quotes)

    def _quotes(self) -> DataFrame:
        raw = (
            self.table("lineitem")
            .repartition("l_orderkey")  # as the join with the matches wants them
            .groupBy(
                F.col("l_orderkey").alias("fixture_id"),
                (F.col("l_suppkey") % 5).alias("bookmaker"),
                F.col("l_linenumber").alias("ln"),
            )
            .agg(F.max("l_quantity").alias("q"))
        )
        joined = raw.join(self.matches.select("fixture_id", "kickoff_utc"), "fixture_id")
        q = F.col("q")

        def selection(name, share):
            return F.struct(
                F.lit(name).alias("selection"), (F.lit(1.0) / (F.lit(1.05) * share)).alias("decimal_price")
            )

        return joined.select(
            "fixture_id",
            F.lit("1x2").alias("market"),
            "bookmaker",
            shifted("kickoff_utc", days=F.col("ln") - 8).alias("observed_at"),
            F.inline(
                F.array(
                    selection("home", q / 71.0),
                    selection("draw", F.lit(20.0) / 71.0),
                    selection("away", (F.lit(51.0) - q) / 71.0),
                )
            ),
        ).select("fixture_id", "market", "selection", "bookmaker", "observed_at", "decimal_price")

    @cached_property
    def forecasts(self) -> DataFrame:
        a = F.lit(1.0) + F.col("home_team_id") % 7
        b = F.lit(1.0) + F.col("fixture_id") % 3
        c = F.lit(1.0) + F.col("fixture_id") % 5
        gap = F.col("home_goals") - F.col("away_goals")
        return self.matches.select(
            "fixture_id",
            "league_id",
            "edition_id",
            "kickoff_utc",
            shifted("kickoff_utc", days=F.lit(-1)).alias("issued_at"),
            F.concat(F.lit("m"), (F.col("fixture_id") % 2).cast("string")).alias("model_id"),
            (a / (a + b + c)).alias("p_home"),
            (b / (a + b + c)).alias("p_draw"),
            (c / (a + b + c)).alias("p_away"),
            F.when(gap > 0, 0).when(gap == 0, 1).when(gap < 0, 2).alias("target"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        return self.forecasts.where(F.col("target").isNotNull())

    @cached_property
    def rates(self) -> DataFrame:
        """Goal rates per fixture for the score-grid operators."""
        return self.matches.select(
            "fixture_id",
            "home_goals",
            "away_goals",
            (F.lit(0.8) + (F.col("home_team_id") % 11) / F.lit(10.0)).alias("home_rate"),
            (F.lit(0.6) + (F.col("away_team_id") % 9) / F.lit(10.0)).alias("away_rate"),
        )

    @cached_property
    def shots(self) -> DataFrame:
        return self.stored("shots", self._shots)

    def _shots(self) -> DataFrame:
        return (
            self.table("lineitem")
            .repartition("l_orderkey")  # the shots of a fixture lie together
            .groupBy(F.col("l_orderkey").alias("fixture_id"), F.col("l_linenumber").alias("shot_no"))
            .agg(
                (F.max("l_discount") * 5).alias("xg"),
                (F.max("l_tax") * 10).alias("xgot"),
                F.max("l_returnflag").alias("situation"),
                F.max("l_quantity").alias("distance"),
            )
            .withColumn("is_home", F.col("shot_no") % 2 == 0)
        )

    @cached_property
    def team_shots(self) -> DataFrame:
        """Shots with the team that took them and the fixture's kickoff."""
        m = self.matches.select(
            "fixture_id", "league_id", "kickoff_utc", "home_team_id", "away_team_id"
        )
        return self.shots.join(m, "fixture_id").withColumn(
            "team_id", F.when(F.col("is_home"), F.col("home_team_id")).otherwise(F.col("away_team_id"))
        )

    @cached_property
    def matches_xg(self) -> DataFrame:
        """Completed matches with summed shot xG and shot counts per side; written once, as its readers check and count it before they use it."""
        return self.stored("matches_xg", self._matches_xg)

    def _matches_xg(self) -> DataFrame:
        sides = self.shots.groupBy("fixture_id").agg(
            F.sum(F.when(F.col("is_home"), F.col("xg")).otherwise(0.0)).alias("home_xg"),
            F.sum(F.when(~F.col("is_home"), F.col("xg")).otherwise(0.0)).alias("away_xg"),
            F.count_if("is_home").alias("home_shots"),
            F.count_if(~F.col("is_home")).alias("away_shots"),
        )
        return self.completed.join(sides, "fixture_id", "left")

    @cached_property
    def tenures(self) -> DataFrame:
        k = F.col("k")
        base = self.table("customer").select(
            F.col("c_custkey").alias("team_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
        ).withColumn("origin", F.to_timestamp_ntz(F.lit("1995-07-01 00:00:00")))
        return base.select(
            "team_id",
            (F.col("team_id") * 10 + k).alias("manager_id"),
            shifted("origin", days=k * 730).alias("effective_from"),
            F.when(k < 3, shifted("origin", days=(k + 1) * 730)).alias("effective_to"),
            shifted("origin", days=k * 730 - 3).alias("observed_at"),
        )

    @cached_property
    def aliases(self) -> DataFrame:
        key = F.col("c_custkey")
        origin = F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))
        return self.table("customer").select(
            F.concat(F.lit("p"), (key % 3).cast("string")).alias("provider"),
            F.upper("c_name").alias("external_name"),
            key.alias("team_id"),
            F.when(key % 2 == 0, origin).alias("valid_from"),
            F.when(
                key % 2 == 0,
                origin + F.make_dt_interval((F.lit(365) + key % 100).cast("int"), F.lit(0), F.lit(0), F.lit(0)),
            ).alias("valid_to"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        return self.team_shots.select(
            "fixture_id",
            "team_id",
            (F.col("fixture_id") * 10 + F.col("shot_no")).alias("action_id"),
            (F.col("xg") - 0.1).alias("action_value"),
            shifted("kickoff_utc", minutes=F.col("shot_no")).alias("observed_at"),
        )

    @cached_property
    def opportunities(self) -> DataFrame:
        """One home-win betting opportunity per fixture and book, at its last price."""
        last = (
            self.quotes.where(F.col("selection") == "home")
            .groupBy("fixture_id", "bookmaker")
            .agg(F.max_by("decimal_price", "observed_at").alias("decimal_price"))
        )
        m = self.matches.select(
            "fixture_id", "league_id", "edition_id", "kickoff_utc",
            F.col("home_team_id").alias("team_id"), "home_goals", "away_goals",
        )
        f = self.forecasts.select("fixture_id", F.col("p_home").alias("model_probability"))
        return (
            last.join(m, "fixture_id")
            .join(f, "fixture_id")
            .select(
                "fixture_id", "bookmaker", "team_id", "league_id", "edition_id", "kickoff_utc",
                "model_probability",
                (F.lit(1.0) / (F.lit(1.05) * F.col("decimal_price"))).alias("market_probability"),
                "decimal_price",
                (F.col("fixture_id") % 11 != 0).alias("quote_is_fresh"),
                (F.col("fixture_id") % 7 != 0).alias("uncertainty_passed"),
                (F.col("fixture_id") % 13 != 0).alias("calibration_passed"),
                (F.col("home_goals") > F.col("away_goals")).alias("won"),
            )
        )
