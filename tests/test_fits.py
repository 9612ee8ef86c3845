"""Fits that settle or fail, and rows that a ledger refuses."""

import random

import pytest
from pyspark.sql import functions as F

from matchgrain.operators import ledger, models, ratings

MATCH = "fixture_id long, league_id long, home_team_id long, away_team_id long, home_goals int, away_goals int, day int"


def matches(spark, n=160, teams=8):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        h, a = rng.sample(range(teams), 2)
        rows.append((i, 1, h, a, min(6, int(rng.expovariate(1 / (1.2 + 0.2 * h)))), min(6, int(rng.expovariate(1 / (1 + 0.1 * a)))), i))
    return spark.createDataFrame(rows, MATCH).select("*", F.lit("e1").alias("edition_id"), F.timestamp_seconds(F.col("day") * 86400).alias("kickoff_utc"))


def test_a_repeated_fixture_id_is_refused(spark):
    df = matches(spark, 20)
    assert ledger.team_events(df).count() == 40 and ledger.team_events(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="one fixture id"):
        ledger.team_events(df.unionAll(df.limit(1))).collect()


def test_goal_strengths_settle(spark):
    df = matches(spark)
    got = {r.team_id: r for r in ratings.team_goal_strengths(df, half_life_days=1e9).collect()}
    assert len(got) == 8 and all(r.residual <= 1e-6 for r in got.values())
    rows = [r for r in df.collect() if r.day < 159]
    base = got[0].base
    for t, r in got.items():  # the fixed point: each factor follows from the others
        sides = [(x.home_goals, x.away_goals, x.away_team_id, 1.0) for x in rows if x.home_team_id == t] + [(x.away_goals, x.home_goals, x.home_team_id, 0.0) for x in rows if x.away_team_id == t]
        expected = sum(base * (r.home_effect if at_home else 1.0) * got[o].defense for _, _, o, at_home in sides)
        assert r.attack == pytest.approx((sum(g for g, *_ in sides) + 4) / (expected + 4), abs=1e-5)
        against = sum(base * (1.0 if at_home else r.home_effect) * got[o].attack for _, _, o, at_home in sides)
        assert r.defense == pytest.approx((sum(g for _, g, *_ in sides) + 4) / (against + 4), abs=1e-5)
    with pytest.raises(RuntimeError, match="still move"):
        ratings.team_goal_strengths(df, most_iterations=1)
    with pytest.raises(ValueError, match="too few"):
        ratings.team_goal_strengths(df.limit(1))


def test_pairings_stay_where_they_are(spark, monkeypatch):
    plans, cut = [], ratings.rewritten
    monkeypatch.setattr(ratings, "PART_MATCHES", 60)
    monkeypatch.setattr(ratings, "rewritten", lambda d: (plans.append(d._jdf.queryExecution().executedPlan().toString()) if "_m" in d.columns else None) or cut(d))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many teams
    try:
        df = matches(spark).unionByName(matches(spark, 40, 5).withColumns({"league_id": F.lit(2).cast("long"), "fixture_id": F.col("fixture_id") + 1000}))
        ratings.team_goal_strengths(df, half_life_days=1e9, tolerance=0.01)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
    assert len(plans) > 1
    for plan in plans:
        lines = plan.splitlines()
        scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line]
        assert scans
        for i in scans:  # between the pairings and their join or grouping nothing is shuffled
            while "SortMergeJoin" not in lines[i] and "HashAggregate" not in lines[i]:
                assert "Exchange" not in lines[i]
                i -= 1
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before[1]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("dealt_")]


def test_covariate_fit_keeps_to_the_cutoff(spark):
    df = matches(spark).withColumns({"home_rank": F.col("home_team_id").cast("double"), "away_rank": F.col("away_team_id").cast("double")})
    at = F.timestamp_seconds(F.lit(100 * 86400))
    changed = df.withColumn("home_goals", F.when(F.col("day") >= 100, 50).otherwise(F.col("home_goals")))
    rates = [
        [tuple(r) for r in models.rank_covariate_rates(models.rank_covariate_fit(d, ["rank_difference"], cutoff=at), d.where("day >= 100")).select("fixture_id", "home_rate", "away_rate").orderBy("fixture_id").collect()]
        for d in (df, changed)
    ]
    assert rates[0] == rates[1] and len(rates[0]) == 60 and all(h >= 1e-6 and a >= 1e-6 for _, h, a in rates[0])
    with pytest.raises(ValueError, match="too few"):
        models.rank_covariate_fit(df, ["rank_difference"], cutoff=F.timestamp_seconds(F.lit(3 * 86400)))
