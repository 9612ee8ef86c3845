"""Prices, settlement, grids and scores: golden values and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchgrain.functions import scalars as S
from matchgrain.operators import evaluation as V
from matchgrain.operators import grids, ratings
from matchgrain.operators import markets as M


def book(spark, prices):
    rows = [(1, "1x2", 1, "t", s, p) for s, p in zip(("home", "draw", "away"), prices)]
    return spark.createDataFrame(rows, "fixture_id int, market string, bookmaker int, observed_at string, selection string, decimal_price double")


def test_multiplicative_golden(spark):
    got = {r.selection: r.fair_probability for r in M.devig_multiplicative(book(spark, (2.0, 3.0, 4.0))).collect()}
    assert got == pytest.approx({"home": 6 / 13, "draw": 4 / 13, "away": 3 / 13})


@pytest.mark.parametrize("method", ["power", "shin"])
def test_solved_devig(spark, method):
    rows = M.devig_solved(book(spark, (2.0, 3.4, 3.9)), method).collect()
    assert sum(r.fair_probability for r in rows) == pytest.approx(1)
    if method == "power":
        assert rows[0].parameter == pytest.approx(1.04917, abs=1e-5)
    assert all(r.fair_probability < 1 / r.decimal_price for r in rows)
    with pytest.raises(Exception):
        M.devig_solved(book(spark, (4.0, 4.0, 4.0)), method).collect()


def test_quarter_lines(spark):
    cases = [(3, 2.25, 1.0), (2, 2.25, -0.5), (2, 1.75, 0.5), (1, 1.75, -1.0)]
    df = spark.createDataFrame([(t, l, w) for t, l, w in cases], "t int, line double, want double")
    out = df.select("want", grids.over_net_return("t", "line", F.lit(2.0)).cast("double").alias("o"), grids.under_net_return("t", "line", F.lit(2.0)).cast("double").alias("u")).collect()
    for r in out:
        assert r.o == r.want and r.o == -r.u
    with pytest.raises(Exception):
        df.select(grids.over_net_return("t", F.lit(2.1), F.lit(2.0))).collect()


def test_grid_families_keep_their_mass(spark):
    r = spark.createDataFrame([(1, 1.5, 1.1, -0.1, 0.2, 6.0)], "fixture_id int, home_rate double, away_rate double, rho double, shared_rate double, dispersion double")
    for grid in (grids.poisson_grid(r), grids.dixon_coles_grid(r), grids.bivariate_poisson_grid(r), grids.negative_binomial_grid(r), grids.com_poisson_grid(r), grids.diagonal_inflated_grid(grids.poisson_grid(r), 0.2)):
        s = grid.agg(F.sum("p").alias("m"), F.max("tail").alias("t"), F.min("p").alias("low")).first()
        assert s.m + s.t == pytest.approx(1, abs=1e-9) and s.low >= 0
    ladder = grids.goal_market_ladder(grids.poisson_grid(r)).first()
    closed = r.select(*[c.alias(n) for n, c in grids.closed_form_goal_markets("home_rate", "away_rate").items()]).first()
    assert ladder.p_over_2_5 == pytest.approx(closed.Over2_5Prob, abs=1e-9) and ladder.p_btts_yes == pytest.approx(closed.BTTSYesProb, abs=1e-9)
    assert ladder.most_likely_score == closed.MostLikelyScore == "1-1"
    with pytest.raises(Exception):
        grids.poisson_grid(r.withColumn("home_rate", F.lit(0.0))).collect()


def test_implied_goals_recover_rates(spark):
    r = spark.createDataFrame([(1, 1.7, 0.9), (2, 0.8, 1.3)], "fixture_id int, home_rate double, away_rate double")
    p = grids.one_x_two(grids.poisson_grid(r))
    out = {x.fixture_id: (x.expected_home, x.expected_away) for x in M.market_implied_goals(p).collect()}
    assert out[1] == pytest.approx((1.7, 0.9), abs=0.02) and out[2] == pytest.approx((0.8, 1.3), abs=0.02)


def test_exposure_caps_against_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i // 3), int(i // 3 % 5), int(i % 2), float(p), 0.3, 3.5, True, True, True) for i, p in enumerate(rng.uniform(0.4, 0.6, 60))]
    df = spark.createDataFrame(rows, "fixture_id long, team_id long, league_id long, model_probability double, market_probability double, decimal_price double, quote_is_fresh boolean, uncertainty_passed boolean, calibration_passed boolean")
    got = M.exposure_caps(df, tie=["fixture_id", "model_probability"]).toPandas()
    for cap, by in ((0.015, ["league_id", "fixture_id"]), (0.025, ["league_id", "team_id"]), (0.05, ["league_id"])):
        assert got.groupby(by).stake_fraction.sum().max() <= cap + 1e-12
    assert got.groupby("league_id").stake_fraction.sum().tolist() == pytest.approx([0.05, 0.05])


def test_elo_walk_equals_plain_loop(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"fixture_id": range(80), "league_id": rng.integers(0, 2, 80), "home_team_id": rng.integers(0, 4, 80), "away_team_id": rng.integers(4, 8, 80), "home_goals": rng.integers(0, 5, 80), "away_goals": rng.integers(0, 4, 80)})
    pdf["kickoff_utc"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 2000, 80), unit="h")
    pdf["edition_id"] = np.where(pdf.kickoff_utc < pd.Timestamp("2024-02-10"), "s1", "s2")
    got = ratings.rating_history(spark.createDataFrame(pdf)).toPandas().set_index("fixture_id")
    for lg, part in pdf.sort_values(["kickoff_utc", "fixture_id"]).groupby("league_id"):
        book_, season = {}, None
        for m in part.itertuples():
            if season not in (None, m.edition_id):
                book_ = {t: 0.75 * r + 375.0 for t, r in book_.items()}
            season = m.edition_id
            h, a = book_.get(m.home_team_id, 1500.0), book_.get(m.away_team_id, 1500.0)
            e = 1 / (1 + 10 ** ((a - h - 55) / 400))
            s = 1.0 if m.home_goals > m.away_goals else 0.5 if m.home_goals == m.away_goals else 0.0
            gap = abs(m.home_goals - m.away_goals)
            c = 24 * (1 + 0.5 * math.log10(gap) if gap > 1 else 1.0) * (s - e)
            book_[m.home_team_id], book_[m.away_team_id] = h + c, a - c
            assert got.loc[m.fixture_id, "home_post"] == pytest.approx(h + c)


def scored(spark, n=120):
    rng = np.random.default_rng(4)
    p = rng.dirichlet((3, 2, 2), n)
    y = [int(rng.choice(3, p=x)) for x in p]
    rows = [(i, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).to_pydatetime(), *map(float, x), t) for i, (x, t) in enumerate(zip(p, y))]
    return spark.createDataFrame(rows, "fixture_id long, kickoff_utc timestamp, p_home double, p_draw double, p_away double, target int"), p, np.array(y)


def test_scores_equal_numpy(spark):
    df, p, y = scored(spark)
    r = V.proper_scores(df.withColumn("model_id", F.lit("m"))).first()
    o = np.eye(3)[y]
    assert r.log_loss == pytest.approx(-np.log(p[np.arange(len(y)), y]).mean()) and r.brier == pytest.approx(((p - o) ** 2).sum(1).mean())
    assert r.rps == pytest.approx(((np.cumsum(p, 1) - np.cumsum(o, 1))[:, :2] ** 2).sum(1).mean() / 2)


def test_bootstrap_interval_holds_the_mean(spark):
    df, _, _ = scored(spark)
    rows = df.withColumns(V.row_scores()).withColumn("uniform", F.lit(math.log(3)))
    a = V.paired_block_interval(rows, "uniform", "_log_loss", block_length=8, repetitions=300).first()
    b = V.paired_block_interval(rows.repartition(3), "uniform", "_log_loss", block_length=8, repetitions=300).first()
    assert a.lower < a.point < a.upper and tuple(a) == pytest.approx(tuple(b))
    with pytest.raises(ValueError):
        V.paired_block_interval(rows, "uniform", "_log_loss", block_length=0)


def test_risk_and_names(spark):
    one = spark.createDataFrame([("Saint-Étienne & Côte",)], "s string")
    assert one.select(S.normalize_name("s").alias("n"), S.slug("s").alias("g")).first()[:] == ("saint etienne and cote", "saint-etienne-and-cote")
    r = one.select(S.prediction_risk(F.lit(1 / 3), F.lit(1 / 3), F.lit(1 / 3)).alias("a"), S.prediction_risk(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("b")).first()
    assert r.a == pytest.approx(100) and r.b == pytest.approx(0, abs=1e-9)
    with pytest.raises(Exception):
        one.select(S.haversine_km(F.lit(91.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).collect()
