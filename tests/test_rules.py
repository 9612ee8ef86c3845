"""Rules at the edges: absent values, ruin, ties of text ids, deep payloads, infinite values."""

import math

import pytest
from pyspark.sql import functions as F


def test_implied_goals_leave_an_absent_term_out(spark):
    from matchgrain.operators.markets import market_implied_goals

    rows = spark.createDataFrame([(1, 0.45, 0.27, 0.28, None), (2, 0.45, 0.27, 0.28, 0.5)], "fixture_id long, p_home double, p_draw double, p_away double, p_over_2_5 double")
    got = {r.fixture_id: r for r in market_implied_goals(rows).collect()}
    plain = market_implied_goals(rows.drop("p_over_2_5").where("fixture_id = 1")).first()
    assert (got[1].expected_home, got[1].expected_away) == (plain.expected_home, plain.expected_away)
    assert got[1].expected_home > 0.5 and got[2].expected_home > 0.5


def test_bankroll_stays_at_zero_after_ruin(spark):
    from matchgrain.operators.markets import StakeLimits, bankroll_backtest

    rows = spark.createDataFrame([(i, f"2024-01-0{i}", 0.99, 0.4, 2.0, i != 2) for i in (1, 2, 3)], "fixture_id long, day string, model_probability double, market_probability double, decimal_price double, won boolean")
    rows = rows.withColumn("kickoff_utc", F.to_timestamp("day"))
    all_in = StakeLimits(scopes={"bet": 1.0, "fixture": 1.0, "team": 1.0, "league": 1.0}, kelly_share=1.0)
    sure = rows.withColumn("model_probability", F.lit(0.999999))
    got = [r.bankroll for r in bankroll_backtest(sure, all_in, cost=0.5).orderBy("fixture_id").collect()]
    assert got[0] > 0 and got[1:] == [0.0, 0.0]
    with pytest.raises(ValueError, match="no limit"):
        StakeLimits(scopes={"bet": 0.1})
    with pytest.raises(ValueError, match="one bet"):
        StakeLimits(scopes={"bet": 0.2, "fixture": 0.1, "team": 0.3, "league": 0.3})


def test_storylines_take_text_ids(spark):
    from matchgrain.operators.windows import storylines

    rows = spark.createDataFrame([("fx:b", "scheduled", 3.0), ("fx:a", "final", 3.0), ("fx:c", "final", None)], "fixture_id string, status string, rating_move double")
    assert [(r.fixture_id, r.value) for r in storylines(rows).collect()] == [("fx:a", 3.0)]


def test_official_records_at_any_depth(spark):
    from matchgrain.sources.payloads import extract_official_records

    match = '{"home": "A", "away": "B", "referee": "R", "var": "V"}'
    deep = match
    deep = '{"fixtures": [' + match + ']}'
    for name in "abcdefgh":
        deep = '{"%s": %s}' % (name, deep)
    rows = spark.createDataFrame([('{"matches": [' + match + "]}",), (deep,), ("not json",), (None,)], "payload string")
    got = extract_official_records(rows).collect()
    assert [(r.HomeTeam, r.Referee, r.VAR, r.AVAR) for r in got] == [("A", "R", "V", None)] * 2


def test_ranks_and_drift_with_infinite_values(spark):
    from matchgrain.operators.evaluation import population_stability_index
    from matchgrain.operators.ranks import with_ranks

    values = [(1, 1.0), (2, math.inf), (3, -math.inf), (4, None), (5, 2.0)]
    frame = spark.createDataFrame(values, "k long, v double")
    got = {r.k: r.r for r in with_ranks(frame, {"r": "v"}).collect()}
    assert got == {3: 1.0, 1: 2.0, 5: 3.0, 2: 4.0, 4: None}
    numbers = spark.createDataFrame([(float(i % 50),) for i in range(500)] + [(math.inf,), (None,)], "v double")
    assert population_stability_index(numbers, numbers, "v").first().psi == 0.0


def test_decay_with_a_short_half_life(spark):
    from matchgrain.operators.joins import action_features_at_kickoff

    fixtures = spark.createDataFrame([(1, "2000-01-01", 1, 2), (2, "2000-01-06", 1, 2), (3, "2024-01-01", 1, 2)], "fixture_id long, day string, home_team_id long, away_team_id long")
    fixtures = fixtures.withColumn("kickoff_utc", F.to_timestamp("day"))
    past = spark.createDataFrame([(1, 1, 4.0, 2), (2, 1, 1.0, 2)], "fixture_id long, team_id long, action_value double, actions long")
    past = past.join(fixtures.select("fixture_id", F.col("kickoff_utc").alias("observed_at")), "fixture_id")
    got = {(r.fixture_id, r.side): r.lagged_action_value_per_action for r in action_features_at_kickoff(past, fixtures, half_life_days=5.0).collect()}
    assert got[1, "home"] is None and got[2, "home"] == 2.0 and got[3, "away"] is None
    assert abs(got[3, "home"] - (4.0 * 0.5 + 1.0) / (2 * 0.5 + 2)) < 1e-9
