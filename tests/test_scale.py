"""Steps that must not sort, shuffle or hold on the heap what grows with the cells or keys."""

import pytest
from pyspark.sql import functions as F

from matchgrain.operators import grids

RATES = "fixture_id long, home_rate double, away_rate double, rho double, shared_rate double, dispersion double, home_goals long, away_goals long"


@pytest.fixture
def rates(spark):
    return spark.createDataFrame([(1, 1.5, 1.1, -0.1, 0.2, 6.0, 1, 0), (2, 0.9, 1.3, -0.1, 0.2, 6.0, 2, 2), (2, 1.2, 0.7, -0.1, 0.2, 6.0, 0, 1), (None, 1.0, 1.0, -0.1, 0.2, 6.0, 1, 1)], RATES)


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("grid", [grids.dixon_coles_grid, grids.bivariate_poisson_grid, grids.negative_binomial_grid])
def test_a_grids_mass_is_known_before_its_cells(rates, grid):
    text = plan(grid(rates))
    assert "Window" not in text[: text.rindex("Generate")]  # parents come first
    mass = {r.fixture_id: (r.m, r.t) for r in grid(rates).groupBy("fixture_id").agg(F.sum("p").alias("m"), F.max("tail").alias("t")).collect()}
    assert set(mass) == {1, 2, None}
    assert mass[1][0] + mass[1][1] == pytest.approx(1, abs=1e-9)
    assert mass[2] == pytest.approx((1, 0))  # rows of one key are one grid, scaled to one


def test_sums_of_a_grid_come_back_by_a_hash_join(rates):
    grid = grids.poisson_grid(rates)
    got = grids.diagonal_inflated_grid(grid, 0.2)
    assert "ShuffledHashJoin" in plan(got)
    key = ["fixture_id"]
    before, after = ({r.fixture_id: r.m for r in g.groupBy(*key).agg(F.sum("p").alias("m")).collect()} for g in (grid, got))
    assert set(after) == {1, 2, None} and all(after[k] == pytest.approx(v) for k, v in before.items())


def test_observed_scores_and_lines_are_the_hashed_side(rates):
    import math

    grid = grids.poisson_grid(rates.where("home_rate in (1.5, 0.9)"))
    lines = rates.select("fixture_id", F.lit(2.25).alias("line"), F.lit(2.0).alias("price")).where("fixture_id = 1")
    seen, value = grids.scoreline_ignorance(grid, rates), grids.expected_over_net_return(grid, lines)
    for df in (seen, value):
        assert "ShuffledHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)
    ignorance = {r.fixture_id: r.ignorance for r in seen.collect()}
    assert ignorance[1] == pytest.approx(2.6 - math.log(1.5))
    p = [math.exp(-2.6) * 2.6**k / math.factorial(k) for k in range(3)]
    want = (1 - sum(p)) - p[0] - p[1] - 0.5 * p[2]
    assert [(r.line, r.expected_net_return) for r in value.collect()] == [(2.25, pytest.approx(want, abs=1e-8))]
    with pytest.raises(Exception, match="quarter-goal"):
        grids.expected_over_net_return(grid, lines.withColumn("line", F.lit(2.1))).collect()


def test_com_poisson_weights_take_each_logarithm_once(rates):
    text = grids.com_poisson_grid(rates)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in text.lower()  # goals are spelled out, not walked by an interpreted lambda
    one = grids.com_poisson_grid(rates.where("fixture_id = 1").withColumn("dispersion", F.lit(1.0)))
    assert one.where("home_goals = 1 AND away_goals = 0").first().p == pytest.approx(1.5 * 2.718281828459045**-2.6)


def test_stream_state_is_on_disk(spark, tmp_path):
    import pathlib

    from matchgrain.streaming.streams import latest_quotes, read_stream, run_to_table

    rows = spark.sql("SELECT 1L AS fixture_id, '1x2' AS market, 'home' AS selection, 'b' AS bookmaker, TIMESTAMP '2024-01-01' AS observed_at, 2.0D AS decimal_price")
    kickoffs = spark.sql("SELECT 1L AS fixture_id, TIMESTAMP '2024-01-05' AS kickoff_utc")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows.write.parquet(source)
    run_to_table(latest_quotes(read_stream(spark, source, rows.schema), kickoffs), out, state, "update")
    assert [r.decimal_price for r in spark.read.parquet(out).collect()] == [2.0]
    assert "RocksDBStateStoreProvider" in (pathlib.Path(state) / "offsets" / "0").read_text()
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_stored_tables_are_not_dealt_out_anew(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from matchgrain.functions import storage

    def refuse(*args):
        raise AssertionError("a stored table is shuffled before it is written")

    monkeypatch.setattr(DataFrame, "repartition", refuse)
    monkeypatch.setattr(type(spark.range(1)), "repartition", refuse)
    assert storage.stored_once(spark, f"{tmp_path}|t", lambda: spark.range(7)).count() == 7


def test_shuffles_of_a_stored_table_do_not_outlive_it(spark, tmp_path):
    from matchgrain.functions import storage

    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    before, setting = files.getAllFiles().size(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    made = storage.stored_once(spark, f"{tmp_path}|d", lambda: spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
    assert files.getAllFiles().size() <= before and made.count() == 100
    assert spark.conf.get(setting) == "false"


def test_market_movement_deals_quotes_once(spark, monkeypatch):
    from matchgrain.operators.aggregates import market_movement
    from matchgrain.plans import q_aggs

    prices = {("home", 1, 1): 2.0, ("away", 1, 1): 2.0, ("home", 2, 1): 1.5, ("away", 2, 1): 4.5, ("home", 1, 2): 1.25, ("away", 1, 2): 5.0}
    rows = [(7, "ml", s, b, t, p) for (s, b, t), p in prices.items()] + [(7, "ml", "home", None, 3, 9.0), (None, "ml", "home", 1, 3, 9.0)]
    quotes = spark.createDataFrame(rows, "fixture_id long, market string, selection string, bookmaker long, t long, decimal_price double").withColumn("observed_at", F.timestamp_seconds("t")).drop("t")
    bridge = type("Tables", (), {"quotes": quotes})()
    fair = q_aggs.fair(bridge)
    assert fair.columns == ["fixture_id", "market", "bookmaker", "observed_at", "selection", "decimal_price", "fair_probability"] and fair.count() == 6
    got = market_movement(fair)
    seen = {r.selection: (r.opening_probability, r.current_probability, r.current_best_price, r.current_books, r.current_observed_at.timestamp()) for r in got.collect()}
    assert seen == {"home": pytest.approx((0.625, 0.8, 1.25, 1, 2)), "away": pytest.approx((0.375, 0.2, 5.0, 1, 2))}
    text = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    monkeypatch.setattr(q_aggs, "PART_QUOTES", 1)
    assert "REPARTITION_BY_NUM" in text and q_aggs.fair(bridge).rdd.getNumPartitions() == 8  # a part for each quote, not 4


def test_draws_do_not_multiply_what_is_shuffled(spark):
    from matchgrain.operators.ledger import league_table

    matches = spark.createDataFrame(
        [("e", 1, 1, 2, 1, 0), ("e", 2, 2, 3, None, None), ("e", 3, 3, 1, 2, 2), (None, 4, 4, 5, None, 1), ("f", 5, None, 2, 0, 3), ("f", 5, None, 2, 0, 3)],
        "edition_id string, fixture_id long, home_team_id long, away_team_id long, home_goals long, away_goals long",
    )
    values = F.sequence(F.lit(0), F.lit(2))
    goals = F.coalesce("home_goals", (F.col("fixture_id") + F.col("draw_id")) % 3), F.coalesce("away_goals", F.when(F.col("draw_id") < 2, F.col("draw_id")))
    keys = ["edition_id", "draw_id"]
    got = league_table(matches, keys=keys, draws=("draw_id", values), goals=goals)
    want = league_table(matches.withColumn("draw_id", F.explode(values)).withColumns({"home_goals": goals[0], "away_goals": goals[1]}), keys=keys)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 10
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("RepartitionByExpression" in part for part in text.split("Generate explode([0,1,2])")[1:])


def test_position_probabilities_shuffle_rows_once(spark):
    from matchgrain.operators import projections as P

    rows = [("e", d, t, float(10 * t + d), 1 + (t + d) % 3) for d in range(4) for t in range(3)] + [(None, 0, 1, 5.0, 1), ("e", 0, None, 5.0, 1), ("f", 0, 7, None, 1)]
    standings = spark.createDataFrame(rows, "edition_id string, draw_id long, team_id long, points double, position long")
    got = P.position_probabilities(standings, 4)
    found = {(r.edition_id, r.team_id, r.position): (r.probability, r.mean_points) for r in got.collect()}
    assert found[("e", 0, 1)] == (0.5, 1.5) and found[("e", 2, 2)] == (0.25, 21.5) and found[("f", 7, 1)] == (0.25, None) and len(found) == 10
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression") == 1 and "Join" not in text
    labels = spark.createDataFrame([("title", 1, 1), ("rest", 2, 1)], "label string, first_position long, last_position long")
    text = P.outcome_probabilities(got, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "position" in text[text.rindex("Aggregate [edition_id"):] and "scalar-subquery" in text[text.rindex("RepartitionByExpression"):]
    assert {(r.team_id, r.label): r.probability for r in P.outcome_probabilities(got, labels).where("edition_id = 'e'").collect()}[(1, "rest")] == 0.75


def test_action_summary_counts_actions_in_one_grouping(spark):
    from matchgrain.operators.aggregates import action_summary

    actions = spark.createDataFrame(
        [(1, 5, 10, 0.5, 100), (1, 5, 10, 0.5, 100), (1, 5, 11, 0.25, 160), (1, None, None, 1.0, 100), (2, 6, 12, 0.75, 200), (2, 6, 13, None, 220), (3, 7, 14, 1.0, 0), (None, 7, 14, 1.0, 0)],
        "fixture_id long, team_id long, action_id long, action_value double, s long",
    ).withColumn("observed_at", F.timestamp_seconds("s")).drop("s")
    fixtures = spark.createDataFrame([(1, 90), (2, 150), (2, 180)], "fixture_id long, s long").withColumn("kickoff_utc", F.timestamp_seconds("s"))
    got = action_summary(actions, fixtures)
    seen = {(r.fixture_id, r.team_id): (r.action_value, r.actions, r.observed_at.timestamp()) for r in got.collect()}
    assert seen == {(1, 5): (1.25, 2, 160), (1, None): (1.0, 0, 100), (2, 6): (1.5, 2, 220)}
    assert plan(got).count("Aggregate(keys=[") == 4  # two partial, two final: no pass for distinct actions
    for late in (fixtures.withColumn("kickoff_utc", F.timestamp_seconds(F.lit(101))), fixtures.withColumn("kickoff_utc", F.lit(None).cast("timestamp"))):
        with pytest.raises(Exception, match="predates"):
            action_summary(actions, late).collect()
