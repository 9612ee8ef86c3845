"""Registered queries against their SQL on the smallest tables, for a cross-section."""

import os
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = [
    "d1_league_table", "w3_prior_team_state", "w12_walk_forward_rates", "c6_manager_at_kickoff", "c15_action_features_at_kickoff", "d5_market_movement",
    "g7_goal_market_ladder", "w20_bankroll_backtest", "v6_cohort_metrics", "a24_extract_table_rows", "t2_stream_ledger_append",
]


def test_every_oracle_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
    from __spark_entry__ import oracle_sql, queries
    from check_oracle import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, cur.fetchall())
    assert sorted(map(str, a)) == sorted(map(str, b))


def forecasts(spark, *rows):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, "fixture_id long, issued_at string, model_id string, kickoff_utc string, p_home double")
    return table.withColumns({c: F.to_timestamp(c) for c in ("issued_at", "kickoff_utc")})


def test_late_stream_rows_go_to_quarantine(spark, tmp_path):
    from matchgrain.streaming.streams import LedgerAppender

    rows = forecasts(spark, (1, "2024-01-01", "m", "2024-01-02", 0.5), (2, "2024-01-03", "m", "2024-01-02", 0.5))
    write = LedgerAppender(spark, str(tmp_path))
    write(rows, 0)
    write(rows.where("fixture_id = 1"), 1)
    assert [r.fixture_id for r in write.ledger().collect()] == [1]
    assert [r.fixture_id for r in spark.read.parquet(f"{tmp_path}/quarantine/batch=0").collect()] == [2]


def test_ledger_stream_keeps_history_over_gaps_and_fails_on_conflicts(spark, tmp_path):
    from matchgrain.streaming.streams import LedgerAppender

    write = LedgerAppender(spark, str(tmp_path))
    write(forecasts(spark, (1, "2024-01-01", "m", "2024-01-02", 0.5), (1, "2024-01-01", "m", "2024-01-02", 0.5)), 0)
    write(forecasts(spark, (2, "2024-01-01", "m", "2024-01-02", 0.5), (1, "2024-01-01", "m", "2024-01-02", 0.5)), 2)
    write(forecasts(spark, (2, "2024-01-01", "m", "2024-01-02", 0.5)), 2)  # a replay
    write(forecasts(spark, (3, "2024-01-05", "m", "2024-01-06", 0.5)), 5)
    assert sorted(r.fixture_id for r in write.ledger().collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="immutable"):
        write(forecasts(spark, (1, "2024-01-01", "m", "2024-01-02", 0.6)), 6)
    with pytest.raises(Exception, match="duplicate"):
        write(forecasts(spark, (9, "2024-01-01", "m", "2024-01-02", 0.6), (9, "2024-01-01", "m", "2024-01-02", 0.7)), 7)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from matchgrain.functions import storage

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())
