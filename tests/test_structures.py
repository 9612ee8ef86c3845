"""Mergeable fits, splitting trees, permutations and ranks against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrain.operators import evaluation, markets, ranks
from matchgrain.operators.isotonic import isotonic_pools, pooled
from matchgrain.operators.permute import permuted, row_numbers


def min_max_fit(points):
    """The fit at each point by its definition: the largest, over starts, of the least mean from there on."""
    ps = sorted(points)
    y, w = np.cumsum([0.0, *[points[p][0] for p in ps]]), np.cumsum([0.0, *[points[p][1] for p in ps]])
    least = [[min((y[b + 1] - y[a]) / (w[b + 1] - w[a]) for b in range(i, len(ps))) for i in range(a, len(ps))] for a in range(len(ps))]
    return {p: max(least[a][i - a] for a in range(i + 1)) for i, p in enumerate(ps)}


@pytest.mark.parametrize("kind", ["distinct", "ties", "rising", "falling", "restarts", "one", "none"])
def test_isotonic_fit_of_range_partitions(spark, kind):
    rng = random.Random(kind)
    n = {"one": 1, "none": 0, "ties": 600}.get(kind, 110)
    ps = [rng.random() if kind != "ties" else rng.randrange(20) / 20 for _ in range(n)]
    rate = {"rising": lambda p: p > 0.5, "falling": lambda p: p < 0.5, "restarts": lambda p: rng.random() < p * 4 % 1}.get(kind, lambda p: rng.random() < p)
    rows = [(p, bool(rate(p))) for p in ps]
    points = {}
    for p, y in rows:
        a, b = points.get(p, (0, 0))
        points[p] = (a + y, b + 1)
    df = spark.createDataFrame([*rows, (None, True), (0.5, None), (float("nan"), True)], "p double, y boolean")
    levels = evaluation.reliability_curve(df.repartition(5), "p", "y").collect()
    want = Counter()
    fit = min_max_fit(points)
    for p, value in fit.items():
        want[round(value, 9)] += points[p][1]
    assert {round(r["fitted_rate"], 9): r["count"] for r in levels} == dict(want)
    for r in levels:
        inside = [p for p in fit if abs(fit[p] - r.fitted_rate) < 1e-9]
        assert r.forecast_mean == pytest.approx(sum(p * points[p][1] for p in inside) / r["count"])
    summary = spark.createDataFrame([(p, float(a), float(b)) for p, (a, b) in points.items()], "p double, hits double, weight double")
    for width in (1, 2, 7, 16):
        pools = sorted((r.low, r.high, r.hits, r.weight) for r in isotonic_pools(summary, width).collect())
        assert pools == [tuple(x[:4]) for x in pooled((p, p, float(a), float(b), p * b) for p, (a, b) in sorted(points.items()))]


def test_draws_of_segments_are_multinomial():
    n, size, blocks, repetitions = 1000, 96, 37, 400
    segments = -(-n // size)
    parts = np.stack([evaluation.segment_draws(5, k, segments, size, n, blocks, repetitions, {}) for k in range(segments)])
    assert (parts.sum(0) == blocks).all() and (parts >= 0).all()
    shares = np.array([min(size, n - k * size) / n for k in range(segments)])
    mean, spread = parts.mean(1), np.sqrt(blocks * shares * (1 - shares) / repetitions)
    assert (abs(mean - blocks * shares) < 4.5 * spread).all()
    assert parts.var(1) == pytest.approx(blocks * shares * (1 - shares), rel=0.35)
    assert (evaluation.segment_draws(5, 3, segments, size, n, blocks, repetitions, {}) == parts[3]).all()
    assert (evaluation.segment_draws(6, 3, segments, size, n, blocks, repetitions, {}) != parts[3]).any()


def test_block_bootstrap(spark, monkeypatch):
    rng = random.Random(2)
    n, length, repetitions = 700, 9, 300
    values = [rng.gauss(0.1, 1) for _ in range(n)]
    df = spark.createDataFrame([(i, v, 2 * v + 1) for i, v in enumerate(values)], "fixture_id long, a double, b double")
    df = df.select(F.timestamp_seconds(F.col("fixture_id") * 5000).alias("kickoff_utc"), "*")
    monkeypatch.setattr(evaluation, "SEGMENT", 64)
    run = lambda parts: evaluation.block_bootstrap(df.repartition(parts), ("kickoff_utc", "fixture_id"), ["a", "b"], block_length=length, repetitions=repetitions, seed=3)
    means, count, _ = run(3)
    rows = means.orderBy("replicate").collect()
    blocks = -(-n // length)
    assert count == n and len(rows) == repetitions and {r._blocks for r in rows} == {blocks}
    assert [r.b for r in rows] == pytest.approx([2 * r.a + 1 for r in rows])
    spread = np.std([np.mean([np.take(values, range(s, s + length), mode="wrap") for s in np.random.default_rng(k).integers(0, n, blocks)]) for k in range(600)])
    assert np.mean([r.a for r in rows]) == pytest.approx(np.mean(values), abs=5 * spread / repetitions**0.5)
    assert np.std([r.a for r in rows]) == pytest.approx(spread, rel=0.2)
    assert [r.a for r in run(7)[0].orderBy("replicate").collect()] == pytest.approx([r.a for r in rows])
    one = evaluation.block_bootstrap(df, ("kickoff_utc", "fixture_id"), ["a"], block_length=n, repetitions=5, seed=3)[0].collect()
    assert [r.a for r in one] == pytest.approx([np.mean(values)] * 5) and {r._blocks for r in one} == {1}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_permutation_of_row_numbers(spark, n):
    df, total = row_numbers(spark.range(n).repartition(5), "r")
    rows = df.select("r", permuted(F.col("r"), total, 1).alias("a"), permuted(F.col("r"), total, 2).alias("b")).collect()
    assert total == n and sorted(r.r for r in rows) == list(range(n)) == sorted(r.a for r in rows) == sorted(r.b for r in rows)
    if n > 90:
        assert sum(r.a == r.b for r in rows) < 8 and sum(r.a == r.r for r in rows) < 8
        assert abs(np.corrcoef([r.r for r in rows], [r.a for r in rows])[0, 1]) < 0.3


def test_row_numbers_of_nothing(spark):
    df, total = row_numbers(spark.range(0), "r")
    assert total == 0 and df.count() == 0


def test_ranks_read_their_input_once(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), *[rng.choice([None, 1.0, 2.5, float("inf"), float("nan"), rng.random()]) for _ in range(3)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(3)
    found = ranks.with_ranks(df, {"rx": "x", "ry": "y", "rz": "z"}, group=["g"])
    for r in found.collect():
        for c in "xyz":
            values = [row["gxyz".index(c)] for row in rows if row[0] == r.g]
            known = [v for v in values if v is not None and v == v]
            value = r[c]
            if value is None or value != value:
                assert r[f"r{c}"] is None
            else:
                assert r[f"r{c}"] == sum(v < value for v in known) + (sum(v == value for v in known) + 1) / 2
    exchanges = lambda outputs: ranks.with_ranks(df, outputs, group=["g"])._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges({"rx": "x"}) == exchanges({"rx": "x", "ry": "y", "rz": "z"})


def test_intervals_of_draws(spark):
    rng = random.Random(1)
    draws = [(f, d, *[rng.random() + 0.1 for _ in range(3)]) for f in range(6) for d in range(11)]
    df = spark.createDataFrame(draws, "fixture_id long, draw int, p_home double, p_draw double, p_away double")
    got = {(r.fixture_id, r.outcome): r for r in evaluation.forecast_intervals(df).collect()}
    assert len(got) == 18
    for f in range(6):
        p = np.array([x[2:] for x in draws if x[0] == f])
        p /= p.sum(1, keepdims=True)
        point = int(np.argmax(np.median(p, 0)))
        for k in range(3):
            r = got[f, k]
            assert [r.lower_80, r.lower_50, r.median, r.upper_50, r.upper_80] == pytest.approx(np.quantile(p[:, k], [0.1, 0.25, 0.5, 0.75, 0.9]).tolist())
            assert r.leader_stability == pytest.approx(np.mean(p.argmax(1) == point))


def test_poisson_weights_belong_to_rows(spark):
    rows = [(i, 1.0, 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "h long, profit double, stake double").select(F.xxhash64("h").alias("h"), "profit", "stake")
    sums = lambda parts: sorted((r._r, r.s) for r in df.repartition(parts).mapInArrow(lambda b: markets._poisson_sums(b, 50), "_r int, profit double, stake double").groupBy("_r").agg(F.sum("stake").alias("s")).collect())
    assert sums(1) == sums(6)
    totals = [s for _, s in sums(2)]
    assert np.mean(totals) == pytest.approx(3000, abs=5 * (3000 / 50) ** 0.5) and np.std(totals) == pytest.approx(3000**0.5, rel=0.4)


def test_inventory_counts_pairs_and_sketches(spark):
    from matchgrain.operators.aggregates import feature_inventory

    rows = [(i % 7, float(i % 3) if i % 4 else None, f"t{i}" if i % 2 else "", [i % 5], bytearray([i % 9]), -0.0 if i % 2 else 0.0) for i in range(6000)]
    df = spark.createDataFrame(rows, "a int, odds_home double, c string, `d.e` array<int>, f binary, z double")
    got = {r.column: r for r in feature_inventory(df).collect()}
    assert {k: r.distinct_values for k, r in got.items()} == {"a": 7, "odds_home": 3, "c": 3001, "d.e": 5, "f": 9, "z": 1}
    assert got["odds_home"].missing_rate == 0.25 and got["odds_home"].category == "market" and got["a"].missing_rate == 0
    near = {r.column: r for r in feature_inventory(df, sketch=12).collect()}
    assert all(abs(near[k].distinct_values - r.distinct_values) <= 0.05 * r.distinct_values for k, r in got.items())
    assert near["odds_home"].missing_rate == 0.25
    for mode in (None, 12):
        empty = feature_inventory(df.limit(0), sketch=mode).collect()
        assert len(empty) == 6 and all(r.missing_rate is None and r.distinct_values == 0 for r in empty)


def test_quotes_leave_the_state_after_kickoff(spark, tmp_path):
    import datetime as dt

    from matchgrain.streaming.streams import latest_quotes, read_stream, run_to_table

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    names = "fixture_id long, market string, selection string, bookmaker string, observed_at timestamp, decimal_price double"
    kickoffs = spark.createDataFrame([(1, day(5)), (2, day(20)), (3, None)], "fixture_id long, kickoff_utc timestamp")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def feed(*quotes):
        rows = [(f, "1x2", "home", "b", t, p) for f, t, p in quotes]
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(source)
        stream = read_stream(spark, source, spark.read.parquet(source).schema)
        run_to_table(latest_quotes(stream, kickoffs), out, state, "update")
        kept = spark.read.format("statestore").load(state).select("key.fixture_id").collect()
        batches = spark.read.parquet(out)
        latest = {r.fixture_id: r.decimal_price for r in batches.orderBy("batch").collect()}
        return sorted(r.fixture_id for r in kept), latest

    assert feed((1, day(1), 2.0), (1, day(2), 2.1), (2, day(2), 3.0), (3, day(2), 9.0), (1, None, 8.0)) == ([1, 2], {1: 2.1, 2: 3.0})
    assert feed((1, day(4), 2.2), (1, day(6), 7.0), (2, day(10), 3.1)) == ([2], {1: 2.2, 2: 3.1})
    assert feed((1, day(4, 5), 2.9), (2, day(9), 3.3)) == ([2], {1: 2.2, 2: 3.1})
    assert feed((2, day(25), 4.0)) == ([], {1: 2.2, 2: 3.1})


def test_latest_quotes_are_fed_in_order_of_time(spark, monkeypatch):
    import datetime as dt
    import pathlib
    from types import SimpleNamespace

    from matchgrain.plans import q_streams

    start = dt.datetime(2024, 1, 1)
    rows = [(f, "1x2", s, b, start + dt.timedelta(hours=24 * f + 5 * t), 2.0 + (f * 7 + t * 3 + b) % 11) for f in range(40) for s in ("home", "away") for b in (1, 2) for t in range(6)]
    rows += [(3, "1x2", "home", 1, None, 99.0), (None, "1x2", "home", 1, start, 99.0), (50, "1x2", "home", 1, start, 99.0), (5, "1x2", "home", None, start, 7.5)]
    names = "fixture_id long, market string, selection string, bookmaker long, observed_at timestamp_ntz, decimal_price double"
    kickoffs = [(f, start + dt.timedelta(hours=24 * f + 22)) for f in range(40)] + [(51, None)]
    bridge = SimpleNamespace(spark=spark, quotes=spark.createDataFrame(rows, names), matches=spark.createDataFrame(kickoffs, "fixture_id long, kickoff_utc timestamp_ntz"))
    seen, folders, run = [], [], q_streams.T.run_to_table

    def fed(latest, out, checkpoint, mode, **dealt):
        folders.append(f"{out[:-4]}/in")
        span = spark.read.option("recursiveFileLookup", True).parquet(folders[-1])
        seen.append(span.agg(F.count("*"), F.min("observed_at"), F.max("observed_at"), F.count_if(F.col("observed_at").isNull())).first())
        run(latest, out, checkpoint, mode, **dealt)
        kept = spark.read.format("statestore").load(checkpoint).count()
        assert kept <= 8  # keys whose kickoff is to come, not all of the 160

    monkeypatch.setattr(q_streams.T, "run_to_table", fed)
    monkeypatch.setattr(q_streams, "FEED_ROWS", 400)
    latest = q_streams.t1(bridge)
    got = {(r.fixture_id, r.selection, r.bookmaker): (r.observed_at, r.decimal_price) for r in latest.collect()}
    want, ends = {}, dict(kickoffs)
    for f, _, s, b, t, p in rows:
        if t is not None and ends.get(f) is not None and t < ends[f]:
            want[f, s, b] = max(want.get((f, s, b), (t, p)), (t, p))
    assert got == want and latest.count() == len(got) == 161
    assert len(seen) == 3 and sum(r[0] for r in seen) == len(rows) and seen[0][3] == 1
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))
    assert len(set(folders)) == 1 and not list(pathlib.Path(folders[0]).glob("*"))
    assert "Exchange" not in latest._jdf.queryExecution().executedPlan().toString()
