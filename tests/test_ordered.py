"""Ordered helpers against pandas, with one hot key and small blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchgrain.operators.ordered import asof_prior, prior_ewm, prior_rows, prior_totals
from matchgrain.operators.ranks import exact_quantiles, value_bucket, with_ranks


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({
        "team": rng.choice([1, 2, 3], n, p=[0.7, 0.2, 0.1]).astype("int64"), "t": rng.integers(0, 400, n).astype("int64"), "id": np.arange(n, dtype="int64"),
        "v": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
    }).sort_values(["team", "t", "id"]).reset_index(drop=True)
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return pdf, df.repartition(4)


def by_id(df, *names):
    return df.toPandas().sort_values("id").reset_index(drop=True)[["id", *names]]


def test_prior_totals(frame):
    pdf, df = frame
    out = prior_totals(df, ["team"], ["t", "id"], F.floor(F.col("t") / 10), position="pos", sums={"s": F.col("v")}, maxes={"m": F.col("v")}, lasts={"l": F.col("v")}, totals={"all": "s"})
    got = by_id(out, "pos", "s", "m", "l", "all")
    g = pdf.groupby("team")["v"]
    want = pdf.assign(
        pos=pdf.groupby("team").cumcount() + 1, s=g.transform(lambda x: x.fillna(0).cumsum().shift(1).fillna(0)), m=g.transform(lambda x: x.cummax().ffill().shift(1)),
        l=g.transform(lambda x: x.ffill().shift(1)), all=g.transform("sum"),
    ).sort_values("id").reset_index(drop=True)
    for c in ("pos", "s", "m", "l", "all"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9)


def test_prior_rows_across_blocks(frame):
    pdf, df = frame
    out = prior_rows(df, ["team"], ["t", "id"], F.floor(F.col("t") / 10), lambda w: {"r": F.avg("v").over(w.rowsBetween(-5, -1))}, lookback=5, size=16)
    want = pdf.assign(r=pdf.groupby("team")["v"].transform(lambda x: x.shift(1).rolling(5, min_periods=1).mean())).sort_values("id")
    np.testing.assert_allclose(by_id(out, "r")["r"].astype(float), want["r"].astype(float), atol=1e-9)


@pytest.mark.parametrize("span", [10, 40])
def test_prior_ewm_equals_pandas(frame, span):
    pdf, df = frame
    out = prior_ewm(df, ["team"], ["t", "id"], F.floor(F.col("t") / 10), {"v": "e"}, span=span)
    want = pdf.assign(e=pdf.groupby("team")["v"].transform(lambda x: x.shift(1).ewm(span=span, adjust=False, min_periods=1).mean())).sort_values("id")
    np.testing.assert_allclose(by_id(out, "e")["e"].astype(float), want["e"].astype(float), rtol=1e-8, atol=1e-9)


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, "2024-01-02 00:00:00"), (1, "2024-01-02 00:00:01"), (2, "2024-01-05 00:00:00")], "k int, at string").withColumn("at", F.to_timestamp("at"))
    right = spark.createDataFrame([(1, "2024-01-01 00:00:00", 5.0), (1, "2024-01-02 00:00:00", 7.0)], "k int, seen string, r double").withColumn("seen", F.to_timestamp("seen"))
    got = {(r.k, str(r.at)): r.value for r in asof_prior(left, right, ["k"], left_time="at", right_time="seen", values={"r": "value"}).collect()}
    assert got == {(1, "2024-01-02 00:00:00"): 5.0, (1, "2024-01-02 00:00:01"): 7.0, (2, "2024-01-05 00:00:00"): None}


def test_ranks_and_quantiles_equal_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "v": np.round(rng.normal(scale=30, size=400), 0), "id": np.arange(400)})
    pdf.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = by_id(with_ranks(df, {"p": "v"}, group=["g"], pct=True), "p")
    np.testing.assert_allclose(got["p"].astype(float), pdf.groupby("g")["v"].rank(pct=True), atol=1e-12)
    low = by_id(with_ranks(df, {"p": "v"}, method="min", descending=True), "p")
    np.testing.assert_allclose(low["p"].astype(float), pdf["v"].rank(method="min", ascending=False), atol=1e-12)
    q = exact_quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.975}).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile([0.1, 0.5, 0.975]).unstack()
    np.testing.assert_allclose(q[["a", "m", "z"]], want, atol=1e-9)


def test_value_bucket_never_falls(spark):
    values = sorted([0.0, -0.0, 1e-30, -1e-30, 1e9, -1e9, *np.linspace(-5, 5, 301).tolist(), *np.geomspace(1e-12, 1e6, 200).tolist()])
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    buckets = [r.b for r in rows.select("i", value_bucket("v").alias("b")).orderBy("i").collect()]
    assert buckets == sorted(buckets)


def test_rows_without_key_or_time_stay(spark):
    from pyspark.sql import functions as F

    from matchgrain.operators.ordered import asof_prior, prior_rows, prior_totals, time_bucket

    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 7200, 2.0), ("a", None, 4.0), (None, 1, 8.0), (None, 9000, 16.0), (None, None, 32.0)], "k string, s long, x double")
    rows = rows.withColumn("t", F.timestamp_seconds("s"))
    got = prior_totals(rows, ["k"], ["t"], time_bucket("t"), position="p", sums={"before": F.col("x")}, lasts={"last": F.col("x")}).collect()
    assert sorted(((r.k, r.s, r.p, r.before, r.last) for r in got), key=repr) == sorted(
        [("a", 1, 1, 0.0, None), ("a", 7200, 2, 1.0, 1.0), ("a", None, None, 0.0, None), (None, 1, 1, 0.0, None), (None, 9000, 2, 8.0, 8.0), (None, None, None, 0.0, None)], key=repr
    )
    rolled = prior_rows(rows, ["k"], ["t"], time_bucket("t"), lambda w: {"m": F.avg("x").over(w.rowsBetween(-3, -1))}, lookback=3)
    assert sorted(((r.k, r.s, r.m) for r in rolled.collect()), key=repr) == sorted(
        [("a", 1, None), ("a", 7200, 1.0), ("a", None, None), (None, 1, None), (None, 9000, 8.0), (None, None, None)], key=repr
    )
    right = rows.select("k", F.col("t").alias("rt"), F.col("x").alias("y"))
    hit = asof_prior(rows, right, ["k"], left_time="t", right_time="rt", values={"y": "found"}).collect()
    assert len(hit) == rows.count()
    assert {(r.k, r.s): r.found for r in hit} == {("a", 1): None, ("a", 7200): 1.0, ("a", None): None, (None, 1): None, (None, 9000): None, (None, None): None}
