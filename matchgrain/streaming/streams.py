"""Streaming twins of the quote, ledger, rating and freshness operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrain.functions.storage import cut_lineage, shuffles_dropped
from matchgrain.operators.ledgers import LEDGER_KEY, append_forecast_ledger
from matchgrain.operators.ratings import elo_update

#: State lies in RocksDB on the executors' disks, its memory bounded for each executor; the default keeps every key on the heap.
#: Versions of the state that no restart needs, state of runs that are over, and shuffle files of finished batches go soon.
STATE_ON_DISK = {
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    "spark.sql.streaming.stateStore.rocksdb.compactOnCommit": "true",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}
QUOTE_KEY = ("fixture_id", "market", "selection", "bookmaker")


def read_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files under a folder as a stream with a fixed schema."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def latest_quotes(quotes: DataFrame, kickoffs: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Latest pre-kickoff quote per key (update mode).

    `kickoffs` is a static table; a quote at or after kickoff is unusable, however late it comes. The state is one quote per
    key. The kickoff is part of the key and carries the watermark, so a key leaves the state once the watermark passes its
    kickoff. The watermark itself must follow the observations: a branch without rows carries theirs, and of several
    watermarks Spark takes the smallest (`spark.sql.streaming.multipleWatermarkPolicy` = min, its default), so a key also waits
    for a quote, usable or not, of a kickoff as late as its own, in the same run of the stream. A quote that
    comes after that is dropped. A null observation or kickoff is unusable.
    """
    rest = ("observed_at", "decimal_price")
    names = (*QUOTE_KEY, *rest, "kickoff_utc")
    usable = (
        quotes.join(kickoffs.select("fixture_id", "kickoff_utc"), "fixture_id")
        .withWatermark("kickoff_utc", "0 seconds")
        .where(F.col("observed_at") < F.col("kickoff_utc"))
    )
    clock = quotes.withColumn("kickoff_utc", F.col("observed_at")).withWatermark("kickoff_utc", delay).where("kickoff_utc IS NULL").where("observed_at IS NOT NULL")
    latest = usable.select(*names).unionByName(clock.select(*names)).groupBy(*QUOTE_KEY, "kickoff_utc")
    return latest.agg(F.max(F.struct(*rest)).alias("q")).select(*QUOTE_KEY, "q.*")


def with_fair_probability(latest: DataFrame) -> DataFrame:
    """Latest quotes to fair probabilities: a batch step for `foreachBatch` or the sink table."""
    total = latest.groupBy("fixture_id", "market", "bookmaker").agg(F.sum(1 / F.col("decimal_price")).alias("_t"))
    return latest.join(total, ["fixture_id", "market", "bookmaker"]).withColumn("fair_probability", 1 / F.col("decimal_price") / F.col("_t")).drop("_t")


class LedgerAppender:
    """`foreachBatch` writer. Each batch adds one folder of new rows, `root/ledger/batch=N`, split by month of issue.

    The ledger is the union of these folders. A batch reads only the months it touches, of all earlier
    batches, so gaps in the batch ids lose nothing and nothing is rewritten. A key that comes again with the same
    fields is dropped, with other fields it fails the batch. Forecasts that were not issued before kickoff go to
    `root/quarantine`. A replayed batch overwrites its own folders.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def ledger(self) -> DataFrame:
        """All rows so far, with `batch` and `month`."""
        return self.spark.read.parquet(f"{self.root}/ledger")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        early = F.coalesce(F.col("issued_at") < F.col("kickoff_utc"), F.lit(False))
        batch = cut_lineage(batch)
        batch.where(~early).write.mode("overwrite").parquet(f"{self.root}/quarantine/batch={batch_id}")
        good = batch.where(early).dropDuplicates().withColumn("month", F.date_format("issued_at", "yyyy-MM"))
        fresh = good
        if self._exists(f"{self.root}/ledger"):
            months = good.select("month").distinct()
            old = self.ledger().where(F.col("batch") != batch_id).join(months, "month", "left_semi").drop("batch").select(good.columns)
            # The rules of S6 over the touched months; what was not there before is new.
            merged = append_forecast_ledger(old, good)
            fresh = merged.join(old.select(*LEDGER_KEY), list(LEDGER_KEY), "left_anti")
        else:
            fresh = append_forecast_ledger(good.limit(0), good)
        fresh.write.mode("overwrite").partitionBy("month").parquet(f"{self.root}/ledger/batch={batch_id}")


def stream_ledger(additions: DataFrame, root: str, checkpoint: str):
    """Duplicate-free append of issued forecasts; a changed forecast under an old key fails the stream."""
    return additions.writeStream.foreachBatch(LedgerAppender(additions.sparkSession, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ELO_OUTPUT = "league_id bigint, fixture_id bigint, home_team_id bigint, away_team_id bigint, home_pre double, away_pre double, home_post double, away_post double"
ELO_STATE = "teams array<bigint>, ratings array<double>, wait array<struct<t: bigint, fixture_id: bigint, home: bigint, away: bigint, hg: bigint, ag: bigint>>"


def stream_elo(matches: DataFrame, *, delay: str = "7 days") -> DataFrame:
    """Elo per league in event-time order.

    Rows wait in state until the watermark has passed them, then update the ratings in
    (kickoff, fixture) order: the same numbers as the batch walk. State per league is one
    rating per team and the rows of the last `delay`.
    """
    def step(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        ratings, wait = {}, []
        if state.exists:
            teams, values, wait = state.get
            ratings, wait = dict(zip(teams, values)), [tuple(w) for w in wait]
        for pdf in batches:
            ms = pdf["kickoff_utc"].astype("datetime64[us]").astype("int64") // 1000
            wait += list(zip(ms.tolist(), *(pdf[c].tolist() for c in ("fixture_id", "home_team_id", "away_team_id", "home_goals", "away_goals"))))
        mark = state.getCurrentWatermarkMs()
        ready = sorted(w for w in wait if w[0] < mark)
        wait = [w for w in wait if w[0] >= mark]
        out = []
        for _, fixture, h, a, hg, ag in ready:
            before = ratings.get(h, 1500.0), ratings.get(a, 1500.0)
            after = elo_update(before[0], before[1], hg, ag, {}, (h, a))
            ratings[h], ratings[a] = after
            out.append((key[0], fixture, h, a, *before, *after))
        state.update((list(ratings), list(ratings.values()), wait))
        if wait:
            state.setTimeoutTimestamp(max(mark + 1, min(w[0] for w in wait) + 1))
        yield pd.DataFrame(out, columns=["league_id", "fixture_id", "home_team_id", "away_team_id", "home_pre", "away_pre", "home_post", "away_post"])

    rows = matches.where("home_goals IS NOT NULL").withWatermark("kickoff_utc", delay)
    return rows.groupBy("league_id").applyInPandasWithState(step, ELO_OUTPUT, ELO_STATE, "append", "EventTimeTimeout")


def provider_freshness(runs: DataFrame, *, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """T4: rows and last observation per provider and tumbling window."""
    return (
        runs.withWatermark("observed_at", delay)
        .groupBy(F.window("observed_at", window), "provider")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("observed_at").alias("last_observed"))
        .select(F.col("window.start").alias("window_start"), "provider", "rows", "last_observed")
    )


def updates_table(spark: SparkSession, name: str, path: str, schema: T.StructType, keys: Sequence[str]) -> None:
    """A table of updates, `path/batch=N`, whose rows are dealt by `keys` into files: what groups by them needs no shuffle."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    dealt = f"CLUSTERED BY ({', '.join(keys)}) INTO {parts} BUCKETS"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch BIGINT) USING parquet PARTITIONED BY (batch) {dealt} LOCATION '{path}'")


def _dealt_batch(df: DataFrame, batch: int, name: str, keys: Sequence[str]) -> None:
    """One batch of an `updates_table`; a replayed batch takes the place of its own rows."""
    spark = df.sparkSession
    with shuffles_dropped(spark):
        rows = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("batch", F.lit(batch).cast("bigint"))
        # The session of a batch is a copy of its own.
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        rows.write.insertInto(name, overwrite=True)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", *, table: str | None = None, keys: Sequence[str] = ()) -> None:
    """Drive a stream over what is available now into a parquet table.

    Update mode has no file sink, so each batch's updates are written to their own folder, or into the `updates_table` of
    that name and these keys. The query takes `STATE_ON_DISK` along when it starts; the session's own settings stay.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    elif table is not None:
        writer = writer.foreachBatch(lambda df, i: _dealt_batch(df, i, table, keys))
    else:
        writer = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"))
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE_ON_DISK}
    try:
        for name, value in STATE_ON_DISK.items():
            conf.set(name, value)
        query = writer.start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    query.awaitTermination()
