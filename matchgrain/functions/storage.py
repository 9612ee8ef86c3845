"""Cutting lineage: reliable checkpoints and tables in the cluster's shared folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session.

    Where it is not set, a session with a local master (one machine, as in tests) gets a temporary
    folder; on a cluster that is an error, as no other machine would see what is written there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="matchgrain-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends, not when the driver next collects garbage: for tables that are written and read back."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that this code wrote and that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once to reliable storage and go on from the written copy.

    For inputs that a later step reads more than once, and for iterative steps.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def rewritten(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: for steps of a long iteration, as a checkpoint keeps facts of the plan before it, which pile up."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/step_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_once(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Parquet table in the shared folder, built at first use in this application.

    Rows are written where the last step leaves them; dealing them out anew would shuffle and sort the whole table.
    The shuffle files of the build do not outlive it.
    """
    application = spark.sparkContext.applicationId
    slot = (application, key)
    if slot not in _STORED:
        digest = hashlib.sha256(key.encode()).hexdigest()[:16]
        path = f"{shared_folder(spark)}/tables/{application}/{digest}"
        made = build()
        with shuffles_dropped(spark):
            made.write.mode("overwrite").parquet(path)
        _STORED[slot] = path
    return spark.read.parquet(_STORED[slot])


@contextmanager
def kept_dealt(df: DataFrame, keys: Sequence[str], parts: int) -> Iterator[DataFrame]:
    """`df` as a table bucketed by `keys` in a number of parts, for an iteration that reads it in every step.

    Within, a join or grouping by these and more keys finds its rows where they are, and a table dealt by `keys` in
    as many parts joins it without a shuffle. Results must be checkpointed before the end.
    """
    spark = df.sparkSession
    name, setting = f"dealt_{uuid.uuid4().hex}", "spark.sql.requireAllClusterKeysForCoPartition"
    path = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/{name}"
    before = spark.conf.get(setting)
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", path).saveAsTable(name)
    spark.conf.set(setting, "false")
    try:
        yield spark.table(name)
    finally:
        spark.conf.set(setting, before)
        spark.sql(f"drop table {name}")
