"""Ordered computations that stay parallel inside one key.

A plain window over `partitionBy(team)` puts a whole team in one task, so a key
that holds a large share of the rows becomes the job's run time. The helpers here
cut a key into pieces first:

* `prior_totals`  - prefix count / sum / max / last-value. Rows are grouped into
  (key, bucket), where the bucket rises with the sort order (an hour of kickoff
  time by default). Bucket totals are pre-aggregated before the shuffle, turned
  into a running carry on the small bucket table, and joined back.
* `prior_rows`    - frames of at most `lookback` rows. Positions from
  `prior_totals` cut a key into blocks of `size` rows, and each block also
  receives the last `lookback` rows of the block before it.
* `by_key_size`   - rows of keys that are no larger than a block, for which a plain
  window does with one shuffle, and all others, for the helpers above.
* `asof_prior`    - latest right row before each left row, as a prefix last-value
  over the union of both sides: linear, no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from matchgrain.functions.contracts import seconds
from matchgrain.functions.storage import rewritten

HOUR = 3600
BLOCK_ROWS = 4096


def time_bucket(ts, width: int = HOUR) -> Column:
    return F.floor(seconds(ts) / F.lit(width)).cast("bigint")


def dealt(df: DataFrame, *columns: str, rows: int | None = None) -> DataFrame:
    """Rows by `columns` in a fixed number of parts, for a step whose memory grows past what was shuffled; small parts are not merged.

    There are more parts if they would hold more than about `rows` rows; `df` is counted for that, so it is a stored table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        parts = max(parts, -(-df.count() // rows))
    return df.repartition(parts, *columns)


def by_key_size(
    df: DataFrame, keys: Sequence[str], bucket: Column, size: int = BLOCK_ROWS, *, first: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows of keys with at most `size` rows, all other rows).

    The first part has `_key`, a struct of the keys by which it is dealt already; a window over it needs no further
    shuffle. Null keys are one key. Rows whose bucket is null (no time) are in the second part.

    `first` counts at once and keeps the large keys as a table. For callers that compute the parts in separate jobs: no row is
    shuffled to find its part if the large keys are few, and a window deals out the first part.
    """
    placed = df.withColumn("_key", F.struct(*keys))
    large = placed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size).select("_key", F.lit(True).alias("_large"))
    if first:
        large = rewritten(large)
    # One condition over both sides of the join stays above it, so both parts read the same shuffled rows.
    marked = placed.join(large, "_key", "left").withColumn("_far", F.coalesce("_large", bucket.isNull()))
    return marked.where(~F.col("_far")).drop("_large", "_far"), marked.where("_far").drop("_key", "_large", "_far")


def _order_struct(order: Sequence[Column]) -> Column:
    return F.struct(*order)


def prior_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    *,
    position: str | None = None,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add totals over the rows strictly before each row, in ascending `order`.

    `order` must be total within a key and `bucket` must be a deterministic,
    non-decreasing function of it. `position` is the 1-based row number.
    Sums are 0 before the first row; maxes and lasts are null there. `totals` maps an
    output name to a name in `sums` and gives its sum over the whole key.

    Every row comes out. Null keys are one key, as in a grouping. A row whose bucket is null (no
    time) lies nowhere in the order: it counts for no other row, its sums are 0, its position,
    maxes, lasts and totals null.

    The input is read twice (bucket totals, rows), so a caller that stacks these must
    cut the lineage in between.
    """
    totals = dict(totals or {})
    sums, maxes, lasts = dict(sums or {}), dict(maxes or {}), dict(lasts or {})
    order_cols = [F.col(name) for name in order]
    # One struct stands for keys and bucket: structs compare null fields as equal. Rows without
    # a bucket are spread by a hash, as they may be many.
    placed = F.struct(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("bucket"),
        F.when(F.col("_bucket").isNull(), F.xxhash64(*order_cols)).otherwise(0).alias("spread"),
    )
    staged = df.withColumn("_bucket", bucket).withColumn("_place", placed)
    named: dict[str, Column] = {}
    for kind, group in (("s", sums), ("m", maxes), ("l", lasts)):
        for index, expression in enumerate(group.values()):
            named[f"_{kind}{index}"] = expression
    if named:
        staged = staged.withColumns(named)

    aggregates = [F.count(F.lit(1)).alias("_n")]
    aggregates += [F.sum(f"_s{i}").alias(f"_cs{i}") for i in range(len(sums))]
    aggregates += [F.max(f"_m{i}").alias(f"_cm{i}") for i in range(len(maxes))]
    aggregates += [
        F.max_by(
            F.col(f"_l{i}"),
            F.when(F.col(f"_l{i}").isNotNull(), _order_struct(order_cols)),
        ).alias(f"_cl{i}")
        for i in range(len(lasts))
    ]
    per_bucket = staged.where("_bucket IS NOT NULL").groupBy("_place").agg(*aggregates)

    partition = [F.col(f"_place.k{i}") for i in range(len(keys))] or [F.lit(0)]
    before = (
        Window.partitionBy(*partition)
        .orderBy("_place.bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0")]
    carried += [F.sum(f"_cs{i}").over(before).alias(f"_s0{i}") for i in range(len(sums))]
    carried += [F.max(f"_cm{i}").over(before).alias(f"_m0{i}") for i in range(len(maxes))]
    carried += [
        F.last(f"_cl{i}", ignorenulls=True).over(before).alias(f"_l0{i}")
        for i in range(len(lasts))
    ]
    whole = Window.partitionBy(*partition)
    at = {name: i for i, name in enumerate(sums)}
    carried += [F.sum(f"_cs{at[of]}").over(whole).alias(f"_t{i}") for i, of in enumerate(totals.values())]
    carry = per_bucket.select("_place", *carried)

    inside = Window.partitionBy("_place").orderBy(*order)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = staged.join(carry, "_place", "left")
    timed = F.col("_bucket").isNotNull()
    outputs: dict[str, Column] = {}
    if position:
        outputs[position] = F.when(timed, F.col("_n0") + F.row_number().over(inside)).cast("bigint")
    for i, (name, expression) in enumerate(sums.items()):
        own = F.when(timed, F.sum(f"_s{i}").over(prior))
        outputs[name] = F.coalesce(F.col(f"_s0{i}"), F.lit(0)) + F.coalesce(own, F.lit(0))
    for i, name in enumerate(maxes):
        outputs[name] = F.when(timed, F.greatest(F.col(f"_m0{i}"), F.max(f"_m{i}").over(prior)))
    for i, name in enumerate(lasts):
        outputs[name] = F.when(
            timed, F.coalesce(F.last(f"_l{i}", ignorenulls=True).over(prior), F.col(f"_l0{i}"))
        )
    for i, name in enumerate(totals):
        outputs[name] = F.col(f"_t{i}")
    kept = [c for c in df.columns if c not in outputs]
    return joined.select(*kept, *[c.alias(n) for n, c in outputs.items()])


def prior_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    expressions: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    lookback: int,
    size: int = BLOCK_ROWS,
    position: str = "_pos",
) -> DataFrame:
    """Add window expressions whose frames reach back at most `lookback` rows.

    `expressions` receives the ordered window and returns name -> column. Every row comes out; a
    row without a position (no time) gets nulls.
    """
    placed = df if position in df.columns else prior_totals(
        df, keys, order, bucket, position=position
    )
    blocks = with_halo(placed, position, lookback, size, [*keys, *order])
    spec = Window.partitionBy(*keys, "_block").orderBy(position)
    made = {name: F.when(F.col(position).isNotNull(), c) for name, c in expressions(spec).items()}
    out = blocks.withColumns(made).where("_own")
    drop = ["_block", "_own"] + ([] if position in df.columns else [position])
    return out.drop(*drop)


def with_halo(df: DataFrame, position: str, lookback: int, size: int, spread: Sequence[str]) -> DataFrame:
    if lookback > size:
        size = lookback
    zero = F.col(position) - F.lit(1)
    # Rows without a position are in no block of the order; a hash of `spread` spreads them over blocks below zero.
    # A hash of all columns would keep columns in the plan that nothing else reads.
    own = F.coalesce(F.floor(zero / F.lit(size)).cast("bigint"), -1 - F.pmod(F.xxhash64(*spread), F.lit(1 << 40)))
    also = F.when(zero % F.lit(size) >= F.lit(size - lookback), own + 1)
    return (
        df.withColumn("_home", own)
        .withColumn("_block", F.explode(F.array_compact(F.array(own, also))))
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_home")
    )


def prior_ewm(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: Mapping[str, str],
    *,
    span: int = 10,
) -> DataFrame:
    """Exponentially weighted means (recursive form) of earlier rows.

    `values` maps value columns to output names. A missing value keeps its place in the
    sequence: it does not move the mean, but the weight of the mean decays over the
    gap. The recurrence y = a*y' + b is affine, so inside a block it is one running
    product (as a sum of logs) and one running sum. Blocks are cut by observation
    number and start early enough that what lies before weighs < 1e-21. Each row finds
    its mean by the number of observations before it: an equi join, not an as-of join.
    """
    alpha = 2.0 / (span + 1.0)
    keep = 1.0 - alpha
    lookback, size = ewm_block(span)
    placed = prior_totals(
        df,
        keys,
        order,
        bucket,
        position="_pos",
        sums={f"_seen{i}": F.col(v).isNotNull().cast("bigint") for i, v in enumerate(values)},
    )
    long = placed.select(
        *keys,
        "_pos",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("_m"),
                        F.col(f"_seen{i}").alias("_n"),
                        F.col(v).cast("double").alias("_x"),
                    )
                    for i, v in enumerate(values)
                ]
            )
        ),
    )
    observed = long.where(F.col("_x").isNotNull()).withColumn("_idx", F.col("_n") + 1)
    spec = Window.partitionBy(*keys, "_m", "_block").orderBy("_idx")
    upto = spec.rowsBetween(Window.unboundedPreceding, 0)
    weight = F.pow(F.lit(keep), F.col("_pos") - F.lag("_pos").over(spec))
    states = (
        with_halo(observed, "_idx", lookback, size, keys)
        .withColumn("_w", weight)
        .withColumn("_log", F.coalesce(F.ln(F.col("_w") / (F.col("_w") + alpha)), F.lit(0.0)))
        .withColumn("_b", F.coalesce(F.col("_x") * alpha / (F.col("_w") + alpha), F.col("_x")))
        .withColumn("_S", F.sum("_log").over(upto))
        .withColumn("_T", F.sum(F.col("_b") * F.exp(-F.col("_S"))).over(upto))
        .where("_own")
        .select(*keys, "_m", F.col("_idx").alias("_n"), (F.exp("_S") * F.col("_T")).alias("_y"))
    )
    found = (
        long.where("_n > 0")
        .select(*keys, "_pos", "_m", "_n")
        .join(states, [*keys, "_m", "_n"])
        .groupBy(*keys, "_pos")
        .agg(*[F.max(F.when(F.col("_m") == i, F.col("_y"))).alias(o) for i, o in enumerate(values.values())])
    )
    return placed.join(found, [*keys, "_pos"], "left").drop(
        "_pos", *[f"_seen{i}" for i in range(len(values))]
    )


def ewm_block(span: int) -> tuple[int, int]:
    """(rows after which a mean has forgotten what was before, rows whose weights stay within a double)."""
    decay = -log(1.0 - 2.0 / (span + 1.0))
    lookback = int(max(64, 50.0 / decay))
    return lookback, int(max(lookback, min(2048, 400.0 / decay)))


def window_ewm(df: DataFrame, spec: WindowSpec, values: Mapping[str, str], *, span: int = 10) -> DataFrame:
    """W4 for keys of at most `ewm_block` rows: the means of `prior_ewm` over one ordered window, without a shuffle or rows per metric.

    The weight of a mean decays by row, so the running product cannot leave a double before the rows of a block are over.
    """
    alpha = 2.0 / (span + 1.0)
    prior, upto = (spec.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    at = range(len(values))
    x = [F.col(v).cast("double") for v in values]
    out = df.withColumn("_at", F.row_number().over(spec))
    out = out.withColumns({f"_w{i}": F.pow(F.lit(1.0 - alpha), F.col("_at") - F.last(F.when(x[i].isNotNull(), F.col("_at")), ignorenulls=True).over(prior)) for i in at})
    logs = [F.when(x[i].isNotNull(), F.coalesce(F.ln(F.col(f"_w{i}") / (F.col(f"_w{i}") + alpha)), F.lit(0.0))) for i in at]
    out = out.withColumns({f"_{name}{i}": F.sum(logs[i]).over(frame) for i in at for name, frame in (("S", upto), ("S0", prior))})
    terms = [F.coalesce(x[i] * alpha / (F.col(f"_w{i}") + alpha), x[i]) * F.exp(-F.col(f"_S{i}")) for i in at]
    out = out.withColumns({f"_T{i}": F.sum(terms[i]).over(prior) for i in at})
    made = {name: F.exp(f"_S0{i}") * F.col(f"_T{i}") for i, name in enumerate(values.values())}
    return out.withColumns(made).drop("_at", *[f"_{name}{i}" for i in at for name in ("w", "S", "S0", "T")])


def asof_prior(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_time: str,
    right_time: str,
    values: Mapping[str, str],
    right_tie: Sequence[str] = (),
    strict: bool = True,
    width: int = HOUR,
) -> DataFrame:
    """Latest right row before each left row with the same keys; all left rows stay, each once.

    A left row with a null key or a null time has no right row.

    `values` maps right columns to output names; `right_tie` orders right rows that
    share a time (the largest wins). Strict means an equal time is too late.
    """
    payload = F.struct(*[F.col(c).alias(n) for c, n in values.items()])
    tie = F.struct(*[F.col(c) for c in right_tie]) if right_tie else F.struct(F.lit(0).alias("z"))
    right_rank, left_rank = (1, 0) if strict else (0, 1)
    events = right.where(F.col(right_time).isNotNull()).select(
        *keys,
        F.col(right_time).alias("_t"),
        F.lit(right_rank).alias("_k"),
        tie.alias("_tie"),
        payload.alias("_payload"),
    )
    targets = left.select(
        *keys,
        F.col(left_time).alias("_t"),
        F.lit(left_rank).alias("_k"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    both = events.unionByName(targets, allowMissingColumns=True)
    done = prior_totals(
        both,
        keys,
        ["_t", "_k", "_tie"],
        time_bucket("_t", width),
        lasts={"_hit": F.col("_payload")},
    ).where(F.col("_left").isNotNull())
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(f"_left.{key}").isNotNull()
    return done.select("_left.*", *[F.when(whole, F.col(f"_hit.{n}")).alias(n) for n in values.values()])
