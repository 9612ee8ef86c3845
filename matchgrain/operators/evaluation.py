"""Forecast scoring, calibration, cohorts, drift, bootstrap and release decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.functions import scalars as S
from matchgrain.operators import grids


def prediction_frame(df: DataFrame) -> DataFrame:
    """Normalised 1X2 with label, leaning team, risk, guidance and goal markets.

    Input: p_home, p_draw, p_away, home_team_id, away_team_id, home_rate, away_rate.
    """
    out = S.normalize_probabilities(df)
    p = ("p_home", "p_draw", "p_away")
    lead = S.leader(*p)
    out = out.withColumn(
        "prediction", F.when(lead == 0, "Home").when(lead == 1, "Draw").otherwise("Away")
    ).withColumn(
        "lean_team_id", F.when(lead == 0, F.col("home_team_id")).when(lead == 2, F.col("away_team_id"))
    ).withColumn("risk_score", S.prediction_risk(*p))
    return out.withColumns(
        {
            "risk_band": S.risk_band("risk_score"),
            "guidance": S.prediction_guidance(*p, "risk_score"),
            "recommendation": F.lit("No bet"),
            **grids.closed_form_goal_markets("home_rate", "away_rate"),
        }
    )


# --- proper scores ----------------------------------------------------------------

P3 = ("p_home", "p_draw", "p_away")


def row_scores(target: str = "target", p: tuple = P3) -> dict[str, Column]:
    """Per-row log loss, Brier, RPS, hit; probabilities in home / draw / away order."""
    h, d, a = (F.col(c) for c in p)
    y = F.col(target)
    picked = F.when(y == 0, h).when(y == 1, d).otherwise(a)
    o = [(y == i).cast("double") for i in range(3)]
    brier = F.pow(h - o[0], F.lit(2)) + F.pow(d - o[1], F.lit(2)) + F.pow(a - o[2], F.lit(2))
    rps = (F.pow(h - o[0], F.lit(2)) + F.pow(h + d - o[0] - o[1], F.lit(2))) / 2
    return {
        "_log_loss": -F.ln(F.greatest(F.least(picked, F.lit(1.0)), F.lit(1e-15))),
        "_brier": brier, "_rps": rps, "_lead": S.leader(*p), "_top": F.greatest(*p),
    }


def _checked(df: DataFrame, p=P3) -> DataFrame:
    from matchgrain.functions.contracts import guard

    total = F.col(p[0]) + F.col(p[1]) + F.col(p[2])
    return guard(df, (F.least(*p) >= 0) & (F.abs(total - 1) <= 1e-8), "forecast probabilities need to be at least 0 with sum 1")


def _panel(target: str) -> list[Column]:
    hit = (F.col("_lead") == F.col(target)).cast("double")
    return [
        F.count(F.lit(1)).alias("fixtures"), F.avg("_log_loss").alias("log_loss"), F.avg("_brier").alias("brier"), F.avg("_rps").alias("rps"),
        F.avg(hit).alias("accuracy"), F.avg(F.when(F.col(target) == 1, (F.col("_lead") == 1).cast("double"))).alias("draw_recall"),
    ]


def proper_scores(df: DataFrame, keys=("model_id",), target: str = "target") -> DataFrame:
    """V1: log loss, Brier, RPS, accuracy (first arg-max), draw recall (null without draws)."""
    return _checked(df).withColumns(row_scores(target)).groupBy(*keys).agg(*_panel(target))


def expected_calibration_error(df: DataFrame, probability: str, observed: str, keys=(), bins: int = 10) -> DataFrame:
    """V4: binary; bin = min(floor(p * bins), bins - 1)."""
    if bins < 2:
        raise ValueError("bins must be at least two")
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return _weighted_gap(df.groupBy(*keys, b.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.avg(probability).alias("_p"), F.avg(F.col(observed).cast("double")).alias("_o")), keys)


def _weighted_gap(binned: DataFrame, keys) -> DataFrame:
    return binned.groupBy(*keys).agg((F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_o"))) / F.sum("_n")).alias("ece"))


def top_label_ece(df: DataFrame, keys=("model_id",), target: str = "target", bins: int = 10) -> DataFrame:
    """V4: top-label; bins [edge, edge) with the last one closed."""
    s = df.withColumns(row_scores(target)).withColumn("_hit", (F.col("_lead") == F.col(target)).cast("double"))
    edges = F.lit(0)
    for i in range(1, bins):
        edges = edges + (F.col("_top") >= F.lit(i * (1.0 / bins))).cast("int")
    return _weighted_gap(s.groupBy(*keys, edges.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.avg("_top").alias("_p"), F.avg("_hit").alias("_o")), keys)


def probability_metrics(df: DataFrame, keys=("model_id",), target: str = "target") -> DataFrame:
    """V2: V1 and top-label ECE, mean confidence, decisive rate; draw recall 0 if undefined."""
    base = S.normalize_probabilities(df).withColumns(row_scores(target))
    out = base.groupBy(*keys).agg(
        *_panel(target), F.avg("_top").alias("mean_confidence"), F.avg((F.col("_top") >= 0.55).cast("double")).alias("decisive_lean_rate")
    ).withColumn("draw_recall", F.coalesce("draw_recall", F.lit(0.0))).drop("rps")
    return out.join(top_label_ece(S.normalize_probabilities(df), keys, target).withColumnRenamed("ece", "calibration_error"), list(keys))


def reliability_curve(df: DataFrame, probability: str, observed: str) -> DataFrame:
    """V3: isotonic fit; one row per fitted level. Equal forecasts are pooled before the fit, rows without a forecast or an outcome are left out."""
    from matchgrain.operators.isotonic import isotonic_pools

    rows = df.select(F.col(probability).cast("double").alias("p"), F.col(observed).cast("double").alias("y")).where("p IS NOT NULL AND NOT isnan(p) AND y IS NOT NULL")
    points = rows.groupBy((F.col("p") + F.lit(0.0)).alias("p")).agg(F.sum("y").alias("hits"), F.count(F.lit(1)).cast("double").alias("weight"))
    rate = F.col("hits") / F.col("weight")
    return isotonic_pools(points).select(
        F.round(rate, 12).alias("fitted_rate"), (F.col("moment") / F.col("weight")).alias("forecast_mean"), rate.alias("observed_rate"), F.col("weight").cast("bigint").alias("count")
    )


# --- cohorts, drift ---------------------------------------------------------------


def assign_cohorts(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """V5: one row per forecast and cohort tag."""
    from matchgrain.functions.contracts import days_between, guard

    if "issued_at" in df.columns:
        df = guard(df, F.col("issued_at") < F.col("kickoff_utc"), "a forecast was issued at or after kickoff")
    at = df.agg(F.max("kickoff_utc")).scalar() if as_of is None else as_of
    has = lambda c: c in df.columns
    age = days_between(at, F.col("kickoff_utc"))
    top = F.greatest(*P3)
    decile = F.lit(0)
    for i in range(1, 10):
        decile = decile + (top > F.lit(i / 10.0)).cast("int")
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if has(c) else F.lit(default)
    early = F.coalesce(F.col("round_number") <= 5, F.lit(False)) if has("round_number") else F.lit(False)
    rest = F.coalesce(F.col("short_rest"), F.lit(False)) if has("short_rest") else F.lit(False)
    tags = [
        F.when(F.col("edition_id").isNotNull(), F.concat(F.lit("edition:"), F.col("edition_id").cast("string"))) if has("edition_id") else F.lit(None).cast("string"),
        *[F.when(age.between(0, w), F.lit(f"rolling_{w}d")) for w in (90, 180, 365)],
        F.when(early, "season:first_five_matchdays").otherwise("season:established"),
        F.concat(F.lit("history:"), text("cold_start_status", "full_history")),
        F.when(F.col("p_home") >= 0.55, "favorite:home").when(F.col("p_away") >= 0.55, "favorite:away").otherwise("favorite:balanced"),
        F.when(rest, "schedule:short_rest").otherwise("schedule:normal_rest"),
        F.concat(F.lit("phase:"), text("phase", "regular")), F.concat(F.lit("coverage:"), text("coverage_status", "full")),
        F.concat(F.lit("confidence_decile:"), decile.cast("string")),
    ]
    return df.withColumn("cohort", F.explode(F.array_distinct(F.array_compact(F.array(*tags)))))


def cohort_metrics(tagged: DataFrame, *, minimum_sample: int = 20, target: str = "target") -> DataFrame:
    """V6: V1 per cohort with a Brier standard error; small cohorts carry only a status."""
    s = _checked(tagged).withColumns(row_scores(target))
    out = s.groupBy("cohort").agg(*_panel(target), (F.stddev_samp("_brier") / F.sqrt(F.count(F.lit(1)))).alias("standard_error_brier"))
    enough = F.col("fixtures") >= minimum_sample
    kept = {c: F.when(enough, F.col(c)) for c in ("log_loss", "brier", "rps", "accuracy", "draw_recall", "standard_error_brier")}
    return out.withColumns(kept).withColumn("status", F.when(enough, "available").otherwise("insufficient_sample")).withColumnRenamed("fixtures", "n")


def population_stability_index(reference: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """V7: PSI over reference quantile bins, with severity. Edges are `bins + 1` numbers.

    Null, NaN and infinite values are left out; an empty side fails the job.
    """
    from matchgrain.functions.contracts import guard
    from matchgrain.operators.ranks import exact_quantiles

    number = F.col(value).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    reference, current = reference.where(finite), current.where(finite)
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(reference.withColumn("_z", F.lit(0)), ["_z"], value, names).select(
        F.array_sort(F.array_distinct(F.array(*names))).alias("e")
    ).scalar()
    both = reference.select(F.col(value).alias("_v"), F.lit(0).alias("_c")).unionByName(current.select(F.col(value).alias("_v"), F.lit(1).alias("_c")))
    e = both.withColumn("_e", edges)
    inner = F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0)))
    counted = e.groupBy(F.size("_e").alias("_m"), F.size(F.filter(inner, lambda x: x <= F.col("_v"))).alias("_b")).agg(
        F.count_if(F.col("_c") == 0).alias("_r"), F.count_if(F.col("_c") == 1).alias("_n")
    )
    totals = counted.agg(F.sum("_r").alias("r"), F.sum("_n").alias("n"), F.max("_m").alias("m"))
    frame = counted.sparkSession.range(bins).select(F.col("id").cast("int").alias("_b")).join(counted.drop("_m"), "_b", "left")
    share = lambda c, t: F.greatest(F.least(F.coalesce(F.col(c), F.lit(0)) / totals.select(t).scalar(), F.lit(1.0)), F.lit(1e-6))
    shares = frame.select("_b", share("_r", "r").alias("r"), share("_n", "n").alias("n"), totals.select("m").scalar().alias("m")).where(F.col("_b") < F.col("m") - 1)
    some = totals.select((F.coalesce("r", F.lit(0)) > 0) & (F.coalesce("n", F.lit(0)) > 0)).scalar()
    shares = guard(shares, some, "drift needs values on both sides")
    psi = shares.agg(F.coalesce(F.sum((F.col("n") - F.col("r")) * F.ln(F.col("n") / F.col("r"))), F.lit(0.0)).alias("psi"), F.max("m").alias("m"))
    psi = psi.select(F.when(F.col("m") < 3, 0.0).otherwise(F.col("psi")).alias("psi"))
    return psi.withColumn("severity", F.when(F.col("psi") < 0.10, "stable").when(F.col("psi") < 0.25, "watch").otherwise("action_required"))


# --- block bootstrap --------------------------------------------------------------


def _block_sums(losses: DataFrame, order, values, block_length: int):
    """(blocks by start, n, means): circular block sums of full and remainder length."""
    from matchgrain.functions.storage import cut_lineage
    from matchgrain.operators.ordered import prior_rows, prior_totals, time_bucket

    placed = cut_lineage(prior_totals(losses, [], list(order), time_bucket(order[0]), position="_pos").select("_pos", *values))
    n = placed.count()
    if n < 2 or not 1 <= block_length <= n:
        raise ValueError("invalid block dimensions")
    blocks = -(-n // block_length)
    rest = n - (blocks - 1) * block_length
    wrapped = placed.unionByName(placed.where(F.col("_pos") < block_length).withColumn("_pos", F.col("_pos") + n))

    def sums(spec):
        out = {}
        for v in values:
            out[f"_full_{v}"] = F.sum(v).over(spec.rowsBetween(-(block_length - 1), 0))
            # remainder of the same block: its first `rest` rows
            out[f"_rest_{v}"] = F.sum(v).over(spec.rowsBetween(-(block_length - 1), -(block_length - rest)))
        return out

    summed = prior_rows(wrapped, [], ["_pos"], F.col("_pos"), sums, lookback=block_length, position="_pos")
    by_start = summed.where(F.col("_pos") >= block_length).withColumn("_start", F.col("_pos") - block_length)
    return by_start.drop("_pos", *values), n, blocks, placed


#: Block starts dealt to one segment at most, and draws of one segment over all replicates, about.
SEGMENT, SEGMENT_DRAWS = 4096, 4_000_000
#: Nodes of the tree are numbered from 1; this key draws the remainder blocks.
_REMAINDER_KEY = 0


def _random(seed: int, node: int, kind: int):
    import numpy as np

    return np.random.Generator(np.random.Philox(key=[(seed << 2 | kind) & (1 << 64) - 1, node]))


def segment_draws(seed: int, segment: int, segments: int, size: int, n: int, blocks: int, repetitions: int, known: dict):
    """Draws of every replicate that fall into one segment of the block starts.

    A binomial splitting tree over the segments: a node deals its replicates' draws to its two halves by the starts that each has, with
    random numbers that belong to the node. So a segment walks down from the root and needs to know nothing of the others; over all segments
    the draws of a replicate are `blocks`, and together they are multinomial. `known` keeps the nodes on the way.
    """
    import numpy as np

    low, high, node, counts = 0, segments, 1, np.full(repetitions, blocks, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = (min(middle * size, n) - low * size) / (min(high * size, n) - low * size)
        if node not in known:
            known[node] = _random(seed, node, 1).binomial(counts, share)
        left = known[node]
        low, high, node, counts = (low, middle, 2 * node, left) if segment < middle else (middle, high, 2 * node + 1, counts - left)
    return counts


def _replicate_sums(batches, seed: int, size: int, n: int, blocks: int, repetitions: int, values: list[str]):
    """Sums of the drawn blocks for each replicate, over the segments of a partition (rows lie in order of their start)."""
    import numpy as np
    import pyarrow as pa

    segments = -(-n // size)
    sums, drawn = np.zeros((len(values), repetitions)), np.zeros(repetitions, np.int64)
    ends = _random(seed, _REMAINDER_KEY, 0).integers(0, n, repetitions)  # start of each replicate's last block, which may be shorter
    known: dict = {}
    held: list = []

    def close():
        table = pa.Table.from_batches(held)
        start = table.column("_start").to_numpy()
        segment, first = int(start[0]) // size, int(start[0])
        full, rest = (np.stack([table.column(f"_{kind}_{v}").to_numpy() for v in values]) for kind in ("full", "rest"))
        counts = segment_draws(seed, segment, segments, size, n, blocks - 1, repetitions, known)
        edges = np.append(0, np.cumsum(counts))
        picks = _random(seed, segment, 2).integers(0, len(start), edges[-1])
        for k in range(len(values)):
            total = np.append(0.0, np.cumsum(full[k][picks]))
            sums[k] += total[edges[1:]] - total[edges[:-1]]
        here = np.flatnonzero((ends >= first) & (ends < first + len(start)))
        sums[:, here] += rest[:, ends[here] - first]
        drawn[here] += 1
        drawn[:] += counts
        held.clear()
        if len(known) > 64:
            known.clear()

    last = None
    for batch in batches:
        segment = batch.column(batch.schema.get_field_index("_start")).to_numpy() // size
        cuts = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(segment)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                if last is not None and segment[a] != last:
                    close()
                held.append(batch.slice(a, b - a))
                last = segment[a]
    if held:
        close()
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(repetitions, dtype=np.int32)), pa.array(drawn), *[pa.array(x) for x in sums]], ["replicate", "_blocks", *values])


def block_bootstrap(losses: DataFrame, order, values, *, block_length: int, repetitions: int, seed: int) -> tuple[DataFrame, int, DataFrame]:
    """Replicate means of each value under a circular block bootstrap; `_blocks` counts the blocks of a replicate.

    Block starts are cut into segments, and the number of a replicate's draws in a segment comes from a splitting tree
    (`segment_draws`). A partition draws for all replicates and its segments and adds up before the shuffle: one row for each partition and
    replicate, whatever the number of rows; nothing is joined.
    """
    starts, n, blocks, placed = _block_sums(losses, order, values, block_length)
    values = list(values)
    size = int(max(64, min(SEGMENT, SEGMENT_DRAWS * block_length // repetitions)))
    columns = ["_start", *[f"_{kind}_{v}" for kind in ("full", "rest") for v in values]]
    dealt = starts.select(*columns).repartition(F.floor(F.col("_start") / size)).sortWithinPartitions("_start")
    schema = "replicate int, _blocks long, " + ", ".join(f"`{v}` double" for v in values)
    parts = dealt.mapInArrow(lambda b: _replicate_sums(b, seed, size, n, blocks, repetitions, values), schema)
    means = parts.groupBy("replicate").agg(F.sum("_blocks").alias("_blocks"), *[(F.sum(v) / n).alias(v) for v in values])
    return means, n, placed


def paired_block_interval(df: DataFrame, benchmark: str, candidate: str, *, order=("kickoff_utc", "fixture_id"), block_length: int, repetitions: int = 5000, seed: int = 20260810, alpha: float = 0.05) -> DataFrame:
    """V8: mean loss advantage of the candidate with a block-bootstrap interval."""
    from matchgrain.operators.ranks import exact_quantiles

    if repetitions < 1 or not 0 < alpha < 1:
        raise ValueError("invalid bootstrap configuration")
    rows = df.select(*order, (F.col(benchmark) - F.col(candidate)).alias("advantage"))
    means, _, placed = block_bootstrap(rows, order, ["advantage"], block_length=block_length, repetitions=repetitions, seed=seed)
    bounds = exact_quantiles(means.withColumn("_z", F.lit(0)), ["_z"], "advantage", {"lower": alpha / 2, "upper": 1 - alpha / 2})
    return bounds.select(placed.agg(F.avg("advantage")).scalar().alias("point"), "lower", "upper")


def reality_check(df: DataFrame, advantages, *, order=("kickoff_utc", "fixture_id"), block_length: int, repetitions: int = 5000, seed: int = 20260810) -> DataFrame:
    """V9: max-statistic test that no candidate beats the benchmark."""
    rows = df.select(*order, *advantages)
    means, n, placed = block_bootstrap(rows, order, list(advantages), block_length=block_length, repetitions=repetitions, seed=seed)
    centre = {v: placed.agg(F.avg(v)).scalar() for v in advantages}
    parts = [F.col(v) - centre[v] for v in advantages]
    worst = F.greatest(*parts) if len(parts) > 1 else parts[0]
    points = [centre[v] for v in advantages]
    best = F.greatest(*points) if len(points) > 1 else points[0]
    root = float(n) ** 0.5
    hits = means.select((worst * root).alias("_s"), (best * root).alias("observed_statistic"))
    return hits.agg(
        F.max("observed_statistic").alias("observed_statistic"),
        ((F.lit(1) + F.count_if(F.col("_s") >= F.col("observed_statistic"))) / F.lit(float(repetitions + 1))).alias("p_value"),
    )


def release_gate(champion: DataFrame, challenger: DataFrame, *, champion_id: str, challenger_id: str, coherence_passed: bool, operations_passed: bool, block_length: int = 8, repetitions: int = 2000, ece_limit: float = 0.05, cohort_limit: float = 0.02, seed: int = 20260810) -> DataFrame:
    """One decision row from scores, bootstrap, calibration, cohorts and flags.

    Both sides need fixture_id, kickoff_utc, target and probabilities; a `cohort` column on the
    champion switches the cohort check on. Cohorts under 20 rows are not judged; cohorts_skipped says how many. Different
    coverage or targets fail the job.
    """
    from matchgrain.functions.contracts import guard
    from matchgrain.functions.storage import cut_lineage

    cohort = [F.col("cohort")] if "cohort" in champion.columns else [F.lit(None).cast("string").alias("cohort")]
    a = champion.select("fixture_id", "kickoff_utc", F.col("target").alias("_ya"), *cohort, *[F.col(c).alias(f"a_{c}") for c in P3])
    b = challenger.select("fixture_id", F.col("target").alias("_yb"), *[F.col(c).alias(f"b_{c}") for c in P3])
    joined = a.join(b, "fixture_id", "full")
    joined = guard(joined, F.col("_ya").isNotNull() & F.col("_yb").isNotNull(), "champion and challenger cover different fixtures")
    joined = guard(joined, F.col("_ya") == F.col("_yb"), "one fixture has two different results").withColumnRenamed("_ya", "target")
    scored = joined
    for side in ("a", "b"):
        s = row_scores("target", tuple(f"{side}_{c}" for c in P3))
        scored = scored.withColumns({f"_{side}_ll": s["_log_loss"], f"_{side}_br": s["_brier"]})
    scored = cut_lineage(scored.withColumn("advantage", F.col("_a_ll") - F.col("_b_ll")))
    means, _, _ = block_bootstrap(scored.select("kickoff_utc", "fixture_id", "advantage"), ("kickoff_utc", "fixture_id"), ["advantage"], block_length=block_length, repetitions=repetitions, seed=seed)
    better = means.agg(F.avg((F.col("advantage") > 0).cast("double"))).scalar()
    eces = [
        expected_calibration_error(scored.withColumn("_o", F.col("target") == i), f"b_{c}", "_o").scalar() for i, c in enumerate(P3)
    ]
    worse = scored.where("cohort IS NOT NULL").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_b_br") - F.col("_a_br")).alias("d"))
    worse = cut_lineage(worse)
    bad = worse.where((F.col("n") >= 20) & (F.col("d") > cohort_limit)).agg(F.count(F.lit(1))).scalar()
    skipped = worse.where(F.col("n") < 20).agg(F.count(F.lit(1))).scalar()
    out = scored.agg(
        ((F.avg("_b_ll") < F.avg("_a_ll")) & (F.avg("_b_br") < F.avg("_a_br"))).alias("primary_score_improved"),
    ).select(
        F.lit(champion_id).alias("champion_model_id"), F.lit(challenger_id).alias("challenger_model_id"), "primary_score_improved",
        better.alias("paired_probability_better"), (F.greatest(*eces) <= ece_limit).alias("calibration_passed"), (bad == 0).alias("cohorts_passed"), skipped.alias("cohorts_skipped"),
        F.lit(coherence_passed).alias("coherence_passed"), F.lit(operations_passed).alias("operations_passed"),
    )
    passed = F.col("primary_score_improved") & (F.col("paired_probability_better") >= 0.90)
    for c in ("calibration_passed", "cohorts_passed", "coherence_passed", "operations_passed"):
        passed = passed & F.col(c)
    return out.withColumn("status", F.when(passed, "passed").otherwise("failed")).withColumn(
        "reason", F.when(passed, "all release gates passed").otherwise("one or more release gates failed")
    )


# --- selection, scaling, intervals ------------------------------------------------


def select_half_life(fold_scores: DataFrame) -> DataFrame:
    """Candidate half-life with the lowest mean fold score (half_life, fold, score)."""
    means = fold_scores.groupBy("half_life").agg(F.avg("score").alias("mean_score"))
    return means.agg(F.min_by("half_life", F.struct("mean_score", "half_life")).alias("half_life"), F.min("mean_score").alias("mean_score"))


def apply_temperature(df: DataFrame, temperature, p=P3) -> DataFrame:
    """softmax(log p / T)."""
    t = F.lit(temperature) if isinstance(temperature, float) else temperature
    powered = [F.pow(F.greatest(F.col(c), F.lit(1e-15)), 1 / t) for c in p]
    total = powered[0] + powered[1] + powered[2]
    return df.withColumns({c: x / total for c, x in zip(p, powered)})


def fit_temperature(df: DataFrame, target: str = "target") -> DataFrame:
    """T in [.25, 4] with the lowest log loss: a coarse grid and two refinements.

    Every grid point is one average in a single pass; nothing but the best T moves on.
    """
    def best(steps: Column, value: Column) -> Column:
        rows = df.select(*P3, target, F.explode(steps).alias("_i")).withColumn("_t", value)
        loss = apply_temperature(rows, F.col("_t")).withColumn("_l", row_scores(target)["_log_loss"])
        per = loss.groupBy("_t").agg(F.avg("_l").alias("_l"))
        return per.agg(F.min_by("_t", F.struct("_l", "_t"))).scalar()

    t = best(F.sequence(F.lit(0), F.lit(30)), F.lit(0.25) + F.col("_i") * 0.125)
    for step in (0.0125, 0.00125):
        t = best(F.sequence(F.lit(-10), F.lit(10)), F.greatest(F.lit(0.25), F.least(F.lit(4.0), t + F.col("_i") * step)))
    return df.sparkSession.range(1).select(t.alias("temperature"))


def forecast_intervals(draws: DataFrame, keys=("fixture_id",)) -> DataFrame:
    """Per fixture quantiles of each outcome over draws, and leader stability: one grouping.

    draws: keys, draw, p_home, p_draw, p_away. A fixture's state is its distinct draws, a number the caller sets.
    """
    names = {"lower_80": 0.1, "lower_50": 0.25, "median": 0.5, "upper_50": 0.75, "upper_80": 0.9}
    lead = S.leader(*P3)
    levels = F.array(*[F.lit(q) for q in names.values()])
    grouped = S.normalize_probabilities(draws).groupBy(*keys).agg(
        *[F.percentile(c, levels).alias(f"_q{i}") for i, c in enumerate(P3)], *[F.avg((lead == i).cast("double")).alias(f"_l{i}") for i in range(3)]
    )
    medians = [F.col(f"_q{i}")[2] for i in range(3)]
    point = F.when((medians[0] >= medians[1]) & (medians[0] >= medians[2]), F.col("_l0")).when(medians[1] >= medians[2], F.col("_l1")).otherwise(F.col("_l2"))
    rows = F.array(*[F.struct(F.lit(i).alias("outcome"), *[F.col(f"_q{i}")[k].alias(n) for k, n in enumerate(names)]) for i in range(3)])
    return grouped.withColumn("leader_stability", point).select(*keys, "leader_stability", F.inline(rows))


def interval_coverage(intervals: DataFrame, targets: DataFrame, keys=("fixture_id",), level: str = "80") -> DataFrame:
    """Share of outcomes whose 0/1 truth lies inside the interval, per outcome."""
    t = (F.col("target") == F.col("outcome")).cast("double")
    inside = (t >= F.col(f"lower_{level}")) & (t <= F.col(f"upper_{level}"))
    return intervals.join(targets, list(keys)).groupBy("outcome").agg(F.avg(inside.cast("double")).alias("coverage"))


def binary_market_calibration(df: DataFrame, markets, keys=("model_id", "edition_id")) -> DataFrame:
    """Brier and ECE per binary market; `markets` maps a name to (probability, truth) columns."""
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("market"), F.col(p).alias("p"), F.col(y).cast("double").alias("y")) for m, (p, y) in markets.items()
    ])))
    k = [*keys, "market"]
    brier = long.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier"))
    return brier.join(expected_calibration_error(long, "p", "y", k), k)


def feature_set_comparison(fold_scores: DataFrame) -> DataFrame:
    """(fold, score_a, score_b) to means, population spreads, delta and paired t statistic."""
    d = F.col("score_b") - F.col("score_a")
    n = F.count(F.lit(1))
    return fold_scores.agg(
        F.avg("score_a").alias("mean_a"), F.stddev_pop("score_a").alias("std_a"), F.avg("score_b").alias("mean_b"), F.stddev_pop("score_b").alias("std_b"),
        F.avg(d).alias("delta"), (F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(n), F.lit(0.0))).alias("t_statistic"),
    )


def class_report(df: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """Precision and recall per class."""
    long = df.select(F.inline(F.array(
        F.struct(F.col(label).alias("class"), F.lit(1).alias("is_label"), (F.col(label) == F.col(prediction)).cast("int").alias("hit")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).alias("is_label"), (F.col(label) == F.col(prediction)).cast("int").alias("hit")),
    )))
    part = lambda is_label: F.avg(F.when(F.col("is_label") == is_label, F.col("hit").cast("double")))
    return long.groupBy("class").agg(F.coalesce(part(0), F.lit(0.0)).alias("precision"), F.coalesce(part(1), F.lit(0.0)).alias("recall"), F.sum("is_label").alias("support"))
