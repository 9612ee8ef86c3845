"""Spark ML models over point-in-time features."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.scalars import covariate_differences
from matchgrain.functions.storage import cut_lineage
from matchgrain.operators import evaluation as V
from matchgrain.operators import windows as W
from matchgrain.operators.aggregates import imputation_means, impute, with_means

P3 = V.P3


def training_matrix(df: DataFrame, features: Sequence[str], date: str = "kickoff_utc", *, label: str = "target", test_size=0.2, calibration_size=0.2) -> DataFrame:
    """Chronological parts, training means for missing values, one vector in contract order.

    `df` is read several times and not written: pass a stored table. Only its row of means is cut off here.
    """
    parts = W.chronological_split(df, date, test_size=test_size, calibration_size=calibration_size)
    parts = parts.withColumns({f: F.col(f).cast("double") for f in features})
    filled = with_means(parts, cut_lineage(imputation_means(parts.where("part = 'train'"), features)), features)
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(filled).select("*").withColumn(label, F.col(label).cast("double"))


def feature_contract(train: DataFrame, features: Sequence[str]) -> dict:
    """Ordered names and training means: a few numbers for the driver."""
    row = train.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return {"feature_names": list(features), "imputation_values": {f: float(row[f"m{i}"]) for i, f in enumerate(features)}}


def rank_covariate_fit(matches: DataFrame, features=("rank_difference", "elo_difference", "rest_difference", "form_difference"), *, cutoff: Column, alpha: float = 0.1) -> tuple[PipelineModel, PipelineModel]:
    """Two Poisson regressions on standardised differences, from results of matches that began before `cutoff`.

    Fewer of these than max(4, features + 1) are an error.
    """
    past = matches.where((F.col("kickoff_utc") < cutoff) & F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
    rows = cut_lineage(covariate_differences(past).select(*features, "home_goals", "away_goals"))
    least = max(4, len(features) + 1)
    if (n := rows.count()) < least:
        raise ValueError(f"{n} results before the cut-off are too few, {least} are needed")
    models = []
    for side in ("home", "away"):
        stages = [
            VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error"), StandardScaler(withMean=True, inputCol="_raw", outputCol="_x"),
            GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_x", labelCol=f"{side}_goals", predictionCol=f"{side}_rate", regParam=alpha, maxIter=15),
        ]
        models.append(Pipeline(stages=stages).fit(rows))
    return models[0], models[1]


def rank_covariate_rates(models: tuple[PipelineModel, PipelineModel], df: DataFrame) -> DataFrame:
    """home_rate and away_rate of any fixtures, 1e-6 at least."""
    out = covariate_differences(df)
    for m in models:
        out = m.transform(out).drop("_raw", "_x")
    return out.withColumns({c: F.greatest(F.col(c), F.lit(1e-6)) for c in ("home_rate", "away_rate")})


def no_market_classifier(features: str = "features", label: str = "target", *, rows: int, c: float = 0.2, max_iter: int = 50) -> Pipeline:
    """Standardised multinomial logistic regression with inverse strength `c` on `rows` training rows."""
    return Pipeline(stages=[
        StandardScaler(withMean=True, inputCol=features, outputCol="_x"),
        LogisticRegression(family="multinomial", featuresCol="_x", labelCol=label, regParam=1.0 / (c * rows), maxIter=max_iter),
    ])


def with_probabilities(model, df: DataFrame, prefix: str = "p_", column: str = "probability") -> DataFrame:
    """Model output as home / draw / away columns."""
    out = model.transform(df)
    arr = vector_to_array(column)
    made = [f"{prefix}{n}" for n in ("home", "draw", "away")]
    keep = [c for c in out.columns if c not in ("rawPrediction", column, "prediction", "_x", "_raw", *made)]
    return out.select(*keep, *[arr[i].alias(f"{prefix}{n}") for i, n in enumerate(("home", "draw", "away"))])


def tree_ensemble(train: DataFrame, df: DataFrame, *, label: str = "target", trees: int = 20, boost_iterations: int = 5, seed: int = 7) -> DataFrame:
    """Mean of forest, boosted-tree and logistic probabilities."""
    n = train.count()
    forest = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=5, seed=seed).fit(train)
    boost = OneVsRest(classifier=GBTClassifier(maxIter=boost_iterations, maxDepth=3, seed=seed), labelCol=label).fit(train)
    logistic = no_market_classifier(label=label, rows=n).fit(train)
    out = with_probabilities(forest, df, "_f_")
    out = with_probabilities(logistic, out, "_l_")
    scored = boost.transform(out).withColumn("_r", vector_to_array("rawPrediction"))
    soft = [1 / (1 + F.exp(-2 * F.col("_r")[i])) for i in range(3)]
    total = soft[0] + soft[1] + soft[2]
    parts = {f"p_{s}": (F.col(f"_f_{s}") + F.col(f"_l_{s}") + soft[i] / total) / 3 for i, s in enumerate(("home", "draw", "away"))}
    scored = scored.withColumns(parts)
    return scored.drop("_r", "rawPrediction", "prediction", *[f"_{k}_{s}" for k in "fl" for s in ("home", "draw", "away")])


def feed_forward_classifier(train: DataFrame, df: DataFrame, *, layers=(128, 64, 32), label: str = "target", max_iter: int = 30, seed: int = 7) -> DataFrame:
    """Dense net with three classes."""
    width = len(train.select("features").first()["features"])
    scaler = StandardScaler(withMean=True, inputCol="features", outputCol="_x")
    net = MultilayerPerceptronClassifier(layers=[width, *layers, 3], featuresCol="_x", labelCol=label, maxIter=max_iter, seed=seed)
    return with_probabilities(Pipeline(stages=[scaler, net]).fit(train), df)


def probability_stack(
    components: Mapping[str, DataFrame], labels: DataFrame, predict: Mapping[str, DataFrame] | None = None, *, mode: str = "regression", minimum_rows: int = 120, c: float = 0.2
) -> DataFrame:
    """Fit on labelled fixtures, predict those of `predict` (other component tables; without it, the same ones).

    mode `regression`: logistic regression of inverse strength `c` on the log component probabilities, which are kept
    above 1e-8 and renormalised; fewer than `minimum_rows` labelled fixtures are an error. mode `best`: the component of
    the lowest log loss. The mode is a column of the result.
    """
    if mode not in ("regression", "best"):
        raise ValueError(f"unknown stacking mode {mode!r}")
    target = components if predict is None else predict

    def logs(tables: Mapping[str, DataFrame], base: DataFrame) -> DataFrame:
        for name, df in tables.items():
            kept = [F.greatest(F.col(p), F.lit(1e-8)) for p in P3]
            total = kept[0] + kept[1] + kept[2]
            base = base.join(df.select("fixture_id", *[F.ln(k / total).alias(f"{name}_{p}") for k, p in zip(kept, P3)]), "fixture_id")
        return VectorAssembler(inputCols=[f"{n}_{p}" for n in components for p in P3], outputCol="features").transform(base)

    if mode == "best":
        scored = [df.join(labels, "fixture_id").withColumns(V.row_scores()).agg(F.avg("_log_loss").alias("l")).withColumn("m", F.lit(n)) for n, df in components.items()]
        table = scored[0]
        for s in scored[1:]:
            table = table.unionAll(s)
        best = table.agg(F.min_by("m", "l").alias("m")).first()["m"]
        return target[best].select("fixture_id", *P3, F.lit(mode).alias("mode"))
    rows = cut_lineage(logs(components, labels).withColumn("target", F.col("target").cast("double")))
    n = rows.count()
    if n < minimum_rows:
        raise ValueError(f"{n} labelled fixtures are too few to stack, {minimum_rows} are needed")
    model = LogisticRegression(family="multinomial", labelCol="target", maxIter=50, regParam=1.0 / (c * n)).fit(rows)
    wanted = next(iter(target.values())).select("fixture_id")
    return with_probabilities(model, logs(target, wanted)).select("fixture_id", *P3, F.lit(mode).alias("mode"))


def permutation_importance(model, df: DataFrame, features: Sequence[str], columns: Sequence[str] | None = None, *, label: str = "target", repeats: int = 2, seed: int = 11) -> DataFrame:
    """Accuracy drop when one column is shuffled, mean and spread over repeats.

    Rows are numbered once; a shuffle gives row r the value of the row that a keyed permutation takes to r, so it is one equi-join
    and no sort. `features` vectors are rebuilt.
    """
    from matchgrain.operators.permute import permuted, row_numbers

    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    hit = lambda d: model.transform(assembler.transform(d)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("s"))
    numbered, n = row_numbers(df.select("fixture_id", label, *features), "_r")
    first = cut_lineage(numbered)
    whole = hit(first)
    scores = None
    for i, f in enumerate(columns or features):
        for r in range(repeats):
            other = first.select(permuted(F.col("_r"), n, seed + i * repeats + r).alias("_r"), F.col(f).alias("_v"))
            mixed = first.join(other, "_r").withColumn(f, F.col("_v")).drop("_v", "_r")
            row = hit(mixed).select(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), F.col("s"))
            scores = row if scores is None else scores.unionAll(row)
    reference = F.lit(float(whole.first()["s"]))
    return scores.groupBy("feature").agg(F.avg(reference - F.col("s")).alias("importance_mean"), F.stddev_pop(F.col("s")).alias("importance_std"))


def hyperparameter_search(df: DataFrame, make: Callable[[dict, int], object], space: Mapping[str, Sequence], *, date: str, samples: int = 10, n_splits: int = 3, label: str = "target", seed: int = 42) -> DataFrame:
    """Random search over expanding time folds; every fit is a distributed job.

    `make(params, rows)` gives an estimator for a candidate and the number of its training rows.
    """
    rng = random.Random(seed)
    grid = [{k: rng.choice(list(v)) for k, v in space.items()} for _ in range(samples)]
    tagged = cut_lineage(W.assign_folds(df, W.rolling_origin_folds(df, date, n_splits=n_splits), date))
    sizes = {r["fold"]: r["n"] for r in tagged.where("role = 'train'").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = None
    for i, params in enumerate(grid):
        for fold in range(n_splits):
            part = tagged.where(F.col("fold") == fold)
            model = make(params, sizes[fold]).fit(part.where("role = 'train'"))
            scored = with_probabilities(model, part.where("role = 'test'")).withColumns(V.row_scores(label))
            row = scored.agg(F.avg("_log_loss").alias("log_loss")).select(F.lit(i).alias("candidate"), F.lit(json.dumps(params, sort_keys=True)).alias("params"), F.lit(fold).alias("fold"), "log_loss")
            out = row if out is None else out.unionAll(row)
    return out.groupBy("candidate", "params").agg(F.avg("log_loss").alias("mean_log_loss"))


def evaluate_candidate(matches: DataFrame, folds: Sequence[tuple], fit_predict: Callable[[DataFrame, DataFrame], DataFrame], *, date: str = "kickoff_utc") -> DataFrame:
    """Per fold fit on rows before the cutoff and score the window; one ledger row per fixture.

    `folds` are (cutoff, end) column pairs; `fit_predict(train, test)` adds probabilities.
    A fixture evaluated twice fails the job.
    """
    from matchgrain.functions.contracts import guard

    out = None
    for i, (cutoff, end) in enumerate(folds):
        train = matches.where(F.col(date) < cutoff)
        test = matches.where((F.col(date) >= cutoff) & (F.col(date) < end))
        scored = fit_predict(train, test).withColumn("fold", F.lit(i))
        out = scored if out is None else out.unionByName(scored)
    counted = out.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*[c for c in out.columns if c != "fixture_id"])).alias("_r"))
    return guard(counted, F.col("_n") == 1, "a fixture was evaluated twice").select("fixture_id", "_r.*")


def goal_rate_metrics(df: DataFrame) -> DataFrame:
    """MAE and RMSE of rates, with accuracy and Brier of the 1X2."""
    e = [F.col("home_rate") - F.col("home_goals"), F.col("away_rate") - F.col("away_goals")]
    s = df.withColumns(V.row_scores())
    return s.agg(
        F.count(F.lit(1)).alias("matches"), F.avg((F.abs(e[0]) + F.abs(e[1])) / 2).alias("mae"), F.sqrt(F.avg((e[0] * e[0] + e[1] * e[1]) / 2)).alias("rmse"),
        F.avg((F.col("_lead") == F.col("target")).cast("double")).alias("accuracy"), F.avg("_brier").alias("brier"),
    )


def class_prior(train: DataFrame, test: DataFrame, label: str = "target") -> DataFrame:
    """Training class shares as the forecast of every test row."""
    share = train.agg(*[F.avg((F.col(label) == i).cast("double")).alias(c) for i, c in enumerate(P3)])
    return test.withColumns({c: share.select(c).scalar() for c in P3})


def feature_ablation(df: DataFrame, feature_sets: Mapping[str, Sequence[str]], *, date: str, n_splits: int = 3, label: str = "target", poisson: DataFrame | None = None) -> DataFrame:
    """Class prior, feature sets and walk-forward Poisson on the same time folds.

    Missing values take fold-train means. The gate asks for a better log loss and Brier than
    the prior.
    """
    tagged = cut_lineage(W.assign_folds(df, W.rolling_origin_folds(df, date, n_splits=n_splits), date))
    parts = []

    def keep(name: str, scored: DataFrame) -> None:
        parts.append(scored.select(F.lit(name).alias("candidate"), F.col(label).alias("target"), *P3))

    for fold in range(n_splits):
        train, test = (tagged.where((F.col("fold") == fold) & (F.col("role") == r)) for r in ("train", "test"))
        rows = train.count()
        keep("class_prior", class_prior(train, test, label))
        for name, features in feature_sets.items():
            fill = lambda d: VectorAssembler(inputCols=list(features), outputCol="features").transform(impute(d, train, features))  # noqa: E731,B023
            model = no_market_classifier(label=label, rows=rows).fit(fill(train))
            keep(name, with_probabilities(model, fill(test)))
        if poisson is not None:
            keep("walk_forward_poisson", test.drop(*P3).join(poisson.select("fixture_id", *P3), "fixture_id"))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionAll(p)
    scores = V.proper_scores(stacked, ["candidate"]).drop("draw_recall")
    prior = scores.where("candidate = 'class_prior'")
    better = (F.col("log_loss") < prior.select("log_loss").scalar()) & (F.col("brier") < prior.select("brier").scalar())
    return scores.withColumn("passes_gate", better)


def experiment_log(spec: Mapping, results: DataFrame) -> DataFrame:
    """Candidate rows with the hash of the frozen spec and a coverage flag."""
    digest = hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()
    most = results.agg(F.max("fixtures")).scalar()
    return results.withColumn("experiment_id", F.lit(spec.get("experiment_id", ""))).withColumn("spec_hash", F.lit(digest)).withColumn("coverage_complete", F.col("fixtures") == most)
