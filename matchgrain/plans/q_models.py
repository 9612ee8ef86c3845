"""Rating and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrain.operators import ledger
from matchgrain.operators import models as L
from matchgrain.operators import ratings as R
from matchgrain.plans.q_grids import walk_forward
from matchgrain.plans.registry import query, rounded

FORM = ["home_history_n", "away_history_n", "home_points_l5", "away_points_l5", "home_goal_diff_l10", "away_goal_diff_l10"]


def features(b):
    """Completed matches with point-in-time form columns and the target.

    They lie where their join by fixture leaves them, in order of the fixtures: the samples of R7's trees are drawn by partition and place.
    """
    def build():
        state = ledger.match_feature_snapshots(ledger.prior_team_state(ledger.team_events(b.matches)))
        target = b.scored.select("fixture_id", "target", "kickoff_utc", "p_home", "p_draw", "p_away")
        return target.join(state.select("fixture_id", *FORM), "fixture_id").withColumn("day", F.col("kickoff_utc").cast("date")).sortWithinPartitions("fixture_id")

    return b.stored("features", build)


def matrix(b):
    return b.stored("matrix", lambda: L.training_matrix(features(b), FORM))


@query("r1_elo_history")
def r1(b):
    return rounded(R.rating_history(b.matches, season_regression=0.0).select("fixture_id", *R.rating_columns()), 4)


@query("r2_elo_season_regression")
def r2(b):
    return rounded(R.rating_history(b.matches).select("fixture_id", *R.rating_columns()), 4)


@query("r3_alternative_ratings")
def r3(b):
    parts = [R.rating_history(b.matches, s).select(F.lit(s).alias("system"), "fixture_id", *R.rating_columns()) for s in ("glicko", "pi", "dynamic")]
    return rounded(parts[0].unionAll(parts[1]).unionAll(parts[2]), 4)


@query("r4_team_goal_strengths")
def r4(b):
    s = R.team_goal_strengths(b.matches)
    rho = R.fit_low_score_rho(R.strength_rates(b.completed, s))
    return rounded(s.drop("residual").join(rho, "league_id"))


@query("r5_rank_covariate_goals")
def r5(b):
    m = b.completed.select("fixture_id", "kickoff_utc", "home_goals", "away_goals", (F.col("home_team_id") % 20).alias("home_rank"), (F.col("away_team_id") % 20).alias("away_rank"),
                           (F.col("home_team_id") % 300).alias("home_elo"), (F.col("away_team_id") % 300).alias("away_elo"))
    names = ("rank_difference", "elo_difference")
    cutoff = F.lit("1998-01-01").cast("timestamp_ntz")
    later = m.where(F.col("kickoff_utc") >= cutoff)
    return rounded(L.rank_covariate_rates(L.rank_covariate_fit(m, names, cutoff=cutoff), later).select("fixture_id", "home_rate", "away_rate"))


@query("r6_no_market_classifier")
def r6(b):
    x = matrix(b)
    train = x.where("part = 'train'")
    return rounded(L.with_probabilities(L.no_market_classifier(rows=train.count()).fit(train), x.where("part = 'test'")).select("fixture_id", *L.P3))


@query("r7_tree_ensemble")
def r7(b):
    x = matrix(b)
    return rounded(L.tree_ensemble(x.where("part = 'train'").drop(*L.P3), x.where("part = 'test'").drop(*L.P3), trees=10, boost_iterations=3).select("fixture_id", *L.P3))


@query("r8_feed_forward_classifier")
def r8(b):
    x = matrix(b).drop(*L.P3)
    return rounded(L.feed_forward_classifier(x.where("part = 'train'"), x.where("part = 'test'"), layers=(16, 8), max_iter=15).select("fixture_id", *L.P3))


@query("r9_probability_stack")
def r9(b):
    from matchgrain.operators.evaluation import apply_temperature

    labels = b.scored.select("fixture_id", "target")
    return rounded(L.probability_stack({"a": b.scored.select("fixture_id", *L.P3), "b": apply_temperature(b.scored, 2.0).select("fixture_id", *L.P3)}, labels))


@query("r10_permutation_importance")
def r10(b):
    x = matrix(b).drop(*L.P3)
    train = x.where("part = 'train'")
    model = L.no_market_classifier(rows=train.count()).fit(train)
    return L.permutation_importance(model, x.where("part = 'test'"), FORM, repeats=2)


@query("r11_hyperparameter_search")
def r11(b):
    x = matrix(b).drop("part", *L.P3)
    return L.hyperparameter_search(x, lambda p, n: L.no_market_classifier(rows=n, c=p["c"], max_iter=10), {"c": [0.05, 0.2, 1.0]}, date="day", samples=2, n_splits=2)


@query("r12_training_matrix")
def r12(b):
    x = matrix(b)
    return x.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("v14_evaluate_candidate")
def v14(b):
    from matchgrain.operators.grids import fixed_poisson_grid, one_x_two

    def fit_predict(train, test):
        rated = R.strength_rates(test, R.team_goal_strengths(train)).select("fixture_id", "home_rate", "away_rate", "home_goals", "away_goals")
        return rated.join(one_x_two(fixed_poisson_grid(rated)), "fixture_id")

    at = lambda s: F.lit(s).cast("timestamp_ntz")
    ev = L.evaluate_candidate(b.completed, [(at("1999-01-01"), at("2000-01-01")), (at("2000-01-01"), at("2001-01-01"))], fit_predict)
    return rounded(L.goal_rate_metrics(ev.join(b.scored.select("fixture_id", "target"), "fixture_id")))


@query("v15_feature_ablation")
def v15(b):
    poisson = b.stored("walk-forward", lambda: walk_forward(b))
    return rounded(L.feature_ablation(features(b).drop(*L.P3), {"form": FORM}, date="day", n_splits=2, poisson=poisson))


@query("v16_experiment_log")
def v16(b):
    from matchgrain.operators.evaluation import proper_scores

    spec = {"experiment_id": "e1", "metric": "log_loss", "tuning_end": "1999-01-01"}
    return rounded(L.experiment_log(spec, proper_scores(b.scored)))
