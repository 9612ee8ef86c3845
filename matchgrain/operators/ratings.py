"""Rating histories and goal-strength fits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import copysign, exp, log1p, log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.contracts import days_between, guard
from matchgrain.functions.storage import cut_lineage, kept_dealt, rewritten
from matchgrain.operators.grids import dc_tau

# A rating system is (start value, update, regress). `update` returns the two new ratings;
# `extra` is a per-team dict that a system may use for deviations.


def elo_update(home: float, away: float, hg: int, ag: int, extra: dict, ids, *, k=24.0, edge=55.0) -> tuple[float, float]:
    expected = 1.0 / (1.0 + 10.0 ** ((away - home - edge) / 400.0))
    gap = abs(hg - ag)
    weight = 1.0 if gap <= 1 else 1.0 + 0.5 * log10(gap)
    score = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
    change = k * weight * (score - expected)
    return home + change, away - change


def glicko_update(home: float, away: float, hg: int, ag: int, extra: dict, ids) -> tuple[float, float]:
    """The expectation is taken once, before either side moves."""
    expected = 1.0 / (1.0 + 10.0 ** ((away - home - 55.0) / 400.0))
    score = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
    out = []
    for team, rating, sign in ((ids[0], home, 1.0), (ids[1], away, -1.0)):
        deviation = extra.get(team, 350.0)
        step = max(8.0, min(32.0, deviation / 12.0))
        out.append(rating + sign * step * (score - expected))
        extra[team] = max(60.0, deviation * 0.97)
    return out[0], out[1]


def pi_update(home: float, away: float, hg: int, ag: int, extra: dict, ids) -> tuple[float, float]:
    miss = (hg - ag) - (home - away)
    error = copysign(log1p(abs(miss)), miss)
    return home + 0.04 * error, away - 0.04 * error


def dynamic_update(home: float, away: float, hg: int, ag: int, extra: dict, ids) -> tuple[float, float]:
    expected = 1.0 / (1.0 + exp(-(home - away + 0.15)))
    score = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
    move = 0.05 * (score - expected)
    return 0.99 * home + move, 0.99 * away - move


SYSTEMS: dict[str, tuple[float, Callable]] = {
    "elo": (1500.0, elo_update), "glicko": (1500.0, glicko_update), "pi": (0.0, pi_update), "dynamic": (0.0, dynamic_update),
}


def rating_history(matches: DataFrame, system: str = "elo", *, season_regression: float = 0.25, update: Callable | None = None, start: float | None = None) -> DataFrame:
    """Ratings of both sides before and after every completed match.

    Each match needs the ratings the previous one left, so a league is one ordered walk;
    leagues run in parallel. Spark sorts the rows of a league, and the task streams them in
    Arrow batches: it holds one number per team, never the league's matches. With
    `season_regression` (R2, Elo) ratings are pulled towards the start value when the
    league's edition changes.
    """
    base, rule = SYSTEMS[system] if update is None else (start or 0.0, update)
    base = base if start is None else start
    pull = season_regression if system == "elo" and "edition_id" in matches.columns else 0.0
    done = matches.where(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
    done = guard(done, F.least("home_goals", "away_goals") >= 0, "goals cannot be negative")
    edition = F.col("edition_id") if "edition_id" in matches.columns else F.lit("")
    rows = done.select(
        "league_id", edition.alias("edition_id"), "kickoff_utc", "fixture_id", "home_team_id", "away_team_id", "home_goals", "away_goals",
        *[F.lit(0.0).alias(c) for c in ("home_pre", "away_pre", "home_post", "away_post")],
    )
    ordered = rows.repartition("league_id").sortWithinPartitions("league_id", "kickoff_utc", "fixture_id")

    def walk(batches):
        league = season = None
        ratings: dict = {}
        extra: dict = {}
        for batch in batches:
            out = []
            for lg, ed, h, a, hg, ag in zip(*(batch[c] for c in ("league_id", "edition_id", "home_team_id", "away_team_id", "home_goals", "away_goals"))):
                if lg != league:
                    league, season, ratings, extra = lg, ed, {}, {}
                elif ed != season:
                    season = ed
                    if pull:
                        ratings = {t: (1.0 - pull) * r + pull * base for t, r in ratings.items()}
                before = ratings.get(h, base), ratings.get(a, base)
                after = rule(before[0], before[1], int(hg), int(ag), extra, (h, a))
                ratings[h], ratings[a] = after
                out.append((*before, *after))
            for i, c in enumerate(("home_pre", "away_pre", "home_post", "away_post")):
                batch[c] = [r[i] for r in out]
            yield batch

    return ordered.mapInPandas(walk, ordered.schema)


def rating_rows(history: DataFrame) -> DataFrame:
    """One row per team and match: rating before, and after with its observation time."""
    side = lambda s: F.struct(F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_pre").alias("pre_match_rating"), F.col(f"{s}_post").alias("rating"))
    return history.select("fixture_id", "league_id", F.col("kickoff_utc").alias("observed_at"), F.inline(F.array(side("home"), side("away"))))


#: Matches a part of R4's pairings holds before there is a second one.
PART_MATCHES = 50_000


def team_goal_strengths(matches: DataFrame, as_of: Column | None = None, *, half_life_days: float = 365.0, prior_matches: float = 4.0, tolerance: float = 1e-6, most_iterations: int = 100, least_matches: int = 2, blocks: int = 64) -> DataFrame:
    """Time-decayed attack and defence factors per team and league, by alternating updates.

    Goals are Poisson with rate base x home effect x attack x opponent's defence. With the
    other side fixed each factor has a closed form (weighted goals over weighted expectation,
    with a prior of `prior_matches` average matches), so an iteration is two joins and two
    aggregations over all leagues at once, for any number of teams. The pairings stay where they are: they are stored once by
    league and block of teams (a league has a share of `blocks` by its matches, one at least), and in a step only the factors of the teams go to the blocks
    of their league. Teams with little history stay near 1, the league mean. Only matches strictly before `as_of` count; without it, before the last kickoff.
    Defence is updated with the attack of the same step, until no factor moves by more than `tolerance`: a step is written to reliable
    storage and sends one number to the driver. `residual` is the largest move of the last step. A fit that does not settle, and a
    history of fewer than `least_matches` matches, are errors.
    """
    done = matches.where(F.col("home_goals").isNotNull())
    at = done.agg(F.max("kickoff_utc")).scalar() if as_of is None else as_of
    past = done.where(F.col("kickoff_utc") < at)
    if (n := past.count()) < least_matches:
        raise ValueError(f"{n} earlier results are too few, {least_matches} are needed")
    weighed = past.select(
        "league_id", "home_team_id", "away_team_id", F.col("home_goals").cast("double").alias("hg"), F.col("away_goals").cast("double").alias("ag"),
        F.pow(F.lit(2.0), -days_between(at, F.col("kickoff_utc")) / half_life_days).alias("w"),
    )
    away = F.sum(F.col("w") * F.col("ag"))
    league = cut_lineage(weighed.groupBy("league_id").agg(
        (away / F.sum("w")).alias("base"), (F.sum(F.col("w") * F.col("hg")) / F.greatest(away, F.lit(1e-9))).alias("home_effect"),
        F.ceil(F.count(F.lit(1)) * float(blocks) / F.lit(n)).cast("int").alias("_blocks"),
    ))
    # Matches of two teams share their factors: collapse them once, before the iterations; one row of sums gives the pairings of both teams.
    turned = F.col("home_team_id") > F.col("away_team_id")
    of_both = weighed.where("home_team_id is not null and away_team_id is not null").select(
        "league_id", F.least("home_team_id", "away_team_id").alias("_t0"), F.greatest("home_team_id", "away_team_id").alias("_t1"),
        F.when(turned, F.col("ag")).otherwise(F.col("hg")).alias("_g0"), F.when(turned, F.col("hg")).otherwise(F.col("ag")).alias("_g1"), "w", turned.alias("_turned"),
    ).groupBy("league_id", "_t0", "_t1").agg(
        *[F.sum(F.col("w") * F.col(f"_g{i}")).alias(f"_g{i}") for i in (0, 1)],
        *[F.sum(F.when(F.col("_turned") == bool(i), F.col("w")).otherwise(0.0)).alias(f"_w{i}") for i in (0, 1)],
    )
    side = lambda me, other: F.struct(
        F.col(f"_t{me}").alias("team_id"), F.col(f"_t{other}").alias("opponent_id"), F.col(f"_g{me}").alias("gf"), F.col(f"_g{other}").alias("ga"),
        (F.col("base") * (F.col(f"_w{me}") * F.col("home_effect") + F.col(f"_w{other}"))).alias("ef"),
        (F.col("base") * (F.col(f"_w{me}") + F.col(f"_w{other}") * F.col("home_effect"))).alias("ea"),
    )
    pairs = of_both.join(league, "league_id").select("league_id", "_blocks", F.inline(F.array(side(0, 1), side(1, 0))))
    place, own = ["league_id", "_block"], ["league_id", "_block", "_blocks", "team_id"]
    pairs = pairs.withColumn("_block", F.pmod(F.xxhash64("team_id"), F.col("_blocks")).cast("int"))
    k = F.lit(float(prior_matches))
    parts = min(int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_MATCHES))

    def opponents(f: DataFrame, c: str) -> DataFrame:
        """The factors of all teams at every block of their league."""
        return f.select("league_id", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.col("team_id").alias("opponent_id"), c).repartition(parts, *place)

    teams = None
    with kept_dealt(pairs, place, parts) as pairs:
        for _ in range(most_iterations):
            met = pairs.withColumn("defense", F.lit(1.0)) if teams is None else pairs.join(opponents(teams, "defense"), [*place, "opponent_id"])
            attack = met.groupBy(*own).agg(((F.sum("gf") + k) / (F.sum(F.col("ef") * F.col("defense")) + k)).alias("attack"))
            sent = opponents(attack, "attack")
            defense = pairs.join(sent, [*place, "opponent_id"]).groupBy(*own).agg(((F.sum("ga") + k) / (F.sum(F.col("ea") * F.col("attack")) + k)).alias("defense"))
            step = defense.join(sent.withColumnRenamed("opponent_id", "team_id"), [*place, "team_id"])
            before = [F.lit(1.0)] * 2
            if teams is not None:
                step = step.join(teams.select(*place, "team_id", F.col("attack").alias("_a"), F.col("defense").alias("_d")), [*place, "team_id"])
                before = [F.col("_a"), F.col("_d")]
            moved = F.greatest(F.abs(F.col("attack") - before[0]), F.abs(F.col("defense") - before[1]))
            step = rewritten(step.select(*own, "attack", "defense", moved.alias("_m")))
            residual = step.agg(F.max("_m")).first()[0]
            teams = step.drop("_m")
            if residual <= tolerance:
                return teams.drop("_block", "_blocks").join(league.drop("_blocks"), "league_id").withColumn("residual", F.lit(residual))
    raise RuntimeError(f"goal strengths still move by {residual:g} after {most_iterations} steps")


def strength_rates(fixtures: DataFrame, strengths: DataFrame) -> DataFrame:
    """Goal rates of fixtures from R4 factors; an unknown team counts as average."""
    league = strengths.groupBy("league_id").agg(F.any_value("base").alias("base"), F.any_value("home_effect").alias("home_effect"))
    out = fixtures.join(league, "league_id")
    for s in ("home", "away"):
        out = out.join(strengths.select("league_id", F.col("team_id").alias(f"{s}_team_id"), F.col("attack").alias(f"_{s}_att"), F.col("defense").alias(f"_{s}_def")), ["league_id", f"{s}_team_id"], "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    return out.withColumns({
        "home_rate": F.greatest(F.col("base") * F.col("home_effect") * f("_home_att") * f("_away_def"), F.lit(0.05)),
        "away_rate": F.greatest(F.col("base") * f("_away_att") * f("_home_def"), F.lit(0.05)),
    }).drop("_home_att", "_home_def", "_away_att", "_away_def")


def fit_low_score_rho(rated: DataFrame, *, weight: Column | None = None, steps: int = 41) -> DataFrame:
    """The rho in [-.2, .2] with the highest low-score log-likelihood per league.

    Only 0-0, 0-1, 1-0 and 1-1 matches matter; each grid value is one sum.
    """
    low = rated.where((F.col("home_goals") <= 1) & (F.col("away_goals") <= 1))
    rows = low.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("rho", F.col("_i") * (0.4 / (steps - 1)) - 0.2)
    tau = dc_tau("home_goals", "away_goals", "home_rate", "away_rate", "rho")
    ll = F.sum((F.lit(1.0) if weight is None else weight) * F.when(tau > 0, F.ln(tau)).otherwise(-1e9))
    per = rows.groupBy("league_id", "rho").agg(ll.alias("ll"))
    return per.groupBy("league_id").agg(F.max_by("rho", F.struct("ll", -F.abs("rho"))).alias("rho"))


def rating_columns() -> Sequence[str]:
    return ("home_pre", "away_pre", "home_post", "away_post")
