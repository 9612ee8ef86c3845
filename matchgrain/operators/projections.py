"""Season projection tables from a given table of final positions per draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrain.operators.ordered import dealt
from matchgrain.operators.ranks import exact_quantiles


def position_probabilities(standings: DataFrame, draws: int, *, keys: Sequence[str] = ("edition_id",)) -> DataFrame:
    """P(position) per team; mean points repeat on each row. Rows without a key or team are left out.

    Rows go to their team once; positions are counted and their points added up there.
    """
    team = [*keys, "team_id"]
    placed = dealt(standings.select(*team, "position", "points").dropna(subset=team), *team)
    per = placed.groupBy(*team, "position").agg(
        (F.count(F.lit(1)) / F.lit(float(draws))).alias("probability"), F.sum("points").alias("_s"), F.count("points").alias("_n")
    )
    whole = Window.partitionBy(*team)
    mean = F.try_divide(F.sum("_s").over(whole), F.sum("_n").over(whole))
    return per.select(*team, "position", "probability", mean.alias("mean_points"))


def outcome_probabilities(positions: DataFrame, labels: DataFrame, *, keys: Sequence[str] = ("edition_id",)) -> DataFrame:
    """P(label) per team; labels: label, first_position, last_position."""
    expanded = labels.select("label", F.explode(F.sequence("first_position", "last_position")).alias("position"))
    ends = [expanded.agg(f("position")).scalar() for f in (F.min, F.max)]  # positions without a label go before they are counted
    return positions.where(F.col("position").between(*ends)).join(expanded, "position").groupBy(*keys, "team_id", "label").agg(F.sum("probability").alias("probability"))


def validate_positions(positions: DataFrame, *, keys: Sequence[str] = ("edition_id",), tolerance: float = 1e-8) -> DataFrame:
    """Teams and positions whose probabilities do not sum to one, per edition."""
    bad = lambda by: positions.groupBy(*keys, by).agg(F.sum("probability").alias("s")).groupBy(*keys).agg(
        F.count_if(F.abs(F.col("s") - 1) > tolerance).alias(f"bad_{by}")
    )
    return bad("team_id").join(bad("position"), list(keys))


def points_target(standings: DataFrame, target_position: int, *, keys: Sequence[str] = ("edition_id",)) -> DataFrame:
    """P5: distribution of the lowest points total inside the target position."""
    low = standings.where(F.col("position") <= target_position).groupBy(*keys, "draw_id").agg(F.min("points").alias("_p"))
    return exact_quantiles(low, list(keys), "_p", {"p10": 0.1, "median": 0.5, "p90": 0.9})
