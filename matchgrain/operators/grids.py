"""Score grids as long tables: (keys, home_goals, away_goals, p, tail).

`tail` is the probability mass outside the grid, repeated on every cell of a fixture.
Cells of a fixture come out of one input row, so sums per fixture combine before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import lgamma

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrain.functions.contracts import guard, require

HARD_MAX_GOALS = 30


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash by fixture before a row becomes hundreds of cells.

    A grid multiplies its input by up to 961, so input splits are too coarse; and sums or
    windows per fixture that follow need no second exchange. A fixture's cells are bounded
    by the grid, whatever the data.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _ln_factorial(goals: Column) -> Column:
    table = F.array(*[F.lit(lgamma(g + 1.0)) for g in range(HARD_MAX_GOALS + 1)])
    return F.element_at(table, (goals + 1).cast("int"))


def poisson_pmf(goals: Column, rate: Column) -> Column:
    return F.exp(goals * F.ln(rate) - rate - _ln_factorial(goals))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _sum(terms: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for term in terms:
        total = total + term
    return total


def _running(values: Column) -> Column:
    """Running totals of an array."""
    empty = F.array().cast("array<double>")
    return F.aggregate(
        values, empty, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)
    )


def _pmf_array(rate: Column, top: int) -> Column:
    """Poisson weights of 0..top, spelled out so that they are compiled."""
    return F.array(*[F.exp(F.lit(g) * F.ln(rate) - rate - F.lit(lgamma(g + 1.0))) for g in range(top + 1)])


def _cells(df: DataFrame, keys: Sequence[str], home: Column, away: Column, carried: Sequence[str] = ()) -> DataFrame:
    """Outer product of two probability arrays per row."""
    first = df.select(*keys, *carried, away.alias("_away"), F.posexplode(home).alias("home_goals", "_ph"))
    second = first.select(
        *keys, *carried, "home_goals", "_ph", F.posexplode("_away").alias("away_goals", "_pa")
    )
    return second.withColumn("p", F.col("_ph") * F.col("_pa")).drop("_ph", "_pa")


def poisson_grid(
    rates: DataFrame,
    keys: Sequence[str] = ("fixture_id",),
    *,
    home_rate: str = "home_rate",
    away_rate: str = "away_rate",
    tail_tolerance: float = 1e-10,
    initial_max_goals: int = 8,
    hard_max_goals: int = HARD_MAX_GOALS,
) -> DataFrame:
    """G1: independent Poisson grid, grown until the tail is within tolerance."""
    if not 0 <= tail_tolerance < 1:
        raise ValueError("tail_tolerance must be in [0, 1)")
    if initial_max_goals < 0 or not initial_max_goals <= hard_max_goals <= HARD_MAX_GOALS:
        raise ValueError("invalid score-grid bounds")
    require(rates, [*keys, home_rate, away_rate])
    h, a = F.col(home_rate).cast("double"), F.col(away_rate).cast("double")
    checked = guard(rates.select(*keys, h.alias("_hr"), a.alias("_ar")), F.least("_hr", "_ar") > 0, "goal rates must be positive")
    arrays = spread(checked, keys).select(
        *keys,
        _pmf_array(F.col("_hr"), hard_max_goals).alias("_h"),
        _pmf_array(F.col("_ar"), hard_max_goals).alias("_a"),
    )
    summed = arrays.select("*", _running(F.col("_h")).alias("_ch"), _running(F.col("_a")).alias("_ca"))
    # The represented mass grows with the size, so the sizes that miss the tolerance are a prefix.
    short = F.size(F.filter(F.zip_with("_ch", "_ca", lambda x, y: F.lit(1.0) - x * y), lambda tail: tail > tail_tolerance))
    sized = summed.select("*", F.greatest(short, F.lit(initial_max_goals)).alias("_n"))
    failed = F.raise_error(F.lit("score grid did not meet tail tolerance before hard maximum")).cast("double")
    sized = sized.select(
        *keys, F.when(F.col("_n") > hard_max_goals, failed).otherwise(F.get("_ch", F.col("_n")) * F.get("_ca", F.col("_n"))).alias("_mass"),
        F.slice("_h", F.lit(1), F.col("_n") + 1).alias("_hh"), F.slice("_a", F.lit(1), F.col("_n") + 1).alias("_aa"),
    )
    cells = _cells(sized, keys, F.col("_hh"), F.col("_aa"), carried=["_mass"])
    return cells.select(
        *keys, "home_goals", "away_goals",
        (F.col("p") / F.greatest(F.lit(1.0), F.col("_mass"))).alias("p"),
        F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_mass")).alias("tail"),
    )


def fixed_poisson_grid(rates: DataFrame, keys=("fixture_id",), *, home_rate="home_rate", away_rate="away_rate", max_goals=10) -> DataFrame:
    """G1: grid of a fixed size (0..max_goals each side)."""
    base = spread(rates.select(*keys, F.col(home_rate).alias("_hr"), F.col(away_rate).alias("_ar")), keys)
    arrays = base.select(*keys, _pmf_array(F.col("_hr"), max_goals).alias("_h"), _pmf_array(F.col("_ar"), max_goals).alias("_a"))
    return _cells(arrays, keys, F.col("_h"), F.col("_a")).select(*keys, "home_goals", "away_goals", "p")


def with_mass(base: DataFrame, keys: Sequence[str], mass: Column) -> DataFrame:
    """`_mass`, the mass of all cells of a fixture, before its rows become cells: few short rows are sorted, no cell is.

    Rows of one key share their mass, as their cells are one grid.
    """
    return base.withColumn("_m", mass).withColumn("_mass", F.sum("_m").over(Window.partitionBy(*keys))).drop("_m")


def with_tail(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turn `_mass` into the missing mass of each fixture; a total above one is scaled to one."""
    return cells.select(
        *keys, "home_goals", "away_goals",
        (F.col("p") / F.greatest(F.lit(1.0), F.col("_mass"))).alias("p"),
        F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_mass")).alias("tail"),
    )


def with_sums(cells: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Sums over the cells of a fixture on each of them.

    The sums are aggregated and come back by a hash join whose build side has a row for each fixture, so cells are not
    sorted. Cells with a null in their key, which a join would lose, take them from a window.
    """
    totals = cells.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    whole = Window.partitionBy(*keys)
    joined = cells.where(known).join(totals.hint("shuffle_hash"), list(keys)).select(*cells.columns, *sums)
    return joined.unionByName(cells.where(~known).withColumns({n: c.over(whole) for n, c in sums.items()}))


def dc_tau(h, a, home_rate, away_rate, rho) -> Column:
    """Low-score correction factor."""
    h, a, lh, la, r = (F.col(x) if isinstance(x, str) else x for x in (h, a, home_rate, away_rate, rho))
    return (
        F.when((h == 0) & (a == 0), 1.0 - lh * la * r)
        .when((h == 0) & (a == 1), 1.0 + lh * r)
        .when((h == 1) & (a == 0), 1.0 + la * r)
        .when((h == 1) & (a == 1), 1.0 - r)
        .otherwise(1.0)
    )


def dixon_coles_grid(rates: DataFrame, keys=("fixture_id",), *, home_rate="home_rate", away_rate="away_rate", rho="rho", max_goals=12) -> DataFrame:
    """G2."""
    base = rates.select(
        *keys, F.col(home_rate).alias("_hr"), F.col(away_rate).alias("_ar"), F.col(rho).alias("_rho")
    )
    h, a = ([poisson_pmf(F.lit(g), F.col(rate)) for g in range(max_goals + 1)] for rate in ("_hr", "_ar"))
    low = [(i, j) for i in range(min(max_goals, 1) + 1) for j in range(min(max_goals, 1) + 1)]
    moved = _sum([h[i] * a[j] * (dc_tau(F.lit(i), F.lit(j), "_hr", "_ar", "_rho") - 1.0) for i, j in low])
    base = with_mass(spread(base, keys), keys, _sum(h) * _sum(a) + moved)
    scalars = ["_hr", "_ar", "_rho", "_mass"]
    arrays = base.select(*keys, *scalars, F.array(*h).alias("_h"), F.array(*a).alias("_a"))
    cells = _cells(arrays, keys, F.col("_h"), F.col("_a"), scalars)
    cells = cells.withColumn("_tau", dc_tau("home_goals", "away_goals", "_hr", "_ar", "_rho"))
    cells = guard(cells, F.col("_tau") > 0, "low-score correction generated non-positive mass")
    return with_tail(cells.withColumn("p", F.col("p") * F.col("_tau")), keys)


def bivariate_poisson_grid(rates: DataFrame, keys=("fixture_id",), *, home_rate="home_rate", away_rate="away_rate", shared_rate="shared_rate", max_goals=14) -> DataFrame:
    """Both sides share a Poisson component."""
    base = rates.select(
        *keys,
        (F.col(home_rate) - F.col(shared_rate)).alias("_1"),
        (F.col(away_rate) - F.col(shared_rate)).alias("_2"),
        F.col(shared_rate).cast("double").alias("_3"),
    )
    base = guard(base, (F.least("_1", "_2") > 0) & (F.col("_3") >= 0), "shared rate must be below both means")
    def weights(i: int) -> list[Column]:
        made = [poisson_pmf(F.lit(g), F.col(f"_{i}")) for g in range(max_goals + 1)]
        return made if i < 3 else [F.when(F.col("_3") > 0, w).otherwise(float(g == 0)) for g, w in enumerate(made)]

    # A shared count of s leaves 0..max_goals - s to either side, so the mass is a sum of products of running totals.
    below = spread(base, keys).select("*", *[_running(F.array(*weights(i))).alias(f"_c{i}") for i in (1, 2)])
    mass = _sum([w * F.get("_c1", F.lit(max_goals - s)) * F.get("_c2", F.lit(max_goals - s)) for s, w in enumerate(weights(3))])
    base = with_mass(below, keys, mass).select(*keys, "_mass", *[F.array(*weights(i)).alias(f"_p{i}") for i in (1, 2, 3)])
    goals = F.array(*[F.lit(g) for g in range(max_goals + 1)])
    rows = base.select(*keys, "_mass", "_p1", "_p2", "_p3", F.explode(goals).alias("home_goals"))
    # What a home score of h takes from each shared count, once for the cells of its row.
    taken = F.array(*[F.when(F.col("home_goals") >= s, F.get("_p1", F.col("home_goals") - s) * F.get("_p3", F.lit(s))).otherwise(0.0) for s in range(max_goals + 1)])
    rows = rows.select(*keys, "_mass", "home_goals", taken.alias("_t"), "_p2")
    cells = rows.select(*keys, "_mass", "home_goals", "_t", "_p2", F.explode(goals).alias("away_goals"))
    p = _sum([F.when(F.col("away_goals") >= s, F.get("_t", F.lit(s)) * F.get("_p2", F.col("away_goals") - s)).otherwise(0.0) for s in range(max_goals + 1)])
    return with_tail(cells.withColumn("p", p), keys)


def diagonal_inflated_grid(grid: DataFrame, inflation: float, keys=("fixture_id",)) -> DataFrame:
    """Draws times 1 + inflation, then scaled back to the original mass."""
    if not -0.9 < inflation < 10:
        raise ValueError("diagonal inflation is outside the stable region")
    draw = F.col("home_goals") == F.col("away_goals")
    factor = F.when(draw, 1.0 + inflation).otherwise(1.0)
    return (
        with_sums(grid, keys, {"_mass": F.sum("p"), "_diag": _mass_where(draw)})
        .withColumn("p", F.col("p") * factor * F.col("_mass") / (F.col("_mass") + F.col("_diag") * inflation))
        .drop("_mass", "_diag")
    )


def negative_binomial_pmf(goals: Column, mean: Column, size: Column) -> Column:
    steps = F.when(goals > 0, F.sequence(F.lit(0), goals - 1)).otherwise(F.array().cast("array<int>"))
    rising = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.ln(size + i))
    q = size / (size + mean)
    return F.exp(rising - _ln_factorial(goals) + size * F.ln(q) + goals * F.ln(1 - q))


def _negative_binomial_pmfs(mean: str, size: str, rising: str, top: int) -> list[Column]:
    """`negative_binomial_pmf` of 0..top; `rising` holds the running totals of ln(size + i)."""
    q = F.col(size) / (F.col(size) + F.col(mean))
    first = [F.lit(0.0), *[F.get(rising, F.lit(g)) for g in range(top)]]
    return [F.exp(r - F.lit(lgamma(g + 1.0)) + F.col(size) * F.ln(q) + F.lit(g) * F.ln(1 - q)) for g, r in enumerate(first)]


def negative_binomial_grid(rates: DataFrame, keys=("fixture_id",), *, home_rate="home_rate", away_rate="away_rate", dispersion="dispersion", max_goals=20) -> DataFrame:
    """G5."""
    base = rates.select(
        *keys, F.col(home_rate).alias("_hr"), F.col(away_rate).alias("_ar"), F.col(dispersion).cast("double").alias("_d")
    )
    base = spread(guard(base, F.least("_hr", "_ar", "_d") > 0, "invalid negative-binomial parameters"), keys)
    rising = _running(F.array(*[F.ln(F.col("_d") + g) for g in range(max_goals)]).cast("array<double>")).alias("_rise")
    h, a = (_negative_binomial_pmfs(rate, "_d", "_rise", max_goals) for rate in ("_hr", "_ar"))
    weighed = with_mass(base.select("*", rising), keys, _sum(h) * _sum(a)).drop("_rise").select("*", rising)
    arrays = weighed.select(*keys, "_mass", F.array(*h).alias("_h"), F.array(*a).alias("_a"))
    return with_tail(_cells(arrays, keys, F.col("_h"), F.col("_a"), ["_mass"]), keys)


def com_poisson_grid(rates: DataFrame, keys=("fixture_id",), *, home_rate="home_rate", away_rate="away_rate", dispersion="dispersion", max_goals=20) -> DataFrame:
    """Marginals normalised on the truncated support, so the tail is zero."""
    base = rates.select(
        *keys, F.col(home_rate).alias("_hr"), F.col(away_rate).alias("_ar"), F.col(dispersion).cast("double").alias("_d")
    )
    base = spread(guard(base, F.least("_hr", "_ar", "_d") > 0, "rates and dispersion must be positive"), keys)
    logs = lambda rate: [F.lit(g) * F.ln(F.col(rate)) - F.col("_d") * F.lit(lgamma(g + 1.0)) for g in range(max_goals + 1)]
    base = base.select(*keys, F.array(*logs("_hr")).alias("_lh"), F.array(*logs("_ar")).alias("_la"))
    # The largest logarithm is bound once for a fixture, not taken for every goal.
    weights = lambda logs: F.get(F.transform(F.array(F.array_max(logs)), lambda m: F.transform(logs, lambda x: F.exp(x - m))), F.lit(0))
    base = base.select(*keys, weights("_lh").alias("_wh"), weights("_la").alias("_wa"))
    base = base.select(*keys, "_wh", "_wa", (_total(F.col("_wh")) * _total(F.col("_wa"))).alias("_t"))
    cells = _cells(base, keys, F.col("_wh"), F.col("_wa"), ["_t"])
    return cells.select(
        *keys, "home_goals", "away_goals", (F.col("p") / F.col("_t")).alias("p"), F.lit(0.0).alias("tail")
    )


LINES = (0.5, 1.5, 2.5, 3.5, 4.5, 5.5)


def _mass_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("p")).otherwise(0.0))


def goal_market_ladder(grid: DataFrame, keys: Sequence[str] = ("fixture_id",)) -> DataFrame:
    """Result, double chance, BTTS, clean sheet, totals and modal score of each grid.

    The grid is normalised first; the mode is the first maximum in (home, away) order.
    """
    h, a, p = F.col("home_goals").cast("int"), F.col("away_goals").cast("int"), F.col("p")
    parts = {
        "_home": _mass_where(h > a),
        "_draw": _mass_where(h == a),
        "_h_nil": _mass_where((h > 0) & (a == 0)),
        "_a_nil": _mass_where((h == 0) & (a > 0)),
    }
    top = len(LINES)
    for k in range(top):
        parts[f"_t{k}"] = _mass_where(h + a == k)
        parts[f"_h{k}"] = _mass_where(h == k)
        parts[f"_a{k}"] = _mass_where(a == k)
    # The mode as one whole number keeps the aggregation a hash aggregation: the mass in
    # steps of 2^-40, then the cell in reverse order, so the first maximum wins.
    cell = F.shiftleft((p * float(2**40) + 0.5).cast("bigint"), 12) + (F.lit(4095) - (h * 64 + a))
    summed = grid.groupBy(*keys).agg(F.sum("p").alias("_mass"), F.max(cell).alias("_mode"), *[c.alias(n) for n, c in parts.items()])
    share = summed.withColumns({n: F.col(n) / F.col("_mass") for n in parts})
    place = F.lit(4095) - F.col("_mode").bitwiseAND(F.lit(4095))
    p_h, p_d = F.col("_home"), F.col("_draw")
    p_a = 1.0 - p_h - p_d
    no_goal_h, no_goal_a = F.col("_h0"), F.col("_a0")
    either_zero = F.col("_h_nil") + F.col("_a_nil") + F.col("_t0")
    out = {
        "most_likely_score": F.concat_ws("-", F.shiftright(place, 6).cast("string"), (place % 64).cast("string")),
        "p_home": p_h, "p_draw": p_d, "p_away": p_a,
        "p_home_or_draw": p_h + p_d, "p_away_or_draw": p_a + p_d, "p_home_or_away": p_h + p_a,
        "p_btts_yes": 1.0 - either_zero, "p_btts_no": either_zero,
        "p_home_clean_sheet": no_goal_a, "p_away_clean_sheet": no_goal_h,
        "p_home_win_to_nil": F.col("_h_nil"), "p_away_win_to_nil": F.col("_a_nil"),
        "p_home_draw_no_bet": F.when(p_h > 0, p_h / (p_h + p_a)),
        "p_away_draw_no_bet": F.when(p_a > 0, p_a / (p_h + p_a)),
    }
    under = {"t": F.lit(0.0), "h": F.lit(0.0), "a": F.lit(0.0)}
    for k, line in enumerate(LINES):
        tag = str(line).replace(".", "_")
        under = {side: u + F.col(f"_{side}{k}") for side, u in under.items()}
        out[f"p_over_{tag}"], out[f"p_under_{tag}"] = 1.0 - under["t"], under["t"]
        out[f"p_home_team_over_{tag}"], out[f"p_away_team_over_{tag}"] = 1.0 - under["h"], 1.0 - under["a"]
    return share.select(*keys, *[c.alias(n) for n, c in out.items()])


def one_x_two(grid: DataFrame, keys: Sequence[str] = ("fixture_id",)) -> DataFrame:
    """Normalised home / draw / away probabilities of each grid."""
    h, a = F.col("home_goals"), F.col("away_goals")
    s = grid.groupBy(*keys).agg(
        F.sum("p").alias("_m"), _mass_where(h > a).alias("_h"), _mass_where(h == a).alias("_d"), _mass_where(h < a).alias("_a")
    )
    return s.select(
        *keys, *[(F.col(c) / F.col("_m")).alias(n) for c, n in (("_h", "p_home"), ("_d", "p_draw"), ("_a", "p_away"))]
    )


def closed_form_goal_markets(home, away, lines: Sequence[float] = (0.5, 1.5, 2.5, 3.5), max_goals: int = 10) -> dict[str, Column]:
    """Totals from the total rate, exact BTTS, and the modal score up to `max_goals`."""
    h = F.col(home) if isinstance(home, str) else home
    a = F.col(away) if isinstance(away, str) else away
    total = h + a
    out: dict[str, Column] = {"ExpectedTotalGoals": total}
    for line in lines:
        if line < 0 or line % 1 != 0.5:
            raise ValueError("goal lines must be non-negative half-goal values, e.g. 2.5")
        tag = str(line).replace(".", "_")
        under = F.aggregate(
            F.sequence(F.lit(0), F.lit(int(line))), F.lit(0.0), lambda acc, g: acc + F.exp(-total) * F.pow(total, g) / F.exp(_ln_factorial(g))
        )
        out[f"Over{tag}Prob"] = 1.0 - under
        out[f"Under{tag}Prob"] = under
    no = F.exp(-h) + F.exp(-a) - F.exp(-total)
    out["BTTSYesProb"], out["BTTSNoProb"] = 1.0 - no, no

    # The mode of a product is the pair of the two first modes.
    def first_mode(rate: Column) -> Column:
        weight = F.transform(
            F.sequence(F.lit(0), F.lit(max_goals)), lambda g: F.exp(-rate) * F.pow(rate, g) / F.factorial(g)
        )
        return F.array_position(weight, F.array_max(weight)) - 1

    out["MostLikelyScore"] = F.concat_ws("-", first_mode(h).cast("string"), first_mode(a).cast("string"))
    return out


def grid_bounds(grid: DataFrame, keys: Sequence[str] = ("fixture_id",), *, max_tail: float = 1e-8) -> DataFrame:
    """Lower and upper outcome bounds, BTTS bound, expected goals, point 1X2 if the tail is small."""
    h, a = F.col("home_goals"), F.col("away_goals")
    s = grid.groupBy(*keys).agg(
        F.sum("p").alias("represented_mass"),
        F.max("tail").alias("tail_mass"),
        _mass_where(h > a).alias("home_lower"),
        _mass_where(h == a).alias("draw_lower"),
        _mass_where(h < a).alias("away_lower"),
        _mass_where((h > 0) & (a > 0)).alias("btts_lower"),
        F.sum(F.col("p") * h).alias("home_goals_lower"),
        F.sum(F.col("p") * a).alias("away_goals_lower"),
    )
    extra = {}
    for side in ("home", "draw", "away"):
        low = F.col(f"{side}_lower")
        extra[f"{side}_upper"] = F.least(F.lit(1.0), low + F.col("tail_mass"))
        extra[f"p_{side}"] = F.when(
            F.col("tail_mass") <= max_tail,
            low / (F.col("home_lower") + F.col("draw_lower") + F.col("away_lower")),
        )
    return s.withColumns(extra)


def scoreline_ignorance(grid: DataFrame, observed: DataFrame, keys: Sequence[str] = ("fixture_id",), *, floor: float = 1e-15) -> DataFrame:
    """-ln of the observed cell, or of the tail when the score is off the grid."""
    seen = observed.select(*keys, F.col("home_goals").alias("_h"), F.col("away_goals").alias("_a")).where("_h IS NOT NULL")
    hit = (F.col("home_goals") == F.col("_h")) & (F.col("away_goals") == F.col("_a"))
    # The observed scores are the build side of a hash join: cells are not sorted.
    s = grid.join(seen.hint("shuffle_hash"), list(keys)).groupBy(*keys).agg(
        F.max(F.when(hit, F.col("p"))).alias("_p"), F.max("tail").alias("_t")
    )
    p = F.greatest(F.coalesce("_p", "_t"), F.lit(floor))
    return s.select(*keys, (-F.ln(p)).alias("ignorance"))


# --- settlement -------------------------------------------------------------------

MONEY = "decimal(10,4)"


def split_quarter_line(line) -> Column:
    """Array of the two half lines of a quarter line (twice itself otherwise)."""
    x = (F.col(line) if isinstance(line, str) else line).cast(MONEY)
    quarters = x * 4
    ok = quarters == F.round(quarters, 0)
    odd = F.abs(quarters).cast("bigint") % 2 == 1
    gap = F.lit("0.25").cast(MONEY)
    pair = F.when(odd, F.array((x - gap).cast(MONEY), (x + gap).cast(MONEY))).otherwise(F.array(x, x))
    return F.when(ok, pair).otherwise(
        F.raise_error(F.lit("line must be on a quarter-goal increment")).cast(f"array<{MONEY}>")
    )


def _settle(margin, price) -> Column:
    """Mean net return of both half lines; `margin(line)` > 0 wins, 0 is void."""
    profit = (F.col(price) if isinstance(price, str) else price).cast(MONEY) - F.lit(1).cast(MONEY)

    def leg(component: Column) -> Column:
        m = margin(component)
        return F.when(m > 0, profit).when(m == 0, F.lit(0).cast(MONEY)).otherwise(F.lit(-1).cast(MONEY))

    return leg, profit


def _two_legs(margin, line, price) -> Column:
    leg, _ = _settle(margin, price)
    halves = split_quarter_line(line)
    return ((leg(halves[0]) + leg(halves[1])) / F.lit(2)).cast("decimal(12,5)")


def over_net_return(total, line, price) -> Column:
    t = F.col(total) if isinstance(total, str) else total
    return _two_legs(lambda c: t.cast(MONEY) - c, line, price)


def under_net_return(total, line, price) -> Column:
    t = F.col(total) if isinstance(total, str) else total
    return _two_legs(lambda c: c - t.cast(MONEY), line, price)


def handicap_net_return(home, away, handicap, price) -> Column:
    h = F.col(home) if isinstance(home, str) else home
    a = F.col(away) if isinstance(away, str) else away
    return _two_legs(lambda c: (h - a).cast(MONEY) + c, handicap, price)


def expected_over_net_return(grid: DataFrame, lines: DataFrame, keys: Sequence[str] = ("fixture_id",), *, max_tail: float = 1e-8) -> DataFrame:
    """Sum of mass x settlement; `lines` holds (keys, line, price)."""
    checked = guard(grid, F.col("tail") <= max_tail, "grid tail is too large for point expected return")
    # A line settles in nine ways, two halves won, void or lost: a cell only looks its way up. Cells are not sorted.
    x = F.col("line").cast(MONEY)
    on_step = x * 4 == F.round(x * 4, 0)
    halves = split_quarter_line(F.when(on_step, F.col("line")).otherwise(F.lit(0)))
    profit = F.col("price").cast(MONEY) - F.lit(1).cast(MONEY)
    legs = [F.lit(-1).cast(MONEY), F.lit(0).cast(MONEY), profit]
    ways = F.array(*[((first + second) / F.lit(2)).cast("decimal(12,5)").cast("double") for first in legs for second in legs])
    settled = lines.select(*keys, "line", "price", on_step.alias("_ok"), *[halves[i].cast("double").alias(f"_l{i}") for i in (0, 1)], ways.alias("_ways"))
    joined = checked.join(settled.hint("shuffle_hash"), list(keys))
    total = F.col("home_goals") + F.col("away_goals")
    leg = lambda i: F.when(total > F.col(f"_l{i}"), 2).when(total == F.col(f"_l{i}"), 1).otherwise(0)
    odd = F.raise_error(F.lit("line must be on a quarter-goal increment")).cast("double")
    value = F.when(F.col("_ok"), F.get("_ways", leg(0) * 3 + leg(1))).otherwise(odd)
    return joined.groupBy(*keys, "line", "price").agg(F.sum(F.col("p") * value).alias("expected_net_return"))


def grid_to_wide(grid: DataFrame, max_goals: int, keys: Sequence[str] = ("fixture_id",)) -> DataFrame:
    """One row per (fixture, home goals) with a column per away goals."""
    cols = [F.sum(F.when(F.col("away_goals") == g, F.col("p"))).alias(f"a{g}") for g in range(max_goals + 1)]
    return grid.groupBy(*keys, "home_goals").agg(*cols)


def wide_to_grid(wide: DataFrame, max_goals: int, keys: Sequence[str] = ("fixture_id",)) -> DataFrame:
    """Back to the long table; empty cells are dropped."""
    names = [f"a{g}" for g in range(max_goals + 1)]
    long = wide.unpivot([*keys, "home_goals"], names, "_name", "p")
    return long.where("p IS NOT NULL").withColumn("away_goals", F.substring("_name", 2, 3).cast("int")).drop("_name")
