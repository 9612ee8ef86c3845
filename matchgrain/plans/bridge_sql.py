"""The bridge views in DuckDB SQL, used only to check results."""

from __future__ import annotations

VIEWS: dict[str, tuple[str, str]] = {
    # name: (views it reads, SQL)
    "cust": ("", """
        SELECT c_custkey, c_nationkey,
               row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos,
               count(*) OVER (PARTITION BY c_nationkey) AS n
        FROM customer"""),
    "matches": ("cust", """
        SELECT o_orderkey AS fixture_id, h.c_nationkey AS league_id,
               'L' || h.c_nationkey || ':' || year(o_orderdate) AS edition_id,
               o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INT)) AS kickoff_utc,
               h.c_custkey AS home_team_id, a.c_custkey AS away_team_id,
               CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice) AS BIGINT) % 5 END AS home_goals,
               CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice / 7) AS BIGINT) % 4 END AS away_goals,
               CASE WHEN o_orderstatus <> 'O' THEN 'completed' ELSE 'scheduled' END AS status
        FROM orders JOIN cust h ON o_custkey = h.c_custkey AND h.n >= 2
        JOIN cust a ON a.c_nationkey = h.c_nationkey AND a.pos = (h.pos + 1 + o_orderkey % (h.n - 1)) % h.n"""),
    "completed": ("matches", "SELECT * FROM matches WHERE home_goals IS NOT NULL"),
    "events2": ("matches", """
        SELECT *, goals_for - goals_against AS goal_diff,
               CASE WHEN goals_for > goals_against THEN 3.0 WHEN goals_for = goals_against THEN 1.0
                    WHEN goals_for < goals_against THEN 0.0 END::DOUBLE AS points,
               CASE WHEN goals_for > goals_against THEN 'W' WHEN goals_for = goals_against THEN 'D'
                    WHEN goals_for < goals_against THEN 'L' END AS result
        FROM (SELECT fixture_id, league_id, edition_id, kickoff_utc, home_team_id AS team_id, away_team_id AS opponent_id,
                     'home' AS venue_role, home_goals AS goals_for, away_goals AS goals_against FROM matches
              UNION ALL
              SELECT fixture_id, league_id, edition_id, kickoff_utc, away_team_id, home_team_id,
                     'away', away_goals, home_goals FROM matches)"""),
    "quotes": ("matches", """
        SELECT fixture_id, '1x2' AS market, s.selection, bookmaker,
               kickoff_utc - to_days(CAST(8 - ln AS INT)) AS observed_at,
               (1.0::DOUBLE / (1.05::DOUBLE * CASE s.selection WHEN 'home' THEN q / 71.0::DOUBLE
                 WHEN 'draw' THEN 20.0::DOUBLE / 71.0::DOUBLE ELSE (51 - q) / 71.0::DOUBLE END)) AS decimal_price
        FROM (SELECT l_orderkey AS fixture_id, l_suppkey % 5 AS bookmaker, l_linenumber AS ln, max(l_quantity) AS q
              FROM lineitem GROUP BY ALL) raw
        JOIN matches USING (fixture_id)
        CROSS JOIN (VALUES ('home'), ('draw'), ('away')) s(selection)"""),
    "fair": ("quotes", """
        SELECT *, (1.0::DOUBLE / decimal_price) / sum(1.0::DOUBLE / decimal_price)
                 OVER (PARTITION BY fixture_id, market, bookmaker, observed_at) AS fair_probability
        FROM quotes"""),
    "forecasts": ("matches", """
        SELECT fixture_id, league_id, edition_id, kickoff_utc, kickoff_utc - to_days(1) AS issued_at,
               'm' || (fixture_id % 2) AS model_id,
               a / (a + b + c) AS p_home, b / (a + b + c) AS p_draw, c / (a + b + c) AS p_away,
               CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1
                    WHEN home_goals < away_goals THEN 2 END AS target
        FROM (SELECT *, (1 + home_team_id % 7)::DOUBLE AS a, (1 + fixture_id % 3)::DOUBLE AS b,
                     (1 + fixture_id % 5)::DOUBLE AS c FROM matches)"""),
    "scored": ("forecasts", "SELECT * FROM forecasts WHERE target IS NOT NULL"),
    "rates": ("matches", """
        SELECT fixture_id, home_goals, away_goals,
               0.8::DOUBLE + (home_team_id % 11) / 10.0::DOUBLE AS home_rate,
               0.6::DOUBLE + (away_team_id % 9) / 10.0::DOUBLE AS away_rate
        FROM matches"""),
    "pm": ("rates", """
        SELECT fixture_id, home_rate, away_rate, g, exp(g * ln(home_rate) - home_rate - lgamma(g + 1)) AS ph,
               exp(g * ln(away_rate) - away_rate - lgamma(g + 1)) AS pa
        FROM rates CROSS JOIN range(31) t(g)"""),
    "grid_size": ("pm", """
        SELECT fixture_id, min(g) AS n FROM (
          SELECT fixture_id, g, sum(ph) OVER w * sum(pa) OVER w AS m FROM pm
          WINDOW w AS (PARTITION BY fixture_id ORDER BY g))
        WHERE g >= 8 AND 1 - m <= 1e-10 GROUP BY fixture_id"""),
    "grid": ("pm grid_size", """
        SELECT h.fixture_id, h.g AS home_goals, a.g AS away_goals, h.ph * a.pa AS p
        FROM grid_size s JOIN pm h ON h.fixture_id = s.fixture_id AND h.g <= s.n
        JOIN pm a ON a.fixture_id = s.fixture_id AND a.g <= s.n"""),
    "shots": ("", """
        SELECT l_orderkey AS fixture_id, l_linenumber AS shot_no, max(l_discount) * 5 AS xg, max(l_tax) * 10 AS xgot,
               l_linenumber % 2 = 0 AS is_home, max(l_returnflag) AS situation, max(l_quantity) AS distance
        FROM lineitem GROUP BY l_orderkey, l_linenumber"""),
    "team_shots": ("shots matches", """
        SELECT s.*, m.league_id, m.kickoff_utc, m.home_team_id, m.away_team_id,
               CASE WHEN is_home THEN m.home_team_id ELSE m.away_team_id END AS team_id
        FROM shots s JOIN matches m USING (fixture_id)"""),
    "matches_xg": ("completed shots", """
        SELECT m.*, s.home_xg, s.away_xg, s.home_shots, s.away_shots FROM completed m LEFT JOIN (
          SELECT fixture_id, sum(CASE WHEN is_home THEN xg ELSE 0 END) AS home_xg,
                 sum(CASE WHEN NOT is_home THEN xg ELSE 0 END) AS away_xg,
                 count(*) FILTER (WHERE is_home) AS home_shots, count(*) FILTER (WHERE NOT is_home) AS away_shots
          FROM shots GROUP BY fixture_id) s USING (fixture_id)"""),
    "tenures": ("", """
        SELECT c_custkey AS team_id, c_custkey * 10 + k AS manager_id,
               TIMESTAMP '1995-07-01' + to_days(CAST(k * 730 AS INT)) AS effective_from,
               CASE WHEN k < 3 THEN TIMESTAMP '1995-07-01' + to_days(CAST((k + 1) * 730 AS INT)) END AS effective_to,
               TIMESTAMP '1995-07-01' + to_days(CAST(k * 730 - 3 AS INT)) AS observed_at
        FROM customer CROSS JOIN range(4) t(k)"""),
    "aliases": ("", """
        SELECT 'p' || (c_custkey % 3) AS provider, upper(c_name) AS external_name, c_custkey AS team_id,
               CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1996-01-01' END AS valid_from,
               CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1996-01-01' + to_days(CAST(365 + c_custkey % 100 AS INT)) END AS valid_to
        FROM customer"""),
    "actions": ("team_shots", """
        SELECT fixture_id, team_id, fixture_id * 10 + shot_no AS action_id, xg - 0.1::DOUBLE AS action_value,
               kickoff_utc + to_minutes(CAST(shot_no AS INT)) AS observed_at
        FROM team_shots"""),
    "opportunities": ("quotes forecasts matches", """
        SELECT q.fixture_id, q.bookmaker, m.home_team_id AS team_id, m.league_id, m.edition_id, m.kickoff_utc,
               f.p_home AS model_probability, 1.0::DOUBLE / (1.05::DOUBLE * q.decimal_price) AS market_probability,
               q.decimal_price, q.fixture_id % 11 <> 0 AS quote_is_fresh, q.fixture_id % 7 <> 0 AS uncertainty_passed,
               q.fixture_id % 13 <> 0 AS calibration_passed, m.home_goals > m.away_goals AS won
        FROM (SELECT fixture_id, bookmaker, max_by(decimal_price, observed_at) AS decimal_price
              FROM quotes WHERE selection = 'home' GROUP BY ALL) q
        JOIN matches m USING (fixture_id) JOIN forecasts f USING (fixture_id)"""),
}


def with_views(sql: str, names: list[str]) -> str:
    """Prefix `sql` with the views it names and whatever those read, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in VIEWS[name][0].split():
            visit(parent)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"
