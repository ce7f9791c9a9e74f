"""Team seasons of three sports. Nations are teams; the first two lines' nations of an order are a game's two sides, the first at home."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bags, teams
from ..sources.tables import table

GIVEN = [*teams.TOTALS, "defensive_sacks", "total_yards", *teams.MEANS]
FOOTBALL_GIVEN = [*teams.FOOTBALL_TOTALS, *teams.FOOTBALL_RENAMED.values(), "possession_pct"]
MORE = {"possession_pct": 22}  # so that shares of the ball lie around 30


def _games(spark, d, given, only=None):
    """Each side's game: a stat is made of its lines' quantities by the stat's number; every seventh game has no opponent's row. only: the stats that are asked for, else all."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("team"))
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"))
    rows = table(spark, d, "lineitem").where("l_linenumber <= 2").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "team", F.col("l_quantity").cast("long").alias("q"))
    lines = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("team", "q")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    sides = lines.groupBy("l_orderkey").agg(F.min("team").alias("low"), F.max("team").alias("high"))
    kept = lines.join(sides.where("low <> high"), "l_orderkey").where("l_linenumber = 1 or l_orderkey % 7 <> 0").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    stats = F.map_from_entries(F.array(*(F.struct(F.lit(n), ((F.col("q") * (i + 1) + F.col("l_orderkey")) % 17 + MORE.get(n, 0)).cast("double")) for i, n in enumerate(given) if only is None or n in only)))
    text = lambda i: F.concat(F.col("q") % 5, F.lit("-"), 5 + F.col("q") * (i + 1) % 7)
    texts = F.map_from_entries(F.array(*(F.struct(F.lit(n), F.when(F.col("q") % 11 != i, text(i)).otherwise("n/a")) for i, n in enumerate(teams.PAIRS))))
    return kept.select(F.col("l_orderkey").alias("fixture"), "season", "team", (F.col("l_linenumber") == 1).alias("home"), (F.col("q") % 9).cast("double").alias("score"), stats.alias("stats"), texts.alias("texts"))


def rollup_nfl_team(spark, d):
    return bags.explode_bag(season_bags(spark, d, "NFL"), "bag")


def football_team_season(spark, d):
    """A football team's season in full: results at home and away, what it did, and what its opponents were allowed."""
    return bags.explode_bag(season_bags(spark, d, "FOOTBALL"), "bag")


def basketball_team_season(spark, d):
    return bags.explode_bag(season_bags(spark, d, "NBA"), "bag")


def season_bags(spark, d, sport):
    """team, season and bag of one sport's teams."""
    rolled, given = {"NFL": (teams.american_season, GIVEN), "FOOTBALL": (teams.football_season, FOOTBALL_GIVEN), "NBA": (teams.basketball_season, teams.BASKETBALL_MEANS)}[sport]
    return rolled(_games(spark, d, given))


def opponents_share(spark, d):
    """The opponents' share of the ball against each football team in a season."""
    return teams.opponents_share(_games(spark, d, FOOTBALL_GIVEN, only=("possession_pct",)))


QUERIES = {f.__name__: f for f in (rollup_nfl_team, football_team_season, basketball_team_season)}


def _filled_sql(given: list[str], more: str = "") -> str:
    """The stand-in games as CTEs, up to filled (fixture, season, team, home, score, stats)."""
    stats = ", ".join(f'CAST((q * {i + 1} + fixture) % 17 + {MORE.get(n, 0)} AS DOUBLE) AS "{n}"' for i, n in enumerate(given))
    return f"""
lines AS (
    SELECT l_orderkey AS fixture, l_linenumber, max((s_nationkey, CAST(l_quantity AS BIGINT))) AS r
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <= 2 GROUP BY ALL
),
sides AS (SELECT fixture FROM lines GROUP BY ALL HAVING min(r[1]) <> max(r[1])),
games AS (
    SELECT fixture, CAST(year(o_orderdate) AS INTEGER) AS season, l_linenumber = 1 AS home, r[1] AS team, r[2] AS q, CAST(r[2] % 9 AS DOUBLE) AS score
    FROM lines JOIN sides USING (fixture) JOIN orders ON fixture = o_orderkey WHERE l_linenumber = 1 OR fixture % 7 <> 0
),
filled AS (SELECT fixture, season, team, home, score, {stats}{more} FROM games)"""


_MET = "FROM filled g LEFT JOIN filled o ON o.fixture = g.fixture AND o.season = g.season AND o.team <> g.team GROUP BY ALL"


def _american() -> tuple[str, list[str]]:
    """CTEs up to whole (team, season, a column for each stat), and those stats."""
    pairs = ", ".join(f'CASE WHEN q % 11 <> {i} THEN q % 5 END AS "{made}", CASE WHEN q % 11 <> {i} THEN 5 + q * {i + 1} % 7 END AS "{tried}"' for i, (made, tried) in enumerate(teams.PAIRS.values()))
    total = lambda c: f"sum(coalesce({c}, 0))"
    sums = {s: total(f'g."{s}"') for s in [*teams.TOTALS, "defensive_sacks"]}
    sums |= {n: total(f'g."{n}"') for names in teams.PAIRS.values() for n in names}
    sums |= {f"opp_{n}": total(f'o."{n}"') for names in teams.PAIRS.values() for n in names}
    sums |= {"yards_allowed": total("o.total_yards"), "penalty_yards_drawn": total("o.penalty_yards"), "first_downs_allowed": total("o.first_downs"), "opp_total_offensive_plays": total("o.total_offensive_plays"), "takeaways": total("o.passing_interceptions") + " + " + total("o.fumbles_lost")}
    sums |= {m: f"round(avg(g.{m}), 1)" for m in teams.MEANS}
    sums |= {"games_played": "count(*)", "points_for": total("g.score"), "points_against": total("o.score")}
    sums |= {n: f"count(*) FILTER (WHERE g.score {op} o.score)" for n, op in (("wins", ">"), ("losses", "<"), ("ties", "="))}
    first = ", ".join(f'{e} AS "{n}"' for n, e in sums.items())
    more = {"turnover_differential": "takeaways - turnovers"}
    more |= {n: f"round({c} / games_played, 1)" for n, c in (("points_per_game", "points_for"), ("points_allowed_per_game", "points_against"), ("yards_per_game", "total_yards"), ("avg_possession_seconds", "possession_time_seconds"))}
    more |= {n: f'CASE WHEN "{tried}" > 0 THEN round("{of}" / "{tried}" * {scale}, {digits}) END' for n, of, tried, scale, digits in teams.RATES}
    listed = [n for n in [*sums, "total_yards", "turnovers", "point_differential", *more] if not n.startswith("opp_")]
    ctes = f"""{_filled_sql(GIVEN, ", " + pairs)},
summed AS (SELECT g.team, g.season, {first} {_MET}),
wider AS (SELECT *, passing_yards + rushing_yards AS total_yards, passing_interceptions + fumbles_lost AS turnovers, points_for - points_against AS point_differential FROM summed),
whole AS (SELECT *, {", ".join(f'{e} AS "{n}"' for n, e in more.items())} FROM wider)"""
    return ctes, listed


def _football() -> tuple[str, list[str]]:
    total = lambda c: f"sum(coalesce({c}, 0))"
    won, drawn, lost = "g.score > o.score", "g.score = o.score", "g.score < o.score"
    out = {"matches_played": "count(*)", "wins": f"count(*) FILTER (WHERE {won})", "draws": f"count(*) FILTER (WHERE {drawn})", "losses": f"count(*) FILTER (WHERE {lost})", "goals_for": total("g.score"), "goals_against": total("o.score")}
    for w, there in (("home", "g.home"), ("away", "NOT g.home")):
        out |= {f"{w}_{n}": f"count(*) FILTER (WHERE {there} AND {c})" for n, c in (("played", "true"), ("won", won), ("draw", drawn), ("lost", lost))}
        out |= {f"{w}_{n}": f"coalesce({total(c)} FILTER (WHERE {there}), 0)" for n, c in (("scored", "g.score"), ("conceded", "o.score"))}
    out |= {s: total(f'g."{s}"') for s in teams.FOOTBALL_TOTALS} | {n: total(f'g."{s}"') for n, s in teams.FOOTBALL_RENAMED.items()} | {n: total(f'o."{s}"') for n, s in teams.FOOTBALL_ALLOWED.items()}
    out |= {"possession_pct": "round(avg(nullif(g.possession_pct, 0)), 2)", "opp_possession_pct": "round(avg(nullif(o.possession_pct, 0)), 2)"}
    more = {"goal_difference": "goals_for - goals_against", "points": "3 * wins + draws", "overall_points": "3 * wins + draws", "home_points": "3 * home_won + home_draw", "away_points": "3 * away_won + away_draw"}
    more |= {n: f'CASE WHEN "{tried}" > 0 THEN round("{of}" / "{tried}" * 100, 2) END' for n, of, tried in teams.FOOTBALL_PERCENTAGES}
    return _whole(FOOTBALL_GIVEN, out, more)


def _basketball() -> tuple[str, list[str]]:
    sides = {"stats": "g", "opp_stats": "o"}
    out = {"games_played": "count(*)", "wins": "count(*) FILTER (WHERE g.score > o.score)", "losses": "count(*) FILTER (WHERE g.score < o.score)", "pts_allowed": "round(avg(o.pts), 1)"}
    out |= {s: f"round(avg(g.{s}), 1)" for s in teams.BASKETBALL_MEANS}
    out |= {n: f"round(sum({sides[of]}.{made}) / nullif(sum({sides[of]}.{tried}), 0) * 100, 1)" for n, of, made, tried in teams.BASKETBALL_PERCENTAGES}
    return _whole(teams.BASKETBALL_MEANS, out, {"_": "0"})


def _whole(given, out, more) -> tuple[str, list[str]]:
    first, then = (", ".join(f'{e} AS "{n}"' for n, e in x.items()) for x in (out, more))
    return f"{_filled_sql(given)}, summed AS (SELECT g.team, g.season, {first} {_MET}), whole AS (SELECT *, {then} FROM summed)", [n for n in [*out, *more] if n != "_"]


def wide_sql(sport: str) -> str:
    """A query: team, season and a column for each stat of the sport's teams."""
    ctes, listed = {"NFL": _american, "FOOTBALL": _football, "NBA": _basketball}[sport]()
    cols = ", ".join(f'CAST("{n}" AS DOUBLE) AS "{n}"' for n in listed)
    return f"WITH {ctes} SELECT team, season, {cols} FROM whole"


def _long_sql(sport: str) -> str:
    return f"SELECT team, season, stat, value FROM ({wide_sql(sport)}) UNPIVOT (value FOR stat IN (COLUMNS(* EXCLUDE (team, season))))"


ORACLES = {"rollup_nfl_team": _long_sql("NFL"), "football_team_season": _long_sql("FOOTBALL"), "basketball_team_season": _long_sql("NBA")}
