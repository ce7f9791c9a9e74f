"""Season roll-ups of teams in three sports: their own games, and what their opponents did in them.

A game has two rows, one a team. They meet by game, each beside its opponent, so takeaways and what is allowed come
from the other row. Downs are given as text ("5-12": made and tried) and become rates of a season's sums.

Defined results: a game without an opponent's row counts as played, and neither as won nor lost; stats that no row has
are zero where they are counts and absent where they are means or rates without tries; text that isn't two numbers counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from .bags import build_bag

# Stats that are added up under their own name.
TOTALS = """
passing_yards passing_touchdowns passing_attempts passing_completions passing_interceptions rushing_yards rushing_touchdowns rushing_attempts
defensive_interceptions interception_touchdowns total_tackles solo_tackles tackles_for_loss qb_hits passes_defended fumbles_recovered fumbles_touchdowns
fumbles fumbles_lost field_goals_made field_goal_attempts extra_points_made
punts punt_yards punts_inside_20 touchbacks kick_returns kick_return_yards kick_return_touchdowns punt_returns punt_return_yards punt_return_touchdowns
first_downs first_downs_passing first_downs_rushing first_downs_penalty total_drives total_offensive_plays net_passing_yards sack_yards_lost
possession_time_seconds penalties penalty_yards defensive_touchdowns
""".split()
# Fixed values: (name, made, tried, scale, digits) of a season's sums.
RATES = (
    ("passing_completion_pct", "passing_completions", "passing_attempts", 100, 1),
    ("yards_per_pass_attempt", "passing_yards", "passing_attempts", 1, 2),
    ("yards_per_rush_attempt", "rushing_yards", "rushing_attempts", 1, 2),
    ("field_goal_pct", "field_goals_made", "field_goal_attempts", 100, 1),
    ("gross_avg_punt_yards", "punt_yards", "punts", 1, 1),
    ("yards_per_kick_return", "kick_return_yards", "kick_returns", 1, 2),
    ("yards_per_punt_return", "punt_return_yards", "punt_returns", 1, 2),
    ("third_down_pct", "third_down_conversions", "third_down_attempts", 100, 1),
    ("fourth_down_pct", "fourth_down_conversions", "fourth_down_attempts", 100, 1),
    ("red_zone_pct", "red_zone_scores", "red_zone_attempts", 100, 1),
    ("yards_per_play", "total_yards", "total_offensive_plays", 1, 2),
    ("third_down_def_pct", "opp_third_down_conversions", "opp_third_down_attempts", 100, 1),
    ("red_zone_def_pct", "opp_red_zone_scores", "opp_red_zone_attempts", 100, 1),
    ("yards_per_play_allowed", "yards_allowed", "opp_total_offensive_plays", 1, 2),
)
MEANS = ("qbr", "qb_rating")
# Texts of made and tried, and the two stats in each.
PAIRS = {
    "third_down_efficiency": ("third_down_conversions", "third_down_attempts"),
    "fourth_down_efficiency": ("fourth_down_conversions", "fourth_down_attempts"),
    "red_zone_efficiency": ("red_zone_scores", "red_zone_attempts"),
}


def made_and_tried(text: Column) -> tuple[Column, Column]:
    """The two numbers of "5-12" (or "5/12"), null for anything else."""
    form = r"^\s*(\d{1,9})\s*[-/]\s*(\d{1,9})\s*$"
    return tuple(F.when(text.rlike(form), F.regexp_extract(text, form, i).cast("double")) for i in (1, 2))


def beside_opponents(games: DataFrame, *more: str) -> DataFrame:
    """Each game's row of a team with its opponent's score, stats and more as opp_*, null where the opponent has no row.

    Two rows a game, so a game's rows are few whatever the number of games.
    """
    own = games.select("fixture", "season", "team", "score", "stats", *more)
    opp = own.select(F.col("fixture").alias("_f"), *(F.col(c).alias(f"opp_{c}") for c in ("season", "team", "score", "stats", *more)))
    return own.join(opp, (F.col("fixture") == F.col("_f")) & (F.col("season") == F.col("opp_season")) & (F.col("team") != F.col("opp_team")), "left")


def american_season(games: DataFrame) -> DataFrame:
    """games: fixture, season, team, score, stats (map of numbers), texts (map of texts) -> team, season, bag."""
    both = beside_opponents(games, "texts")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    stat = lambda s: F.col("stats")[s]
    theirs = lambda s: F.col("opp_stats")[s]
    sums = {s: total(stat(s)) for s in TOTALS}
    sums |= {"defensive_sacks": total(stat("defensive_sacks")), "yards_allowed": total(theirs("total_yards")), "penalty_yards_drawn": total(theirs("penalty_yards")), "first_downs_allowed": total(theirs("first_downs")), "opp_total_offensive_plays": total(theirs("total_offensive_plays")), "takeaways": total(theirs("passing_interceptions")) + total(theirs("fumbles_lost"))}
    for text, names in PAIRS.items():
        sums |= {n: total(c) for n, c in zip(names, made_and_tried(F.col("texts")[text]), strict=True)}
        sums |= {f"opp_{n}": total(c) for n, c in zip(names, made_and_tried(F.col("opp_texts")[text]), strict=True)}
    known = F.col("opp_score").isNotNull()
    result = {"wins": F.count_if(known & (F.col("score") > F.col("opp_score"))), "losses": F.count_if(known & (F.col("score") < F.col("opp_score"))), "ties": F.count_if(known & (F.col("score") == F.col("opp_score")))}
    scored = {"games_played": F.count("*"), **result, "points_for": total(F.col("score")), "points_against": total(F.col("opp_score"))}
    means = {m: rounded(F.avg(stat(m)), 1) for m in MEANS}
    made = both.groupBy("team", "season").agg(*(c.alias(n) for n, c in (scored | sums | means).items()))
    made = made.withColumns({"total_yards": F.col("passing_yards") + F.col("rushing_yards"), "turnovers": F.col("passing_interceptions") + F.col("fumbles_lost"), "point_differential": F.col("points_for") - F.col("points_against")})
    a_game = lambda c: rounded(F.col(c) / F.col("games_played"), 1)
    more = {
        "turnover_differential": F.col("takeaways") - F.col("turnovers"),
        "points_per_game": a_game("points_for"),
        "points_allowed_per_game": a_game("points_against"),
        "yards_per_game": a_game("total_yards"),
        "avg_possession_seconds": a_game("possession_time_seconds"),
    }
    more |= {name: F.when(F.col(tried) > 0, rounded(F.col(of) / F.col(tried) * scale, digits)) for name, of, tried, scale, digits in RATES}
    made = made.withColumns(more)
    kept = [c for c in made.columns if c not in ("team", "season") and not c.startswith("opp_")]
    return made.select("team", "season", build_bag(**{c: F.col(c) for c in kept}).alias("bag"))


# A football team's stats that are added up, under the same name or (second line) from a stat of another name.
FOOTBALL_TOTALS = """
fouls_drawn penalties_committed penalties_won tackles tackles_won interceptions clearances blocked_shots ball_recovery dispossessed possession_lost dribbled_past
passes accurate_passes key_passes backward_passes long_balls long_balls_won through_balls total_crosses accurate_crosses
shots_total shots_on_target shots_off_target chances_created big_chances_created big_chances_missed dribble_attempts successful_dribbles
total_duels duels_won duels_lost touches offsides offsides_provoked saves saves_insidebox good_high_claim
assists goal_attempts hit_woodwork shots_insidebox shots_outsidebox successful_headers corners attacks dangerous_attacks ball_safe goal_kicks free_kicks
throw_ins penalties injuries substitutions
""".split()
FOOTBALL_RENAMED = {
    "fouls_committed": "fouls",
    "yellow_cards_total": "yellow_cards",
    "red_cards_total": "red_cards",
    "passes_final_third": "passes_in_final_third",
    "shots_blocked_by_opp": "shots_blocked",
    "aerials_total": "aerials",
    "aerials_won": "aeriels_won",
    "aerials_lost": "aeriels_lost",
    "turnovers": "turn_over",
}
FOOTBALL_ALLOWED = {"shots_on_target_allowed": "shots_on_target", "shots_allowed": "shots_total", "big_chances_allowed": "big_chances_created"}
# Percentages of a season's sums, two digits: (name, made, tried).
FOOTBALL_PERCENTAGES = (
    ("tackles_won_percentage", "tackles_won", "tackles"),
    ("pass_accuracy", "accurate_passes", "passes"),
    ("long_ball_accuracy", "long_balls_won", "long_balls"),
    ("cross_accuracy", "accurate_crosses", "total_crosses"),
    ("shot_accuracy", "shots_on_target", "shots_total"),
    ("dribble_success_rate", "successful_dribbles", "dribble_attempts"),
    ("duels_won_percentage", "duels_won", "total_duels"),
    ("aerials_won_percentage", "aerials_won", "aerials_total"),
)
# A basketball team's means, under the same name, and percentages of sums: (name, whose, made, tried).
BASKETBALL_MEANS = "pts reb oreb dreb ast stl blk turnover pf fgm fga fg3m fg3a ftm fta".split()
BASKETBALL_PERCENTAGES = (
    ("fg_pct", "stats", "fgm", "fga"),
    ("fg3_pct", "stats", "fg3m", "fg3a"),
    ("ft_pct", "stats", "ftm", "fta"),
    ("def_fg_pct", "opp_stats", "fgm", "fga"),
    ("def_fg3_pct", "opp_stats", "fg3m", "fg3a"),
)


def football_season(games: DataFrame) -> DataFrame:
    """games: fixture, season, team, home (boolean), score, stats (map of numbers) -> team, season, bag.

    The share of the ball is the mean of the games that have one above zero, so a missing share isn't none.
    """
    both = beside_opponents(games, "home")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    won, drawn, lost = (F.coalesce(c, F.lit(False)) for c in (F.col("score") > F.col("opp_score"), F.col("score") == F.col("opp_score"), F.col("score") < F.col("opp_score")))
    out = {"matches_played": F.count("*"), "wins": F.count_if(won), "draws": F.count_if(drawn), "losses": F.count_if(lost), "goals_for": total(F.col("score")), "goals_against": total(F.col("opp_score"))}
    for name, there in (("home", F.col("home")), ("away", ~F.col("home"))):
        out |= {f"{name}_played": F.count_if(there), f"{name}_won": F.count_if(there & won), f"{name}_draw": F.count_if(there & drawn), f"{name}_lost": F.count_if(there & lost)}
        out |= {f"{name}_scored": total(F.when(there, F.col("score"))), f"{name}_conceded": total(F.when(there, F.col("opp_score")))}
    out |= {s: total(F.col("stats")[s]) for s in FOOTBALL_TOTALS}
    out |= {n: total(F.col("stats")[s]) for n, s in FOOTBALL_RENAMED.items()}
    out |= {n: total(F.col("opp_stats")[s]) for n, s in FOOTBALL_ALLOWED.items()}
    out |= {n: rounded(F.avg(F.nullif(F.col(of)["possession_pct"], F.lit(0.0))), 2) for n, of in (("possession_pct", "stats"), ("opp_possession_pct", "opp_stats"))}
    made = both.groupBy("team", "season").agg(*(c.alias(n) for n, c in out.items()))
    points = lambda won, drawn: 3 * F.col(won) + F.col(drawn)
    more = {"goal_difference": F.col("goals_for") - F.col("goals_against"), "points": points("wins", "draws"), "overall_points": points("wins", "draws")}
    more |= {f"{w}_points": points(f"{w}_won", f"{w}_draw") for w in ("home", "away")}
    more |= {n: F.when(F.col(tried) > 0, rounded(F.col(of) / F.col(tried) * 100, 2)) for n, of, tried in FOOTBALL_PERCENTAGES}
    made = made.withColumns(more)
    return made.select("team", "season", build_bag(**{c: F.col(c) for c in made.columns if c not in ("team", "season")}).alias("bag"))


def opponents_share(games: DataFrame) -> DataFrame:
    """team, season and opp_possession_pct, as football_season has it, without the rest of the season."""
    return beside_opponents(games).groupBy("team", "season").agg(rounded(F.avg(F.nullif(F.col("opp_stats")["possession_pct"], F.lit(0.0))), 2).alias("opp_possession_pct"))


def basketball_season(games: DataFrame) -> DataFrame:
    """games: fixture, season, team, score, stats (map of numbers) -> team, season, bag: means a game, percentages of sums, what opponents made."""
    both = beside_opponents(games)
    mean = lambda of, s: rounded(F.avg(F.col(of)[s]), 1)
    total = lambda of, s: F.sum(F.coalesce(F.col(of)[s], F.lit(0.0)))
    out = {"games_played": F.count("*"), "wins": F.count_if(F.col("score") > F.col("opp_score")), "losses": F.count_if(F.col("score") < F.col("opp_score")), "pts_allowed": mean("opp_stats", "pts")}
    out |= {s: mean("stats", s) for s in BASKETBALL_MEANS}
    out |= {n: F.when(total(of, tried) > 0, rounded(total(of, made) / total(of, tried) * 100, 1)) for n, of, made, tried in BASKETBALL_PERCENTAGES}
    got = both.groupBy("team", "season").agg(*(c.alias(n) for n, c in out.items()))
    return got.select("team", "season", build_bag(**{n: F.col(n) for n in out}).alias("bag"))
