"""Rated datapoints: which stats of a bag count, in which direction, for whom, and as a rate or a total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rounded

SCHEMA = "sport string, gate string, label string, formula string, stats array<string>, weights array<double>, in_comp boolean, in_spec boolean, sign int, facet string, rated boolean"


def _one(sport, gate, label, stat, in_comp, in_spec, sign, facet, rated=True, formula="plain"):
    return sport, gate, label, formula, [stat], [1.0], in_comp, in_spec, sign, facet, rated


def _total(label, weights, in_comp, in_spec, sign, facet, formula="sum", sport="NFL"):
    return sport, "all", label, formula, list(weights), [float(w) for w in weights.values()], in_comp, in_spec, sign, facet, True


# A player's datapoints. Formulas: plain (missing stays missing), sum (missing counts zero), most, possession
# (at 50 % of the ball, the opponents' share being 30 at least), prevented (saves over what the league's share would save).
PLAYER = [
    _one("NBA", "all", "Scoring", "pts", True, True, 1, "all"),
    _one("NBA", "all", "Rebounding", "reb", True, True, 1, "all"),
    _one("NBA", "all", "Playmaking", "ast", True, True, 1, "all"),
    _one("NBA", "all", "Steals", "stl", True, True, 1, "all"),
    _one("NBA", "all", "Rim Protection", "blk", True, True, 1, "all"),
    _one("NBA", "all", "3PT Shooting", "fg3m", True, True, 1, "all"),
    _one("NBA", "all", "On-Court Impact", "plus_minus", True, False, 1, "all", rated=False),
    _one("NBA", "all", "Ball Security", "turnover", True, False, -1, "all"),
    _one("NBA", "all", "Discipline", "pf", True, False, -1, "all"),
    _one("NBA", "all", "Foul Drawing", "fta", False, True, 1, "all"),
    _one("FOOTBALL", "out", "Goalscoring", "goals", True, True, 1, "all"),
    _one("FOOTBALL", "out", "Creation", "assists", True, True, 1, "all"),
    _one("FOOTBALL", "out", "Shooting", "shots_on_target", True, True, 1, "all"),
    _one("FOOTBALL", "out", "Passing", "passes_accurate", True, True, 1, "all"),
    _one("FOOTBALL", "out", "Key Passes", "key_passes", True, True, 1, "all"),
    _one("FOOTBALL", "out", "Dribbling", "dribbles_success", True, True, 1, "all"),
    _one("FOOTBALL", "out", "Duels", "duels_won", False, False, 1, "all"),
    _one("FOOTBALL", "out", "Tackling", "tackles", True, True, 1, "all", formula="possession"),
    _one("FOOTBALL", "out", "Interceptions", "interceptions", True, True, 1, "all", formula="possession"),
    _one("FOOTBALL", "out", "Clearances", "clearances", False, False, 1, "all"),
    _one("FOOTBALL", "out", "Blocks", "blocks", False, False, 1, "all"),
    _one("FOOTBALL", "out", "Ball Recovery", "ball_recovery", False, False, 1, "all"),
    _one("FOOTBALL", "out", "Drawing Fouls", "fouls_drawn", False, False, 1, "all"),
    _one("FOOTBALL", "out", "Penalties Won", "penalties_won", False, True, 1, "all", rated=False),
    _one("FOOTBALL", "out", "Possession Lost", "possession_lost", True, False, -1, "all"),
    _one("FOOTBALL", "gk", "Shot-Stopping", "saves", False, False, 1, "all"),
    _one("FOOTBALL", "gk", "Goals Prevented", "saves", True, True, 1, "all", rated=False, formula="prevented"),
    _one("FOOTBALL", "gk", "Distribution", "pass_accuracy", True, True, 1, "all", rated=False),
    _one("FOOTBALL", "gk", "Long-Ball Accuracy", "long_ball_accuracy", True, True, 1, "all", rated=False),
    _total("Air Yards Responsible", {"passing_yards": 1, "receiving_yards": 1, "kick_return_yards": 1, "punt_returner_return_yards": 1, "punt_yards": 1, "interception_yards": 1}, True, True, 1, "offense"),
    _total("Ground Yards Responsible", {"rushing_yards": 1}, True, True, 1, "offense"),
    _total("Points Responsible For", {"passing_touchdowns": 6, "rushing_touchdowns": 6, "receiving_touchdowns": 6, "kick_return_touchdowns": 6, "punt_return_touchdowns": 6, "interception_touchdowns": 6, "fumbles_touchdowns": 6, "field_goals_made": 3, "extra_points_made": 1}, True, True, 1, "offense"),
    _total("Giveaways", {"passing_interceptions": 1, "fumbles_lost": 1}, True, False, -1, "offense"),
    _one("NFL", "all", "Tackling", "total_tackles", True, True, 1, "defense"),
    _total("Tackles For Loss", {"tackles_for_loss": 1, "defensive_sacks": 1}, True, True, 1, "defense", formula="most"),
    _one("NFL", "all", "Interceptions", "defensive_interceptions", True, True, 1, "defense"),
]

# A team's datapoints; totals only. Formula shared: at 50 % of the ball, the opponents' share being 30 at least, in whole numbers.
TEAM = [
    _one("NBA", "all", "Scoring", "pts", True, True, 1, "offense"),
    _one("NBA", "all", "Playmaking", "ast", True, True, 1, "offense"),
    _one("NBA", "all", "3PT Shooting", "fg3m", True, True, 1, "offense"),
    _one("NBA", "all", "Foul Drawing", "fta", True, True, 1, "offense"),
    _one("NBA", "all", "Ball Security", "turnover", True, False, -1, "offense"),
    _one("NBA", "all", "Offensive Rebounds", "oreb", False, False, 1, "offense"),
    _one("NBA", "all", "Rim Protection", "blk", True, True, 1, "defense"),
    _one("NBA", "all", "Steals", "stl", True, True, 1, "defense"),
    _one("NBA", "all", "Rebounding", "reb", True, True, 1, "defense"),
    _one("NBA", "all", "Points Allowed", "pts_allowed", True, False, -1, "defense"),
    _one("NBA", "all", "Defensive Rebounds", "dreb", False, False, 1, "defense"),
    _one("NBA", "all", "Opp FG%", "def_fg_pct", False, False, -1, "defense"),
    _one("NBA", "all", "Opp 3PT%", "def_fg3_pct", False, False, -1, "defense"),
    _one("NFL", "all", "Points Scored", "points_for", True, True, 1, "offense"),
    _one("NFL", "all", "Total Yards", "total_yards", True, True, 1, "offense"),
    _one("NFL", "all", "Giveaways", "turnovers", True, False, -1, "offense"),
    _total("Touchdowns", {"passing_touchdowns": 1, "rushing_touchdowns": 1}, False, False, 1, "offense"),
    _one("NFL", "all", "First Downs", "first_downs", False, False, 1, "offense"),
    _one("NFL", "all", "Field Goals", "field_goals_made", False, False, 1, "offense"),
    _one("NFL", "all", "Red Zone %", "red_zone_pct", False, False, 1, "offense"),
    _one("NFL", "all", "Third Down %", "third_down_pct", False, False, 1, "offense"),
    _one("NFL", "all", "Penalty Yards For", "penalty_yards_drawn", True, False, 1, "offense"),
    _one("NFL", "all", "Tackling", "total_tackles", True, True, 1, "defense"),
    _one("NFL", "all", "Sacks", "defensive_sacks", True, True, 1, "defense"),
    _one("NFL", "all", "Pass Defense", "passes_defended", True, True, 1, "defense"),
    _one("NFL", "all", "Interceptions", "defensive_interceptions", True, True, 1, "defense"),
    _one("NFL", "all", "Points Allowed", "points_against", True, False, -1, "defense"),
    _one("NFL", "all", "Yards Allowed", "yards_allowed", True, False, -1, "defense"),
    _one("NFL", "all", "Penalty Yards Against", "penalty_yards", True, False, -1, "defense"),
    _one("NFL", "all", "Tackles For Loss", "tackles_for_loss", False, False, 1, "defense"),
    _one("NFL", "all", "Takeaways", "takeaways", False, False, 1, "defense"),
    _one("NFL", "all", "Red Zone Def %", "red_zone_def_pct", False, False, -1, "defense"),
    _one("NFL", "all", "Third Down Def %", "third_down_def_pct", False, False, -1, "defense"),
    _one("NFL", "all", "First Downs Allowed", "first_downs_allowed", False, False, -1, "defense"),
    _one("FOOTBALL", "all", "Goals For", "goals_for", True, True, 1, "offense"),
    _one("FOOTBALL", "all", "Shooting", "shots_on_target", True, True, 1, "offense"),
    _one("FOOTBALL", "all", "Creation", "big_chances_created", True, True, 1, "offense"),
    _one("FOOTBALL", "all", "Injuries", "injuries", True, False, -1, "offense"),
    _one("FOOTBALL", "all", "Penalties Won", "penalties_won", False, False, 1, "offense"),
    _one("FOOTBALL", "all", "Fouls Won", "fouls_drawn", False, False, 1, "offense"),
    _one("FOOTBALL", "all", "Possession Lost", "possession_lost", True, False, -1, "offense"),
    _one("FOOTBALL", "all", "Possession %", "possession_pct", False, False, 1, "offense"),
    _one("FOOTBALL", "all", "Accurate Passes", "accurate_passes", False, False, 1, "offense"),
    _total("Progression", {"passes_final_third": 1, "successful_dribbles": 1}, True, False, 1, "offense", sport="FOOTBALL"),
    _one("FOOTBALL", "all", "Tackling", "tackles", True, True, 1, "defense", formula="shared"),
    _one("FOOTBALL", "all", "Interceptions", "interceptions", True, True, 1, "defense", formula="shared"),
    _one("FOOTBALL", "all", "Clearances", "clearances", False, False, 1, "defense"),
    _one("FOOTBALL", "all", "SoT Allowed", "shots_on_target_allowed", True, False, -1, "defense"),
    _one("FOOTBALL", "all", "Blocked Shots", "blocked_shots", False, False, 1, "defense"),
    _one("FOOTBALL", "all", "Big Chances Allowed", "big_chances_allowed", True, False, -1, "defense"),
    _one("FOOTBALL", "all", "Goals Against", "goals_against", True, False, -1, "defense"),
    _one("FOOTBALL", "all", "Fouls Committed", "fouls_committed", False, False, -1, "defense"),
    _total("Cards", {"yellow_cards_total": 1, "red_cards_total": 1}, True, False, -1, "defense", sport="FOOTBALL"),
]

# The names of a bag's stat in another mode than the total.
RATED_AS = {"turnover": "tov"}
SUFFIX = {"NBA": "_per_36", "NFL": "_per_game", "FOOTBALL": "_per_90"}


def registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A registry as a table: it holds as many rows as the constant has."""
    return spark.createDataFrame(rows, SCHEMA)


def gate_of(sport: Column, position: Column) -> Column:
    """Whose datapoints of a player count: football has its goalkeepers apart."""
    return F.when(sport != "FOOTBALL", "all").when(position == "Goalkeeper", "gk").otherwise("out")


def position_group(sport: Column, position: Column) -> Column:
    """The group in which a player's position is compared; null if there is none."""
    groups = {
        "quarterback": ("Quarterback", "QB"),
        "running-back": ("Running Back", "Fullback", "RB", "FB", "HB"),
        "receiver": ("Wide Receiver", "Tight End", "WR", "TE"),
    }
    nfl = F.coalesce(*(F.when(position.isin(*names), g) for g, names in groups.items()))
    football = F.when(position.isin("Goalkeeper", "Defender", "Midfielder", "Attacker"), F.lower(position))
    return F.when(F.upper(sport) == "NBA", "ALL").when(F.upper(sport) == "NFL", nfl).when(F.upper(sport) == "FOOTBALL", football)


def datapoints(players: DataFrame, registered: DataFrame, rated: bool, teams: bool = False) -> DataFrame:
    """players (sport, position, bag, more) -> their other columns and label, value, in_comp, in_spec, sign, facet.

    teams: the rows are teams, which have no positions. rated: a datapoint takes the stat's rate sibling where the bag has one, else its total. One broadcast join with the
    registry, no shuffle; values come from the row's own bag.
    """
    own = [c for c in players.columns if c != "bag"]
    p = players.withColumn("_gate", F.lit("all") if teams else gate_of(F.col("sport"), F.col("position")))
    j = p.alias("p").join(F.broadcast(registered).alias("r"), (F.col("p.sport") == F.col("r.sport")) & (F.col("p._gate") == F.col("r.gate")))
    bag = F.col("p.bag")
    if rated:
        base = F.create_map(*(F.lit(x) for pair in RATED_AS.items() for x in pair))
        suffix = F.create_map(*(F.lit(x) for pair in SUFFIX.items() for x in pair))[F.col("p.sport")]
        whole = F.transform("r.stats", lambda s: F.coalesce(F.when(F.col("r.rated"), bag[F.concat(F.coalesce(base[s], s), suffix)]), bag[s]))
    else:
        whole = F.transform("r.stats", lambda s: bag[s])
    j = j.withColumn("_v", whole)
    zeroed = F.zip_with("_v", F.col("r.weights"), lambda v, w: F.coalesce(v, F.lit(0.0)) * w)
    first = F.col("_v")[0]
    value = (
        F.when(F.col("r.formula") == "plain", first)
        .when(F.col("r.formula") == "sum", F.aggregate(zeroed, F.lit(0.0), lambda a, x: a + x))
        .when(F.col("r.formula") == "most", F.array_max(zeroed))
        .when(F.col("r.formula") == "possession", rounded(first * 50.0 / F.greatest(bag["team_opp_possession"], F.lit(30.0)), 2))
        .when(F.col("r.formula") == "shared", F.round(first * 50.0 / F.greatest(bag["opp_possession_pct"], F.lit(30.0))))
        .when(F.col("r.formula") == "prevented", first - (first + F.coalesce(bag["goals_conceded"], F.lit(0.0))) * bag["league_avg_save_pct"] / 100.0)
    )
    return j.select(*(F.col(f"p.{c}").alias(c) for c in own), F.col("r.label").alias("label"), value.alias("value"), *(F.col(f"r.{c}").alias(c) for c in ("in_comp", "in_spec", "sign", "facet")))


def valued(bag: Column, row: tuple, suffix: str | None = None) -> Column:
    """The value of one of the registry's rows, as ``datapoints`` has it. suffix: that of the rates, none for totals."""
    formula, stats, weights, rated = row[3], row[4], row[5], row[10]
    stat = lambda s: F.coalesce(bag[RATED_AS.get(s, s) + suffix], bag[s]) if suffix and rated else bag[s]
    first, zeroed = stat(stats[0]), [F.coalesce(stat(s), F.lit(0.0)) * w for s, w in zip(stats, weights, strict=True)]
    return {
        "plain": lambda: first,
        "sum": lambda: sum(zeroed, F.lit(0.0)),
        "most": lambda: F.greatest(*zeroed),
        "possession": lambda: rounded(first * 50.0 / F.greatest(bag["team_opp_possession"], F.lit(30.0)), 2),
        "prevented": lambda: first - (first + F.coalesce(bag["goals_conceded"], F.lit(0.0))) * bag["league_avg_save_pct"] / 100.0,
    }[formula]()


def listed(players: DataFrame, rows: list[tuple], suffix: str | None = None) -> DataFrame:
    """``datapoints`` of one sport's players, whose rows of the registry are written into the plan: no lists of stats are walked for each row."""
    own = [c for c in players.columns if c != "bag"]
    one = lambda r: F.struct(F.lit(r[2]).alias("label"), valued(F.col("bag"), r, suffix).alias("value"), *(F.lit(x).alias(n) for n, x in zip(("in_comp", "in_spec", "sign", "facet"), r[6:10], strict=True)))
    of = {g: F.array(*(one(r) for r in rows if r[1] == g)) for g in dict.fromkeys(r[1] for r in rows)}
    gate = gate_of(F.col("sport"), F.col("position"))
    return players.select(*own, F.inline(F.coalesce(*(F.when(gate == g, x) for g, x in of.items()))))
