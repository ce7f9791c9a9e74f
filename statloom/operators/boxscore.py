"""Box scores from JSON payloads of three layouts: normal rows, stat bags, nested groups with team totals beside them; and the check that admits a game."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# The fields that payloads hold.
GAME = "struct<id:bigint,status:string,home_team_id:bigint,visitor_team_id:bigint,home_team_score:double,visitor_team_score:double>"
ROW = f"struct<id:bigint,min:string,pts:double,player:struct<id:bigint>,team:struct<id:bigint>,game:{GAME}>"
FLAT = f"struct<stats:struct<data:array<{ROW}>>>"
TYPED = "struct<data:struct<id:bigint,lineups:array<struct<player_id:bigint,team_id:bigint,details:array<struct<type:string,value:double>>>>>>"

_CODED = "type:struct<code:string>,data:struct<value:string>"
NESTED = (
    f"struct<data:struct<id:bigint,lineups:array<struct<player_id:bigint,team_id:bigint,player:struct<id:bigint>,team:struct<id:bigint>,details:array<struct<{_CODED}>>>>,"
    "events:array<struct<player_id:bigint,type_id:int,related_player_id:bigint>>,"
    f"statistics:array<struct<participant_id:bigint,{_CODED}>>,"
    "scores:array<struct<participant_id:bigint,score:struct<goals:string>>>>>"
)
# The kinds of event that count as a stat of their player; a goal also counts for whoever is named beside.
COUNTED = {14: "goals", 16: "penalty_goals", 17: "penalties_missed", 19: "yellow_cards", 20: "red_cards", 21: "red_cards"}
GOAL = 14


def minutes(c: Column) -> Column:
    """'34:30' and '34' as minutes; null for anything else."""
    whole, seconds = F.regexp_extract(c, r"^(\d+)(?::(\d{2}))?$", 1), F.regexp_extract(c, r"^(\d+)(?::(\d{2}))?$", 2)
    return F.when(whole != "", F.try_to_number(whole, F.lit("999999")).cast("double") + F.coalesce(F.nullif(seconds, F.lit("")).cast("double"), F.lit(0.0)) / 60)


def flat_rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each player line of payloads that list them; payloads that aren't of this layout give none."""
    line = payloads.select(F.inline(F.from_json(payload, FLAT)["stats"]["data"]))
    game = {n: F.col(f"game.{f}") for n, f in (("status", "status"), ("home", "home_team_id"), ("away", "visitor_team_id"), ("home_score", "home_team_score"), ("away_score", "visitor_team_score"))}
    return line.select(F.col("game.id").alias("fixture"), F.col("player.id").alias("player"), F.col("team.id").alias("team"), F.col("id").alias("line"), minutes(F.col("min")).alias("minutes"), F.col("pts").alias("points"), *(c.alias(n) for n, c in game.items()))


def typed_bags(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """fixture, player, team and the stat bag of payloads that give stats as (type, value) pairs; a type's last value wins."""
    p = payloads.select(F.from_json(payload, TYPED)["data"].alias("p")).select(F.col("p.id").alias("fixture"), F.inline("p.lineups"))
    last = F.aggregate("details", F.expr("cast(map() as map<string,double>)"), lambda bag, x: F.map_concat(F.map_filter(bag, lambda k, _: k != x["type"]), F.create_map(x["type"], x["value"])))
    return p.select("fixture", F.col("player_id").alias("player"), F.col("team_id").alias("team"), last.alias("bag"))


def _let(value: Column, made) -> Column:
    """made(value), for which value is computed once."""
    return F.transform(F.array(value), made)[0]


def _last(items: Column, *keys: str) -> Column:
    """Of items that are alike in keys the last one."""
    later = lambda all_, i: F.slice(all_, i + 2, F.size(all_))
    alike = lambda x, y: reduce(and_, (x[k] == y[k] for k in keys))
    return _let(items, lambda all_: F.filter(all_, lambda x, i: ~F.exists(later(all_, i), lambda y: alike(x, y))))


def _last_by_code(coded: Column) -> Column:
    """Numbers by code from coded pairs; a code's last number wins, what isn't a number is left out."""
    pairs = F.transform(coded, lambda x: F.struct(x["type"]["code"].alias("k"), x["data"]["value"].try_cast("double").alias("v")))
    pairs = F.filter(pairs, lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    return F.map_from_entries(_last(F.coalesce(pairs, F.array().cast("array<struct<k:string,v:double>>")), "k"))


def _added(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x + y, x, y))


def _counts(names: Column) -> Column:
    """How often each name occurs, as a bag."""
    return _let(names, lambda all_: F.map_from_entries(F.transform(F.array_distinct(all_), lambda n: F.struct(n, F.size(F.filter(all_, lambda x: x == n)).cast("double")))))


def _known(items: Column, kind: str, *fields: str) -> Column:
    """Items whose fields are all known; none of them where there is no list."""
    return F.coalesce(F.filter(items, lambda x: reduce(and_, (x[f].isNotNull() for f in fields))), F.array().cast(f"array<struct<{kind}>>"))


def nested_rows(payloads: DataFrame, payload: str = "payload", one_each: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of payloads that nest their groups: each player's stats (fixture, player, team, stat, value), each team's (fixture, team, stat, value), and scores (fixture, team, score).

    Events count for their players beside what the line-up says. A team's stats are those given for it, and its players' added to them.
    A player that is listed twice is as the last line says; lines without player or team are left out; a team's score is its largest.
    A fixture's lists are reduced within its row, and only what is left of them is written. one_each: no fixture has two
    payloads, so nothing is shuffled; else a fixture's payloads are put together first, in one shuffle.
    """
    p = payloads.select(F.from_json(payload, NESTED)["data"].alias("p")).select("p.*")
    if not one_each:
        p = p.groupBy("id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("lineups", "events", "statistics", "scores")))
    lines = F.transform("lineups", lambda x: F.struct(F.coalesce(x["player_id"], x["player"]["id"]).alias("player"), F.coalesce(x["team_id"], x["team"]["id"]).alias("team"), x["details"].alias("details")))
    lines = _last(_known(lines, f"player:bigint,team:bigint,details:array<struct<{_CODED}>>", "player", "team"), "player")
    kinds = F.create_map(*(F.lit(x) for pair in COUNTED.items() for x in pair))
    beside = lambda e: F.when((e["type_id"] == GOAL) & e["player_id"].isNotNull(), e["related_player_id"])
    both = lambda e: F.array(F.struct(e["player_id"].alias("player"), F.element_at(kinds, e["type_id"]).alias("stat")), F.struct(beside(e).alias("player"), F.lit("assists").alias("stat")))
    named = _known(F.flatten(F.transform("events", both)), "player:bigint,stat:string", "player", "stat")
    own = lambda x, events: F.transform(F.filter(events, lambda e: e["player"] == x["player"]), lambda e: e["stat"])
    one = lambda x, events: F.struct(x["player"].alias("player"), x["team"].alias("team"), _added(_last_by_code(x["details"]), _counts(own(x, events))).alias("stats"))
    given = F.transform("statistics", lambda x: F.struct(x["participant_id"].alias("team"), x["type"]["code"].alias("stat"), x["data"]["value"].try_cast("double").alias("value")))
    given = _last(_known(given, "team:bigint,stat:string,value:double", "team", "stat", "value"), "team", "stat")
    goals = F.transform("scores", lambda x: F.struct(x["participant_id"].alias("team"), x["score"]["goals"].try_cast("double").alias("score")))
    most = lambda all_, t: F.array_max(F.transform(F.filter(all_, lambda x: x["team"] == t), lambda x: x["score"])).cast("int")
    scores = _let(_known(goals, "team:bigint,score:double", "team", "score"), lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda x: x["team"])), lambda t: F.struct(t.alias("team"), most(all_, t).alias("score"))))
    players = _let(named, lambda events: F.transform(lines, lambda x: one(x, events)))
    p = written(p.select(F.col("id").alias("fixture"), players.alias("players"), given.alias("given"), scores.alias("scores")), "parsed")  # read once a group

    apart = p.select("fixture", F.inline("players")).select("fixture", "player", "team", F.explode("stats").alias("stat", "value"))
    stated = lambda t: F.map_from_entries(F.transform(F.filter("given", lambda x: x["team"] == t), lambda x: F.struct(x["stat"], x["value"])))
    total = lambda t: F.aggregate(F.filter("players", lambda x: x["team"] == t), stated(t), lambda bag, x: _added(bag, x["stats"]))
    of = F.array_distinct(F.concat(F.transform("given", lambda x: x["team"]), F.transform("players", lambda x: x["team"])))
    teams = p.select("fixture", F.inline(F.transform(of, lambda t: F.struct(t.alias("team"), total(t).alias("stats"))))).select("fixture", "team", F.explode("stats").alias("stat", "value"))
    return apart, teams, p.select("fixture", F.inline("scores"))


def verdicts(rows: DataFrame) -> DataFrame:
    """Each fixture's verdict: the first rule that fails, or 'ok'."""
    g = rows.groupBy("fixture").agg(F.count("player").alias("players"), F.bool_or(F.col("team") == F.col("home")).alias("has_home"), F.bool_or(F.col("team") == F.col("away")).alias("has_away"), F.max("home_score").alias("h"), F.max("away_score").alias("a"))
    missing = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    why = F.when(F.col("players") == 0, "no_players").when(missing("has_home") | missing("has_away"), "missing_team").when(F.col("h").isNull() | F.col("a").isNull(), "no_score").otherwise("ok")
    return g.select("fixture", "players", why.alias("verdict"))
