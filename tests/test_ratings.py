"""Ratings, team seasons and fantasy points on hand-made frames."""

import math

from pyspark.sql import functions as F

from statloom.operators import bundle, cohort, teams
from statloom.plans import ratings

SCHEMA = "sport string, season int, mode string, player int, position string, label string, value double, in_comp boolean, in_spec boolean, sign int, facet string, eligible boolean"


def _rate(spark, rows):
    got = bundle.rate(spark.createDataFrame(rows, SCHEMA), ["player"], ["sport", "season", "mode"], ["position"], ("offense", "defense"))
    return {r.player: r for r in got.collect()}


def _given(player, position, goals, lost, eligible=True):
    base = ("X", 2020, "total", player, position)
    return [(*base, "Goals", goals, True, True, 1, "offense", eligible), (*base, "Lost", lost, True, False, -1, "defense", eligible), (*base, "Seen", 1.0, False, True, 1, "offense", eligible)]


def test_rating_against_a_plain_loop(spark):
    players = [(1, "a", 1.0, 9.0), (2, "a", 4.0, 2.0), (3, "b", None, 5.0), (4, "b", 8.0, 5.0), (5, None, 3.0, 1.0)]
    got = _rate(spark, [r for p in players for r in _given(*p)] + _given(6, "a", 100.0, 0.0, eligible=False))

    def z(values, v):
        known = [x for x in values if x is not None]
        mean = sum(known) / len(known)
        spread = math.sqrt(sum((x - mean) ** 2 for x in known) / len(known))
        return 0.0 if v is None else (v - mean) / spread

    goals, lost = [p[2] for p in players], [p[3] for p in players]
    want = {p[0]: round(z(goals, p[2]) - z(lost, p[3]), 4) for p in players}
    assert {p: r.composite for p, r in got.items() if p != 6} == want
    order = sorted(want, key=want.get)
    assert {p: got[p]["rank"] for p in order} == {p: round(100 * i / 4, 1) for i, p in enumerate(order)}
    assert got[5].scoped_ranks == {} and got[1].scoped_ranks == {"position": 0.0} and got[2].scoped_ranks == {"position": 100.0}
    assert [b.label for b in got[1].breakdown] == ["Goals", "Lost", "Seen"]
    of_lost = got[2].breakdown[1]
    assert math.isclose(of_lost.z, z(lost, 2.0)) and of_lost.pct == 75.0 and of_lost.scoped_pct == {"position": 100.0}
    assert got[4].standout.label == "Goals" and got[1].standout.label == "Seen"  # no deviation is a z of 0, above a bad one


def test_not_eligible(spark):
    got = _rate(spark, [r for p in ((1, "a", 1.0, 1.0), (2, "a", 3.0, 3.0)) for r in _given(*p)] + _given(3, "a", 100.0, 2.0, eligible=False))
    assert (got[3].composite, got[3]["rank"], got[3].score, got[3].scoped_ranks) == (None, None, None, None)
    assert [b.pct for b in got[3].breakdown] == [99.0, 50.0, 50.0] and got[3].breakdown[0].scoped_pct == {}
    assert _rate(spark, _given(3, "a", 100.0, 2.0, eligible=False)) == {} and _rate(spark, []) == {}


def test_large_cohorts_rank_alike(spark, monkeypatch):
    rows = [r for p in range(40) for r in _given(p, "ab"[p % 2], float(p * 7 % 11), float(p * 5 % 13))]
    one = _rate(spark, rows)
    plain = cohort.percent_ranks
    monkeypatch.setattr(bundle, "percent_ranks", lambda df, c, v, n: plain(df, c, v, n, in_one_task=3))
    assert _rate(spark, rows) == one


def test_modes_are_one_row(spark):
    rated = spark.createDataFrame([(1, "total", 5.0), (1, "per_90", 2.0), (2, "total", 7.0)], "player int, mode string, composite double")
    got = {r.player: r for r in bundle.by_mode(rated, ["player"], "total").collect()}
    assert got[1].composite == 5.0 and got[1].modes["per_90"].composite == 2.0 and got[2].modes == {}


def test_thresholds(spark):
    df = spark.createDataFrame([("A", {"x": 3.0}), ("A", {"x": 3.0, "y": 1.0}), ("B", {"x": 9.0})], "s string, b map<string,double>")
    assert [r.m for r in df.select(bundle.meets(F.col("b"), F.col("s"), {"A": {"x": 3, "y": 1}}).alias("m")).collect()] == [False, True, False]


GAMES = "fixture int, season int, team int, home boolean, score double, stats map<string,double>"


def test_football_season(spark):
    rows = [
        (1, 2020, 7, True, 2.0, {"tackles": 4.0, "tackles_won": 3.0, "possession_pct": 60.0, "shots_total": 3.0}),
        (1, 2020, 8, False, 1.0, {"possession_pct": 40.0, "shots_on_target": 5.0, "fouls": 2.0}),
        (2, 2020, 7, False, 1.0, {"possession_pct": 0.0}),
        (2, 2020, 8, True, 1.0, {}),
        (3, 2020, 7, True, None, {}),
    ]
    got = {r.team: r.bag for r in teams.football_season(spark.createDataFrame(rows, GAMES)).collect()}
    a, b = got[7], got[8]
    assert (a["matches_played"], a["wins"], a["draws"], a["losses"], a["points"], a["home_points"], a["away_points"]) == (3, 1, 1, 0, 4, 3, 1)
    assert (a["goal_difference"], a["home_scored"], a["away_conceded"], a["shots_on_target_allowed"]) == (1, 2, 1, 5)
    assert a["possession_pct"] == 60.0 and a["opp_possession_pct"] == 40.0 and a["tackles_won_percentage"] == 75.0 and "pass_accuracy" not in a
    assert b["fouls_committed"] == 2 and b["losses"] == 1 and "opp_possession_pct" in b


def test_basketball_season(spark):
    rows = [(1, 2020, 7, True, 9.0, {"pts": 9.0, "fgm": 3.0, "fga": 4.0}), (1, 2020, 8, False, 5.0, {"pts": 5.0, "fgm": 1.0, "fga": 3.0}), (2, 2020, 7, True, 1.0, {"pts": 2.0, "fga": 2.0})]
    got = {r.team: r.bag for r in teams.basketball_season(spark.createDataFrame(rows, GAMES)).collect()}
    assert (got[7]["games_played"], got[7]["wins"], got[7]["losses"]) == (2, 1, 0)
    assert got[7]["pts"] == 5.5 and got[7]["pts_allowed"] == 5.0 and got[7]["fg_pct"] == 50.0 and got[7]["def_fg_pct"] == 33.3 and "ft_pct" not in got[7]


def test_fantasy_points(spark):
    football = {"appearances": 10.0, "goals": 2.0, "assists": 1.0, "goals_conceded": 5.0, "saves": 7.0, "penalties_saved": 1.0, "red_cards": 1.0}
    rows = [("FOOTBALL", p, football) for p in ("Goalkeeper", "Defender", "Midfielder", None)]
    rows += [("NBA", None, {"pts": 10.0, "reb": 3.5, "fg3m": 1.0, "turnover": 1.0}), ("NFL", None, {"passing_yards": 101.0, "receptions": 2.0}), ("X", None, {}), ("NBA", None, {})]
    df = spark.createDataFrame(rows, "s string, p string, b map<string,double>")
    got = [r.f for r in df.select(ratings.fantasy(F.col("s"), F.col("p"), F.col("b")).alias("f")).collect()]
    base = 20.0 + 3.0 - 3.0
    assert got == [base + 12 - 2 + 2 + 5, base + 12 - 2, base + 10, base + 8, 14.38, 6.04, None, 0.0]


def test_totals_of_all_sports_in_one_pass(spark):
    """As the box scores of each sport add up; the lines are read once, not once a sport."""
    from statloom.operators import rollup
    from statloom.plans import sports

    d = "/root/testdata/sf0.001"
    made = sports.season_totals(spark, d)
    assert made._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1
    got = {(r.sport, r.player, r.team, r.season): r.asDict() for r in made.collect()}
    n = 0
    for sport, names in sports.STATS.items():
        rows = sports.counted(sports.box(spark, d, sport), sport)
        want = rollup.season_rollup(rows, ["player", "team", "season"], {"minutes": F.sum("minutes"), "games": F.count("*"), **{s: F.sum(F.col("bag")[s]) for s in names}})
        for r in want.collect():
            x = got[sport, r.player, r.team, r.season]
            assert (x["minutes"], x["games"], [x[f"x{i}"] for i in range(len(names))]) == (r.minutes, r.games, [r[s] for s in names])
            n += 1
    assert n == len(got) > 0


def test_opponents_share_alone(spark):
    rows = [(1, 2020, 7, True, 2.0, {"possession_pct": 60.0}), (1, 2020, 8, False, 1.0, {"possession_pct": 40.0}), (2, 2020, 7, False, 1.0, {"possession_pct": 0.0}), (2, 2020, 8, True, 1.0, {}), (3, 2020, 9, True, None, {})]
    games = spark.createDataFrame(rows, GAMES)
    whole = {(r.team, r.season): r.bag.get("opp_possession_pct") for r in teams.football_season(games).collect()}
    assert {(r.team, r.season): r.opp_possession_pct for r in teams.opponents_share(games).collect()} == whole and whole[7, 2020] == 40.0 and whole[9, 2020] is None


def test_datapoints_in_the_plan_are_those_of_the_registry(spark):
    from statloom.operators import datapoints as dp

    own = {"NFL": {"passing_yards": 7.0, "fumbles_lost": 2.0, "tackles_for_loss": 1.0, "defensive_sacks": 3.0, "fumbles_lost_per_game": 0.5}, "NBA": {"pts": 9.0, "turnover": 4.0, "tov_per_36": 1.5, "plus_minus": 3.0, "plus_minus_per_36": 8.0}}
    own["FOOTBALL"] = {"tackles": 6.0, "tackles_per_90": 2.0, "team_opp_possession": 20.0, "saves": 8.0, "saves_per_90": 1.0, "goals_conceded": 2.0, "league_avg_save_pct": 70.0}
    for sport, bag in own.items():
        players = spark.createDataFrame([(sport, i, p, b) for i, (p, b) in enumerate((p, b) for p in ("Goalkeeper", "QB", None) for b in (bag, {}))], "sport string, player int, position string, bag map<string,double>")
        for suffix in (None, dp.SUFFIX[sport]):
            want, got = dp.datapoints(players, dp.registry(spark, dp.PLAYER), bool(suffix)), dp.listed(players, [r for r in dp.PLAYER if r[0] == sport], suffix)
            assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []


def test_every_rate_is_whole(spark):
    """Each rate has its datapoints and not a digest of them, football has both of its rates, and blocks are rated as other stats."""
    rows = ratings.player_ratings(spark, "/root/testdata/sf0.001").collect()
    value = lambda text, label: next(x.split("|")[1] for x in text.split("; ") if x.split("|")[0] == label)
    blocks = set()
    for r in rows:
        lines = dict(x.split(": ", 1) for x in r.modes.split("\n"))
        assert sorted(lines) == {"NBA": ["per_36"], "NFL": ["per_game"], "FOOTBALL": ["per_90", "per_game"]}[r.sport]
        listed = {m: x.split(": ", 1)[1] for m, x in lines.items()}
        assert all([x.split("|")[0] for x in t.split("; ")] == [x.split("|")[0] for x in r.breakdown.split("; ")] for t in listed.values())
        if r.sport == "NBA" and value(r.breakdown, "Rim Protection") not in ("-", "0.0000"):
            blocks.add(value(r.breakdown, "Rim Protection") != value(listed["per_36"], "Rim Protection"))
    assert {r.sport for r in rows} == {"NBA", "NFL", "FOOTBALL"} and blocks == {True}
