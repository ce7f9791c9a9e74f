"""Box-score payloads: layouts, odd fields, and each verdict."""

import json

from pyspark.sql import functions as F

from statloom.functions import scalar as S
from statloom.operators import boxscore, teams


def line(player, team, minutes="12:30", points=4.0, home=1, away=2, h=90.0, a=88.0, game=7):
    own = {"id": game, "status": "Final", "home_team_id": home, "visitor_team_id": away, "home_team_score": h, "visitor_team_score": a}
    return {"id": player, "min": minutes, "pts": points, "player": {"id": player}, "team": {"id": team}, "game": own}


def frame(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) or p is None else json.dumps(p),) for p in payloads], "payload string")


def test_flat_rows_and_odd_payloads(spark):
    got = boxscore.flat_rows(frame(spark, {"stats": {"data": [line(5, 1), line(6, 2, minutes="34", points=None)]}}, {"stats": {"data": []}}, {"other": 1}, "not json", None)).collect()
    assert [(r.fixture, r.player, r.team, r.minutes, r.points) for r in sorted(got)] == [(7, 5, 1, 12.5, 4.0), (7, 6, 2, 34.0, None)]


def test_minutes(spark):
    said = spark.createDataFrame([("34:30",), ("8",), ("",), ("DNP",), (None,), ("1:2",)], "m string")
    assert [r[0] for r in said.select(boxscore.minutes(F.col("m"))).collect()] == [34.5, 8.0, None, None, None, None]


def test_typed_bags_last_value_wins(spark):
    details = [{"type": "goals", "value": 1}, {"type": "shots", "value": 3}, {"type": "goals", "value": 2}]
    p = {"data": {"id": 3, "lineups": [{"player_id": 9, "team_id": 4, "details": details}, {"player_id": 10, "team_id": 4, "details": []}]}}
    got = {r.player: r.bag for r in boxscore.typed_bags(frame(spark, p, "x", None)).collect()}
    assert got == {9: {"goals": 2.0, "shots": 3.0}, 10: {}}


def test_verdicts(spark):
    games = [
        {"stats": {"data": [line(1, 1, game=1), line(2, 2, game=1)]}},
        {"stats": {"data": [line(1, 1, game=2)]}},
        {"stats": {"data": [line(1, 1, game=3, h=None), line(2, 2, game=3, h=None)]}},
        {"stats": {"data": [line(None, 1, game=4), line(None, 2, game=4)]}},
    ]
    got = {r.fixture: r.verdict for r in boxscore.verdicts(boxscore.flat_rows(frame(spark, *games))).collect()}
    assert got == {1: "ok", 2: "missing_team", 3: "no_score", 4: "no_players"}


def test_ordinals(spark):
    n = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 11, 12, 13, 21, 112)], "n int")
    assert [r[0] for r in n.select(S.ordinal(F.col("n"))).collect()] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]


def test_nested_rows(spark):
    coded = lambda **stats: [{"type": {"code": k.replace("_", "-")}, "data": {"value": v}} for k, v in stats.items()]
    p = {
        "data": {
            "id": 3,
            "lineups": [
                {"player_id": 9, "team_id": 4, "details": [*coded(goals=5), *coded(goals=1, minutes_played="90", rating="n/a")]},
                {"player": {"id": 10}, "team": {"id": 5}, "details": None},
                {"player_id": 11, "details": coded(goals=3)},
                {"player_id": 12, "team_id": 4, "details": coded(goals=9)},
                {"player_id": 12, "team_id": 5, "details": coded(shots=2)},
            ],
            "events": [
                {"player_id": 9, "type_id": 14, "related_player_id": 10},
                {"player_id": 10, "type_id": 20},
                {"player_id": 10, "type_id": 21},
                {"player_id": 10, "type_id": 99},
                {"player_id": 77, "type_id": 14},
                {"player_id": None, "type_id": 14, "related_player_id": 9},
            ],
            "statistics": [{"participant_id": 4, **coded(goals=7)[0]}, {"participant_id": 4, **coded(corners=2)[0]}, {"participant_id": 4, **coded(corners=3)[0]}, {"participant_id": 6, **coded(corners="x")[0]}],
            "scores": [{"participant_id": 4, "score": {"goals": 1}}, {"participant_id": 4, "score": {"goals": 2}}, {"participant_id": 5, "score": {"goals": None}}],
        }
    }
    players, teams, scores = (sorted(map(tuple, t.collect())) for t in boxscore.nested_rows(frame(spark, p, {"data": {"id": 8}}, "x", None)))
    assert players == [(3, 9, 4, "goals", 2.0), (3, 9, 4, "minutes-played", 90.0), (3, 10, 5, "assists", 1.0), (3, 10, 5, "red_cards", 2.0), (3, 12, 5, "shots", 2.0)]
    assert teams == [(3, 4, "corners", 3.0), (3, 4, "goals", 9.0), (3, 4, "minutes-played", 90.0), (3, 5, "assists", 1.0), (3, 5, "red_cards", 2.0), (3, 5, "shots", 2.0)]
    assert scores == [(3, 4, 2)]


def test_made_and_tried(spark):
    said = spark.createDataFrame([("5-12",), (" 0/3 ",), ("5",), ("a-b",), ("",), (None,), ("5-12-1",)], "t string")
    made, tried = teams.made_and_tried(F.col("t"))
    assert [tuple(r) for r in said.select(made, tried).collect()] == [(5, 12), (0, 3), *[(None, None)] * 5]


def test_american_season(spark):
    shape = "fixture long, season int, team long, score double, stats map<string,double>, texts map<string,string>"
    rows = [
        (1, 2000, 7, 20.0, {"passing_interceptions": 1.0, "total_yards": 300.0, "qbr": 50.0}, {"third_down_efficiency": "4-10"}),
        (1, 2000, 8, 10.0, {"passing_interceptions": 2.0, "fumbles_lost": 1.0, "total_yards": 200.0, "total_offensive_plays": 40.0}, {"third_down_efficiency": "1-5"}),
        (2, 2000, 7, 3.0, {"qbr": None}, None),
        (3, 2000, 7, 3.0, {"qbr": 61.0}, {"third_down_efficiency": "x"}),
        (3, 2000, 9, 3.0, None, {}),
        (4, 2000, 9, None, None, None),
        (4, 2000, 7, 5.0, None, None),
    ]
    bags_ = {r.team: r.bag for r in teams.american_season(spark.createDataFrame(rows, shape)).collect()}
    seven = bags_[7]
    assert [seven[k] for k in ("games_played", "wins", "losses", "ties", "takeaways", "turnovers", "turnover_differential", "yards_allowed", "third_down_pct", "third_down_def_pct", "qbr", "yards_per_play_allowed", "points_per_game")] == [4, 1, 0, 1, 3, 1, 2, 200, 40.0, 20.0, 55.5, 5.0, 7.8]
    assert "fourth_down_pct" not in seven and not any(k.startswith("opp_") for k in seven)
    assert (bags_[8]["losses"], bags_[8]["takeaways"], bags_[9]["ties"], bags_[9]["games_played"]) == (1, 1, 1, 2)


def test_nested_payloads_are_parsed_once(spark):
    """Every group of a payload is read from its parsed form."""
    payload = '{"data": {"id": 1, "lineups": [{"player_id": 2, "team_id": 3, "details": [{"type": {"code": "goals"}, "data": {"value": "1"}}]}], "events": [{"player_id": 2, "type_id": 14, "related_player_id": 9}, {"player_id": 9, "type_id": 19}]}}'
    players, teams, _ = boxscore.nested_rows(spark.createDataFrame([(payload,)], "payload string"))
    assert [tuple(r) for r in players.collect()] == [(1, 2, 3, "goals", 2.0)]
    assert all("from_json" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (players, teams))


def test_nested_groups_are_reduced_within_their_fixture(spark):
    """Nothing is dealt out by player or team: what is written is read once a group. A fixture in two payloads is put together first."""
    from statloom.plans import upkeep

    d = "/root/testdata/sf0.001"
    for made in (upkeep.boxscore_nested_players(spark, d), upkeep.boxscore_nested_teams(spark, d)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    own = lambda player, goals: {"player_id": player, "team_id": 4, "details": [{"type": {"code": "goals"}, "data": {"value": goals}}]}
    parts = [{"data": {"id": 3, "lineups": [own(9, 2)], "scores": [{"participant_id": 4, "score": {"goals": 1}}]}}, {"data": {"id": 3, "lineups": [own(10, 5)], "events": [{"player_id": 9, "type_id": 14}], "scores": [{"participant_id": 4, "score": {"goals": 3}}]}}]
    players, teams, scores = (sorted(map(tuple, t.collect())) for t in boxscore.nested_rows(frame(spark, *parts)))
    assert players == [(3, 9, 4, "goals", 3.0), (3, 10, 4, "goals", 5.0)] and teams == [(3, 4, "goals", 8.0)] and scores == [(3, 4, 3)]
