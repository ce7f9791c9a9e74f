"""Rules of single sports, on hand-made frames."""

from pyspark.sql import functions as F

from statloom.operators import datapoints as dp
from statloom.plans import sports


def test_position_groups(spark):
    given = [("NBA", "Guard"), ("NFL", "QB"), ("nfl", "Fullback"), ("NFL", "Tight End"), ("NFL", "Kicker"), ("FOOTBALL", "Goalkeeper"), ("FOOTBALL", None), ("X", "QB")]
    got = spark.createDataFrame(given, "s string, p string").select(dp.position_group(F.col("s"), F.col("p")).alias("g")).collect()
    assert [r.g for r in got] == ["ALL", "quarterback", "running-back", "receiver", None, "goalkeeper", None, None]


def _points(spark, sport, position, bag, rated):
    df = spark.createDataFrame([(1, sport, position, bag)], "id int, sport string, position string, bag map<string,double>")
    return {r.label: r for r in dp.datapoints(df, dp.registry(spark, dp.PLAYER), rated).collect()}


def test_rates_fall_back_to_totals(spark):
    bag = {"pts": 100.0, "pts_per_36": 20.0, "blk": 7.0, "turnover": 9.0, "tov_per_36": 2.0, "plus_minus": 5.0, "plus_minus_per_36": 1.0}
    got = _points(spark, "NBA", None, bag, True)
    assert (got["Scoring"].value, got["Rim Protection"].value, got["Ball Security"].value, got["On-Court Impact"].value) == (20.0, 7.0, 2.0, 5.0)
    assert got["Rebounding"].value is None and got["Ball Security"].sign == -1
    assert _points(spark, "NBA", None, bag, False)["Scoring"].value == 100.0


def test_goalkeepers_apart(spark):
    bag = {"saves": 30.0, "goals_conceded": 10.0, "league_avg_save_pct": 70.0, "tackles": 8.0, "team_opp_possession": 20.0}
    keeper, other = _points(spark, "FOOTBALL", "Goalkeeper", bag, False), _points(spark, "FOOTBALL", None, bag, False)
    assert set(keeper) == {"Shot-Stopping", "Goals Prevented", "Distribution", "Long-Ball Accuracy"}
    assert keeper["Goals Prevented"].value == 2.0
    assert other["Tackling"].value == 13.33 and "Shot-Stopping" not in other  # the opponents' share counts 30 at least


def test_sums_of_missing_stats(spark):
    got = _points(spark, "NFL", "QB", {"passing_touchdowns": 2.0, "field_goals_made": 1.0, "defensive_sacks": 3.0}, False)
    assert got["Points Responsible For"].value == 15.0 and got["Giveaways"].value == 0.0 and got["Tackles For Loss"].value == 3.0
    assert got["Tackling"].value is None


def test_season_rules(spark):
    box = lambda *rows: spark.createDataFrame([(1, 2000, *r) for r in rows], "player int, season int, minutes double, bag map<string,double>")
    nba = sports.season_bags(box((10.0, {"pts": 4.0, "fgm": 1.0, "fga": 2.0}), (20.0, {"pts": 7.0, "fga": 1.0}), (0.0, {"pts": 50.0})), "NBA").first().bag
    assert (nba["games_played"], nba["minutes"], nba["pts"], nba["fg_pct"]) == (2.0, 15.0, 5.5, 33.3) and "reb" not in nba and "ft_pct" not in nba
    nfl = sports.season_bags(box((0.0, {"passing_yards": 5.0, "long_pass": 3.0}), (9.0, {"long_pass": 40.0}), (9.0, {"fumbles": 1.0})), "NFL").first().bag
    assert (nfl["games_played"], nfl["long_pass"], nfl["passing_yards_per_game"]) == (2.0, 3.0, 2.5) and "long_rushing" not in nfl and nfl["total_tackles"] == 0.0
    football = sports.season_bags(box((90.0, {"own_goals": 0.0, "penalties_won": 2.0})), "FOOTBALL").first().bag
    assert football["goals"] == 0.0 and football["penalties_won"] == 2.0 and "own_goals" not in football


def test_only_numbers_of_json(spark):
    from statloom.operators import bags

    given = [('{"a": 5, "b": "5", "c": 1.5, "d": null, "e": [1]}',), ("[1]",), ("no json",), (None,)]
    got = spark.createDataFrame(given, "j string").select(bags.numeric_bag(F.col("j")).alias("b")).collect()
    assert [r.b for r in got] == [{"a": 5.0, "c": 1.5}, None, None, None]


def test_relevance_of_pages(spark):
    from statloom.functions import relevance

    ours, role, named = ["Paris (FC)"], lambda e, r: [(e, r)], lambda n, d: [(n, d)]
    given = [
        ("article", role("paris", "subject"), ours, [], True),
        ("SCORE_TABLE", role("paris", "subject"), ours, [], False),
        ("article", [], ours, [], True),
        ("article", role("paris", "subject"), ours, named("Paris", "capital city"), False),
        ("article", role("paris", "subject"), ours, named("Paris", "club from the capital city"), True),
        ("article", role("Paris", "passing_mention"), ours, named("Paris Mining Corp", "a mine"), False),
        ("article", role("Oslo", "subject"), ours, named("Paris", "visitors"), True),
        ("article", role("Oslo", "subject"), ours, named("Paris", "a town"), False),
        ("article", role("Paris", "absent"), ours, named("Paris", None), False),
    ]
    df = spark.createDataFrame(given, "kind string, roles array<struct<entity:string,role:string>>, ours array<string>, names array<struct<name:string,descriptor:string>>, want boolean")
    got = df.select("want", relevance.relevant(F.col("kind"), F.col("roles"), F.col("ours"), F.col("names")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
