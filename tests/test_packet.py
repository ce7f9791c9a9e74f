"""Packets of stories on hand-made articles."""

from statloom.operators import packet

ARTICLES = "packet string, article long, source string, title string, feed_rank int, published long, body string, story_type string, register string, phrase string, facts array<string>, result_line string"


def _packets(spark, articles, cast=(), mentions=()):
    got = packet.compiled(
        spark.createDataFrame(articles, ARTICLES),
        spark.createDataFrame(list(cast), "packet string, entity_type string, entity int, role string, name string"),
        spark.createDataFrame(list(mentions), "packet string, article long, i int, name string, kind string, descriptor string"),
    )
    return {r.packet: r for r in got.collect()}


def _article(n, facts=(), title="T", rank=None, published=None, body=None, kind="general", register="neutral", phrase=None, line=None, story="p"):
    return story, n, f"s{n}", title, rank, n if published is None else published, body, kind, register, phrase, list(facts), line


def test_claims_belong_to_who_said_them_first(spark):
    got = _packets(spark, [_article(1, ["a", " b "]), _article(2, ["b", "B", "c", "c", " "]), _article(3, ["a"])])["p"]
    assert [(c.fact, c.article) for c in got.claims] == [("c", 2), ("B", 2), ("b", 1), ("a", 1)] and got.dropped == []


def test_more_claims_than_a_packet_holds_are_named(spark):
    got = _packets(spark, [_article(n, [f"{n}.{i}" for i in range(30)]) for n in range(8)])["p"]
    assert len(got.claims) == packet.MOST_CLAIMS and got.claims[0].fact == "7.29" and got.dropped == [1] * 10 + [0] * 30


def test_only_the_newest_articles_count(spark):
    got = _packets(spark, [_article(n, [f"f{n}"], register="joy" if n < 50 else "neutral") for n in range(230)] + [_article(999, ["old"], published=-1)])["p"]
    assert got.members == packet.MOST_MEMBERS and got.claims[-1].fact == "f30" and got.register == "joy"


def test_headline_topics_register_and_tags(spark):
    rows = [
        _article(1, title="best", rank=1, kind=" Suspension", register="grief", phrase="long ago"),
        _article(2, title="also best", rank=1, kind="transfer", register="JOY", phrase=" "),
        _article(3, title=" ", rank=0, kind="transfer", register="grief", phrase="so sad", line="A 2-1 B"),
        _article(4, title="unranked", kind="odd", register="joy", phrase="hurray"),
    ]
    got = _packets(spark, rows)["p"]
    assert (got.headline, got.story_types, got.register, got.phrase, got.result_line) == ("also best", ["transfer", "odd", "suspension"], "joy", "hurray", "A 2-1 B")
    assert got.tags == ["charged", "injury", "suspension", "transfer"]


def test_slices_move_only_with_what_they_read(spark):
    base = [_article(1, ["x"], kind="transfer"), _article(2, ["y"])]
    one, more = _packets(spark, base)["p"].fingerprints, _packets(spark, [*base, _article(3, ["z"])])["p"].fingerprints
    assert one["transfers"] == more["transfers"] and one["narratives"] != more["narratives"] and len(one["vibe"]) == 32


def test_quotes_and_unresolved(spark):
    rows = [_article(n, body="x" * 400 + " Ann met BOB " + "y" * 400) for n in range(8)] + [_article(9, body=None), _article(10, body="nobody")]
    cast = [("p", "player", 2, "opponent", "Bob"), ("p", "player", 1, "passing_mention", "Ann"), ("p", "player", 3, "subject", " ")]
    names = [("p", 7, 0, "Old ", "k", " "), ("p", 6, 0, "old", "j", "who"), ("p", 5, 0, "New", "k", None), ("p", 5, 1, "", "k", "d"), ("p", 77, 0, "gone", "k", "d")]
    got = _packets(spark, rows, cast, names)["p"]
    assert [q.article for q in got.quotes] == [7, 6, 5, 4, 3, 2] and {q.entity for q in got.quotes} == {2}
    assert len(got.quotes[0].quote) == 160 + 3 + 160 and "BOB" in got.quotes[0].quote
    assert [(u["name"], u.kind, u.descriptor, u.mentions) for u in got.unresolved] == [("Old ", "k", "who", 2), ("New", "k", "", 1)]


def test_bare_and_empty(spark):
    bare = _packets(spark, [("p", 1, None, None, None, None, None, None, None, None, None, None)])["p"]
    assert (bare.members, bare.headline, bare.claims, bare.quotes, bare.unresolved, bare.tags) == (1, None, None, None, None, [])
    assert _packets(spark, []) == {}
