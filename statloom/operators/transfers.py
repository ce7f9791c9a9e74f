"""Who could move to or from a team: pairs that articles name together, where the person stands to the team, and which way a move would go.

Standing is read from a history of memberships as of the pair's newest article: a current member can only leave;
a former one is noise unless an article speaks of a return; others would arrive.

Defined results: pairs below the least number of articles are no candidates; of each team the hottest stay, ties going
to more articles and then the smaller person; null titles say nothing; a person without history is of no team.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import ranked_first

MOST = 40  # candidates of a team

# Phrases of a return, lower case.
RETURN_PHRASES = (
    "return to", "returning to", "rejoin", "re-sign", "resign for", "back to", "back at", "comeback", "second spell", "reunite", "bring back", "brings back",
    "volver a", "regresar a", "vuelve a", "regresa a",
    "retour a", "retour à", "retour au", "revient a", "revient à", "rejoindre",
    "ruckkehr zu", "rückkehr zu", "kehrt zuruck", "kehrt zurück", "zuruck zu", "zurück zu",
    "ritorno a", "torna a", "tornare a",
    "regresso ao", "retorno ao", "volta ao", "voltar ao",
    "terugkeer naar", "keert terug", "terug naar",
)


def speaks_of_return(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*(F.lit(p) for p in RETURN_PHRASES)), lambda p: low.contains(p))


def memberships(seen: DataFrame) -> DataFrame:
    """seen: person, team, at, tie -> person, team, since, until: a person is with a team until seen with the next one; equal times and ties go by team."""
    w = Window.partitionBy("person").orderBy("at", "tie", "team")
    moves = seen.withColumn("before", F.lag("team").over(w)).where(~F.col("before").eqNullSafe(F.col("team")))
    return moves.select("person", "team", F.col("at").alias("since"), F.lead("at").over(w).alias("until"))


def candidates(mentions: DataFrame, least: int, most: int = MOST) -> DataFrame:
    """mentions: team, person, article, at, heat, title -> each team's hottest persons, with articles, newest, heat, returning."""
    pairs = mentions.groupBy("team", "person").agg(F.countDistinct("article").alias("articles"), F.max("at").alias("newest"), F.max("heat").alias("heat"), F.bool_or(speaks_of_return(F.col("title"))).alias("returning"))
    return ranked_first(pairs.where(F.col("articles") >= least), ["team"], [F.desc_nulls_last("heat"), F.desc("articles"), F.asc("person")], most)


def standing(found: DataFrame, history: DataFrame) -> DataFrame:
    """found with relationship, direction and kept, by history as of each pair's newest article."""
    p = found.select("team", "person", "newest")
    then = (F.col("since") <= F.col("newest")) & (F.col("until").isNull() | (F.col("newest") < F.col("until")))
    known = p.join(history, ["team", "person"]).where(F.col("since") <= F.col("newest")).groupBy("team", "person").agg(F.bool_or(then).alias("current"))
    relationship = F.when(F.col("current"), "current").when(F.col("current").isNotNull(), "former").otherwise("none")
    out = found.join(known, ["team", "person"], "left").withColumn("relationship", relationship).drop("current")
    return out.withColumn("direction", F.when(F.col("relationship") == "current", "outgoing").otherwise("incoming")).withColumn("kept", (F.col("relationship") != "former") | F.col("returning"))
