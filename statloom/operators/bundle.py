"""Ratings of entities: one row each, in every mode, with ranks and scores in several scopes and a breakdown by datapoint.

A datapoint's z is measured against the eligible of its population (sport, season, mode, label); a rating is the sum of
signed z over the datapoints that count. Percentiles of datapoints and ratings come from ``cohort.percent_ranks``, so a
cohort of any size is ranked without one task holding it; means and deviations are grouped aggregates.

Defined results: without deviation z is 0, a missing value's z too; labels that no eligible entity has are left out;
entities without a datapoint that counts have no row; those that aren't eligible have a breakdown, in which the
percentile is 50 + 10 z (1 to 99), but neither rating nor ranks; a null scope column takes no part in that scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import key_of, rounded, t_score
from ..session import written
from .cohort import percent_ranks, scoped

WHOLE = "all"  # the scope of everyone


def meets(bag: Column, sport: Column, thresholds: dict[str, dict[str, float]]) -> Column:
    """Whether a bag reaches every threshold of its sport; a missing stat counts zero, a sport without thresholds has nobody eligible."""
    own = F.lit(None).cast("boolean")
    for name, least in thresholds.items():
        met = F.lit(True)
        for stat, x in least.items():
            met = met & (F.coalesce(bag[stat], F.lit(0.0)) >= x)
        own = F.when(sport == name, met).otherwise(own)
    return F.coalesce(own, F.lit(False))


def signed(points: DataFrame, population: list[str]) -> DataFrame:
    """points with z: how far a value is on the good side of the eligible's mean, in their deviations. points are read twice; a population has one row beside them."""
    measured = points.where("eligible").groupBy(*population).agg(F.avg("value").alias("_mean"), F.nullif(F.stddev_pop("value"), F.lit(0.0)).alias("_deviation"))
    z = F.col("sign") * F.coalesce((F.col("value") - F.col("_mean")) / F.col("_deviation"), F.lit(0.0))
    return points.join(F.broadcast(written(measured, "measured")), population).select(*points.columns, z.alias("z"))


def rate(points: DataFrame, entity: list[str], population: list[str], scopes: list[str], facets: tuple[str, ...]) -> DataFrame:
    """points: entity, population, scopes (columns of text: the cohort, null for none), label, value, in_comp, in_spec, sign, facet, eligible.

    -> entity, population, eligible, composite, faceted (the sum of the facets' means), standout (the specialist datapoint
    with the largest signed z: z, label), breakdown (list by label, with percentiles by scope), rank, score, scoped_ranks,
    scoped_scores (maps by scope). An entity's datapoints, of which the registry bounds the number, are dealt out by entity once;
    rows that are repeated for every scope and ranked hold no more than is ranked.
    """
    own = [*entity, *population]
    z = signed(written(points, "points"), [*population, "label"])
    cuts = {WHOLE: F.lit(WHOLE), **{s: F.col(s) for s in scopes}}
    key = F.struct(*own).alias("_own")  # one that is never null, so that both sides of the join are dealt out by it
    narrow = z.where("eligible").select(*own, "label", *scopes, key_of(F.col("z")).alias("_k"))
    ranked = percent_ranks(scoped(narrow, cuts).drop(*scopes), [*population, "label", "scope", "cohort"], F.col("_k"), "_rank")
    ranked = ranked.select(key, "scope", F.struct("label", rounded(100 * F.col("_rank"), 1).alias("pct")).alias("_cut"))
    by_label = lambda n: F.map_from_entries(F.collect_list(F.when(F.col("scope") == n, F.col("_cut"))))
    placed = ranked.repartition("_own").groupBy("_own").agg(*(by_label(n).alias(f"_pct_{n}") for n in cuts))
    entry = F.struct("label", "value", "z", "in_comp", "in_spec", "sign", "facet")
    got = (
        z.select("*", key)
        .repartition("_own")
        .groupBy("_own", *scopes, "eligible")
        .agg(
            rounded(F.sum(F.when(F.col("in_comp"), F.col("z"))), 4).alias("composite"),
            rounded(sum((F.coalesce(F.avg(F.when(F.col("in_comp") & (F.col("facet") == f), F.col("z"))), F.lit(0.0)) for f in facets), F.lit(0.0)), 4).alias("faceted"),
            F.max(F.when(F.col("in_spec"), F.struct(rounded("z", 4).alias("z"), "label"))).alias("standout"),
            F.array_sort(F.collect_list(entry)).alias("_whole"),
        )
        .where("composite is not null")
        .join(placed, "_own", "left")
        .select("_own.*", *scopes, "eligible", "composite", "faceted", "standout", "_whole", *(f"_pct_{n}" for n in cuts))
    )
    of = lambda e: F.map_filter(F.create_map(*(x for n in scopes for x in (F.lit(n), F.col(f"_pct_{n}")[e.label]))), lambda _, v: v.isNotNull()) if scopes else F.create_map().cast("map<string,double>")
    pct = lambda e: F.when(F.col("eligible"), F.col(f"_pct_{WHOLE}")[e.label]).otherwise(rounded(F.least(F.greatest(50 + 10 * e.z, F.lit(1.0)), F.lit(99.0)), 1))
    names = ("in_comp", "in_spec", "sign", "facet")
    breakdown = F.transform("_whole", lambda e: F.struct(e.label.alias("label"), e.value.alias("value"), pct(e).alias("pct"), *(e[n].alias(n) for n in names), (e.sign * e.z).alias("z"), of(e).alias("scoped_pct")))
    base = written(got.withColumn("breakdown", breakdown).drop("_whole", *(f"_pct_{n}" for n in cuts)), "rated")

    keyed = scoped(base.where("eligible").select(*own, *scopes, "composite"), cuts).drop(*scopes)
    cohort, whole = [*population, "scope", "cohort"], F.col("scope") == WHOLE
    spread = keyed.groupBy(*cohort).agg(F.avg("composite").alias("_mean"), F.stddev_pop("composite").alias("_deviation"))
    placed = percent_ranks(keyed, cohort, key_of(F.col("composite")), "_rank").join(spread, cohort)
    rank, score = rounded(100 * F.col("_rank"), 1), t_score(F.col("composite"), F.col("_mean"), F.col("_deviation"))
    by_scope = lambda c: F.map_filter(F.map_from_entries(F.collect_list(F.when(~whole, F.struct("scope", c.alias("v"))))), lambda _, v: v.isNotNull())
    ranks = placed.groupBy(*own).agg(F.max(F.when(whole, rank)).alias("rank"), F.max(F.when(whole, score)).alias("score"), by_scope(rank).alias("scoped_ranks"), by_scope(score).alias("scoped_scores"))
    joined = base.drop(*scopes).alias("b").join(ranks.alias("r"), [F.col(f"b.{c}").eqNullSafe(F.col(f"r.{c}")) for c in own], "left")
    kept = [c for c in base.columns if c not in scopes and c != "composite"]
    return joined.select(*(f"b.{c}" for c in kept), F.when(F.col("eligible"), F.col("composite")).alias("composite"), "rank", "score", "scoped_ranks", "scoped_scores")


def by_mode(rated: DataFrame, entity: list[str], first: str) -> DataFrame:
    """rated (entity, mode and more) -> one row an entity: the columns of the first mode, and modes, a map of the others' rows by mode."""
    more = [c for c in rated.columns if c not in (*entity, "mode")]
    main = F.first(F.when(F.col("mode") == first, F.struct(*more)), ignorenulls=True)
    others = F.map_from_entries(F.collect_list(F.when(F.col("mode") != first, F.struct("mode", F.struct(*more)))))
    return rated.groupBy(*entity).agg(main.alias("_main"), others.alias("modes")).select(*entity, "_main.*", "modes")
