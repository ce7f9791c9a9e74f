"""Every registered query of the engine itself, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import boards, forms, lookups, movement, packets, pages, ratings, recompute, replays, season, sports, stories, streams, teams, texts, upkeep

MODULES = [season, sports, movement, texts, boards, streams, upkeep, pages, forms, replays, recompute, lookups, teams, ratings, packets, stories]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _alone(q) for m in MODULES for name, q in m.QUERIES.items()}


def _alone(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        season.forget()
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
