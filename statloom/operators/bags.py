"""Stat bags: sparse maps from a measure's name to its value. A missing key and a zero are different."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_bag(**measures: Column) -> Column:
    """A bag of the measures that aren't null."""
    full = F.create_map(*(x for name, c in measures.items() for x in (F.lit(name), c.cast("double"))))
    return F.map_filter(full, lambda _, v: v.isNotNull())


def explode_bag(df: DataFrame, bag: str, key: str = "stat", value: str = "value") -> DataFrame:
    return df.select(*(c for c in df.columns if c != bag), F.explode(bag).alias(key, value))


def merge_bags(left: Column, right: Column) -> Column:
    """The right side wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def collect_bag(df: DataFrame, keys: list[str], key: str = "stat", value: str = "value") -> DataFrame:
    """One bag for each of keys. key must be unique within them."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("bag"))


def numeric_bag(json: Column) -> Column:
    """The numeric members of a JSON object; others are left out, digits in quotes too."""
    members = F.try_parse_json(json).try_cast("map<string,variant>")
    numbers = F.map_filter(members, lambda _, v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    return F.transform_values(numbers, lambda _, v: F.try_variant_get(v, "$", "double"))
