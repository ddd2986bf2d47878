"""Keyed stores: lookups, membership, removal, get-or-insert, in-place change. A store has one row for each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(store: DataFrame, probes: DataFrame, key: str, value: str) -> DataFrame:
    """probes with value, null where the store lacks the key."""
    return probes.join(store.select(key, value), key, "left")


def index(store: DataFrame, probes: DataFrame, key: str, value: str) -> DataFrame:
    """Like get, but a missing key stops the job."""
    found = get(store.withColumn("__hit", F.lit(True)).select(key, F.struct(value, "__hit").alias("__v")), probes, key, "__v")
    miss = F.raise_error(F.concat(F.lit("invalid key "), F.col(key).cast("string")))
    return found.withColumn(value, F.when(F.col("__v").isNotNull(), F.col(f"__v.{value}")).otherwise(miss.cast(store.schema[value].dataType))).drop("__v")


def contains(store: DataFrame, probes: DataFrame, key: str, name: str = "found") -> DataFrame:
    """probes with a boolean column."""
    keys = store.select(F.col(key).alias("__k")).withColumn("__hit", F.lit(True))
    return probes.join(keys, probes[key] == keys["__k"], "left").withColumn(name, F.col("__hit").isNotNull()).drop("__k", "__hit")


def only(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key), key, "left_semi")


def remove(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The store without the keys; only() has the removed rows."""
    return store.join(keys.select(key), key, "left_anti")


def replace(store: DataFrame, news: DataFrame, key: str, value: str) -> DataFrame:
    """The store with new values where news (one row a key) has its key, and old_value, the one that went."""
    fresh = news.select(F.col(key).alias("__k"), F.struct(value).alias("__v"))
    rows = store.join(fresh, store[key] == fresh["__k"], "left")
    hit = F.col("__v").isNotNull()
    return rows.select(*[store[c] for c in store.columns if c != value], F.when(hit, F.col(f"__v.{value}")).otherwise(store[value]).alias(value), F.when(hit, store[value]).alias("old_value"))


def or_insert(store: DataFrame, news: DataFrame, key: str, value: str) -> DataFrame:
    """key, value and inserted for every key of either; a key of both keeps the store's value."""
    a, b = store.select(key, F.struct(value).alias("__a")), news.select(key, F.struct(value).alias("__b"))
    rows = a.join(b, key, "full")
    return rows.select(key, F.coalesce("__a", "__b")[value].alias(value), F.col("__a").isNull().alias("inserted"))


def or_default(store: DataFrame, keys: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Like or_insert, with the same default for every new key."""
    return or_insert(store, keys.select(key).distinct().withColumn(value, default.cast(store.schema[value].dataType)), key, value)


def modify(store: DataFrame, keys: DataFrame, key: str, value: str, change: Callable[[Column], Column]) -> DataFrame:
    """The store with change(value) where keys has the key."""
    return contains(store=keys.select(key).distinct(), probes=store, key=key, name="__hit2").withColumn(value, F.when(F.col("__hit2"), change(F.col(value))).otherwise(F.col(value))).drop("__hit2")


def size(store: DataFrame, *by: str) -> DataFrame:
    return store.groupBy(*by).agg(F.count(F.lit(1)).alias("len"))
