"""Ordered structures as relations: lists (by position), min-heaps (by value, then key), sorted maps (by key).

Each function takes the columns that name the instance and the order. What order alone decides is a window within the
instance; first, last and top-k are aggregations, combined where the rows lie, so no instance is gathered for them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspar.operators.running import running


def _by(inst: Sequence[str], order: Sequence[str], backward: bool = False):
    return Window.partitionBy(*inst).orderBy(*[F.desc(c) if backward else F.asc(c) for c in order])


def placed(df: DataFrame, inst: Sequence[str], order: Sequence[str], name: str = "place", backward: bool = False) -> DataFrame:
    """df with each row's place, from 1: an ordered scan or drain, forward or backward."""
    return df.withColumn(name, F.row_number().over(_by(inst, order, backward)))


def ends(df: DataFrame, inst: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """first_x and last_x of each of values, and len, for each instance."""
    o = F.struct(*order)
    return df.groupBy(*inst).agg(F.count(F.lit(1)).alias("len"), *[f(F.col(v), o).alias(f"{name}_{v}") for v in values for name, f in (("first", F.min_by), ("last", F.max_by))])


def neighbours(df: DataFrame, inst: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """df with prev_key, next_key, is_head and is_tail: what a cursor at the row sees."""
    w = _by(inst, order)
    return df.withColumns({"prev_key": F.lag(key).over(w), "next_key": F.lead(key).over(w), "is_head": F.lag(F.lit(1)).over(w).isNull(), "is_tail": F.lead(F.lit(1)).over(w).isNull()})


def lowest(df: DataFrame, inst: Sequence[str], order: Sequence[str], k: int, backward: bool = False) -> DataFrame:
    """The first k rows (last, backward) of each instance, as k pops would give them; the rest is popped()'s."""
    return placed(df, inst, order, "place", backward).where(F.col("place") <= k)


def change_end(df: DataFrame, inst: Sequence[str], order: Sequence[str], value: str, change: Callable[[Column], Column], backward: bool = False) -> DataFrame:
    """df with change(value) in the first (last, backward) row of each instance."""
    rows = placed(df, inst, order, "__p", backward)
    return rows.withColumn(value, F.when(F.col("__p") == 1, change(F.col(value))).otherwise(F.col(value))).drop("__p")


def popped(df: DataFrame, inst: Sequence[str], order: Sequence[str], k: int, backward: bool = False) -> DataFrame:
    """What k pops leave of each instance."""
    return placed(df, inst, order, "__p", backward).where(F.col("__p") > k).drop("__p")


def drain_while(df: DataFrame, inst: Sequence[str], order: Sequence[str], holds: Column) -> DataFrame:
    """df with drained: whether holds is true for the row and all before it."""
    w = _by(inst, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("drained", F.min(F.coalesce(holds, F.lit(False)).cast("int")).over(w) == 1)


def drain_upto(df: DataFrame, value: str, most: Column) -> DataFrame:
    """The drained rows if the predicate is value <= most: a filter, which reaches the scan."""
    return df.where(F.col(value) <= most)


def fill(df: DataFrame, inst: str, seq: str, quantity: str, incoming: Column, block: int = 65_536) -> DataFrame:
    """Sweep an incoming quantity over resting ones in order: df with filled and left of each row."""
    rows = running(df, inst, seq, block, ("__before",), __before=("sum", F.col(quantity)))
    filled = F.greatest(F.lit(0), F.least(F.col(quantity), incoming - F.col("__before")))
    return rows.withColumn("filled", filled).withColumn("left", F.col(quantity) - F.col("filled")).drop("__before")


def split_off(df: DataFrame, inst: Sequence[str], order: str, key: str, at: DataFrame) -> DataFrame:
    """df with side: head before the key that at (a row for each instance) names, tail from it on; null where the instance lacks it."""
    places = df.join(at, [*inst, key], "left_semi").select(*inst, F.col(order).alias("__at"))
    rows = df.join(places, [*inst], "left")
    return rows.withColumn("side", F.when(F.col(order) < F.col("__at"), "head").when(F.col(order) >= F.col("__at"), "tail")).drop("__at")


def append(a: DataFrame, b: DataFrame, inst: Sequence[str], position: str) -> DataFrame:
    """Each instance's rows of b after those of a; b is empty then."""
    last = a.groupBy(*inst).agg(F.max(position).alias("__last"))
    first = b.groupBy(*inst).agg(F.min(position).alias("__first"))
    moved = b.join(first, [*inst]).join(last, [*inst], "left")
    moved = moved.withColumn(position, F.when(F.col("__last").isNull(), F.col(position)).otherwise(F.col("__last") + 1 + F.col(position) - F.col("__first"))).drop("__last", "__first")
    return a.unionByName(moved.select(*a.columns))


def recency(touches: DataFrame, inst: Sequence[str], key: str, seq: str) -> DataFrame:
    """Order of a list whose touched keys move to the back: place of each key by its last touch."""
    last = touches.groupBy(*inst, key).agg(F.max(seq).alias("last_seq"))
    return placed(last, inst, ["last_seq"])


def lower_bound(entries: DataFrame, probes: DataFrame, inst: str, key: str, value: str, probe: str) -> DataFrame:
    """For each probe the entry at it, or else the first one after it: probes with found_key and found_value, or nulls.

    Entries and probes are put in one order and the next entry is carried back to the probes; nothing is compared with
    everything. The order runs in blocks of keys, backward, so an instance may be of any size.
    """
    width = 65_536
    p = probes.select(F.col(inst).alias("__i"), F.col(probe).alias("__k"), F.struct(*probes.columns).alias("__p"), F.lit(None).cast(f"struct<k:{entries.schema[key].dataType.simpleString()},v:{entries.schema[value].dataType.simpleString()}>").alias("__e"))
    e = entries.select(F.col(inst).alias("__i"), F.col(key).alias("__k"), F.lit(None).cast(p.schema["__p"].dataType).alias("__p"), F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("__e"))
    rows = e.unionByName(p).withColumn("__b", F.floor(F.col("__k") / width))
    w = Window.partitionBy("__i", "__b").orderBy(F.desc("__k"), F.col("__p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("__near", F.last("__e", ignorenulls=True).over(w)).where("__p is not null")
    blocks = rows.groupBy(F.col("__i").alias("__bi"), F.col("__b").alias("__bb")).agg(F.min("__e").alias("__first"))
    after = Window.partitionBy("__bi").orderBy(F.desc("__bb")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__next", F.last("__first", ignorenulls=True).over(after)).drop("__first")
    near = near.join(blocks, near["__i"].eqNullSafe(blocks["__bi"]) & near["__b"].eqNullSafe(blocks["__bb"]))
    found = F.coalesce("__near", "__next")
    return near.select("__p.*", found["k"].alias("found_key"), found["v"].alias("found_value"))
