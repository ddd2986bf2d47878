"""Running aggregates over an ordered log in two levels, so that one long instance is no single task.

The log of an instance is cut into blocks of sequence numbers. Values run within each block, the blocks' totals run over
the instance, and each row adds what came before its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
_BOTH = {
    "sum": (F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "min": (F.min, lambda before, own: F.least(before, own)),
    "max": (F.max, lambda before, own: F.greatest(before, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def running(log: DataFrame, inst: str, seq: str, block: int = BLOCK, exclusive: tuple[str, ...] = (), **values: tuple[str, Column]) -> DataFrame:
    """log with a column for each of values: (sum, min, max or last non-null; expression) up to the row, or before it if named in exclusive.

    seq is unique within inst.
    """
    rows = log.withColumn("__blk", F.floor(F.col(seq) / block).cast("long")).withColumns({f"__in_{k}": c for k, (_, c) in values.items()})
    w = Window.partitionBy(inst, "__blk").orderBy(seq)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"__own_{k}": _BOTH[kind][0](F.col(f"__in_{k}")).over(before if k in exclusive else upto) for k, (kind, _) in values.items()})
    first = [F.max_by(F.col(f"__in_{k}"), F.when(F.col(f"__in_{k}").isNotNull(), F.col(seq))).alias(f"__sum_{k}") if kind == "last" else _BOTH[kind][0](F.col(f"__in_{k}")).alias(f"__sum_{k}") for k, (kind, _) in values.items()]
    blocks = rows.groupBy(F.col(inst).alias("__i"), F.col("__blk").alias("__b")).agg(*first)
    over = Window.partitionBy("__i").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__i", "__b", *[_BOTH[kind][0](F.col(f"__sum_{k}")).over(over).alias(f"__pre_{k}") for k, (kind, _) in values.items()])
    joined = own.join(blocks, own[inst].eqNullSafe(blocks["__i"]) & own["__blk"].eqNullSafe(blocks["__b"]))
    out = {k: _BOTH[kind][1](F.col(f"__pre_{k}"), F.col(f"__own_{k}")) for k, (kind, _) in values.items()}
    return joined.withColumns(out).select(*log.columns, *values)


def happened(log: DataFrame, inst: str, seq: str, block: int = BLOCK, **ops: str) -> DataFrame:
    """log with a boolean column for each of ops: whether a row with that op (a dropped side, say) is there up to the row."""
    rows = running(log, inst, seq, block, (), **{f"__h_{k}": ("min", F.when(F.col("op") == name, F.col(seq))) for k, name in ops.items()})
    return rows.select(*log.columns, *[F.col(f"__h_{k}").isNotNull().alias(k) for k in ops])
