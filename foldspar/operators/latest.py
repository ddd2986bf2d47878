"""Latest-value semantics: conflation slots, keyed last-write-wins, upserts with the old value.

A log has columns inst, seq (unique within inst), op and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspar.operators.running import running


def slot_log(log: DataFrame, block: int = 65_536) -> DataFrame:
    """The outcome of every row of a slot's log with ops write, read, peek, drop_writer and drop_reader.

    fresh tells whether a write happened since the last read, which is what a peek sees; a read delivers the latest value
    then, once, even after the writer is gone. writer_gone and reader_gone tell what dropped before or at the row.
    """
    op = F.col("op")
    when = lambda name: F.when(op == name, F.col("seq"))
    rows = running(
        log, "inst", "seq", block, ("__read",),
        __write=("max", when("write")), __read=("max", when("read")), __value=("last", F.when(op == "write", F.struct("value"))),
        __no_writer=("max", when("drop_writer")), __no_reader=("max", when("drop_reader")),
    )
    fresh = F.coalesce(F.col("__write") > F.coalesce(F.col("__read"), F.lit(-(2**63))), F.lit(False))
    return rows.select(
        *log.columns, fresh.alias("fresh"), F.when(fresh & (op == "read"), F.col("__value.value")).alias("delivered"),
        F.col("__no_writer").isNotNull().alias("writer_gone"), F.col("__no_reader").isNotNull().alias("reader_gone"),
    )


def latest(log: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The row with the greatest seq of each key (a keyed store where the last write wins); aggregated where the rows lie."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def upserts(log: DataFrame) -> DataFrame:
    """log (columns inst, key, seq, op, value) with old, the key's value before the row; an op remove leaves null."""
    w = Window.partitionBy("inst", "key").orderBy("seq")
    return log.withColumn("old", F.lag(F.when(F.col("op") != "remove", F.col("value"))).over(w))
