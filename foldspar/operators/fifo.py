"""Unbounded FIFO semantics in closed form; bounded queues and channels are in the module bounded.

With +1 for a push and -1 for a pop, S their running sum and M the least of 0 and all S so far, S - M is the depth after
the row, a pop succeeds exactly if M does not fall, and the k-th successful pop takes the k-th push.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspar.functions.keys import rounded_capacity
from foldspar.operators.running import running


def depth(log: DataFrame, block: int = 65_536) -> DataFrame:
    """log (inst, seq, op push or pop) with depth after the row, ok, and n: the ordinal of the push or of the successful pop."""
    step = F.when(F.col("op") == "push", 1).when(F.col("op") == "pop", -1).otherwise(0).cast("long")
    rows = running(log, "inst", "seq", block, (), __s=("sum", step))
    rows = running(rows, "inst", "seq", block, ("__before",), __m=("min", F.col("__s")), __before=("min", F.col("__s")))
    m, before = (F.least(F.lit(0), F.coalesce(F.col(c), F.lit(0))) for c in ("__m", "__before"))
    rows = rows.withColumns({"depth": F.col("__s") - m, "ok": F.when(F.col("op") == "pop", m == before).otherwise(True)})
    one = lambda name: F.when((F.col("op") == name) & F.col("ok"), 1).otherwise(0).cast("long")
    rows = running(rows, "inst", "seq", block, (), __pushes=("sum", one("push")), __pops=("sum", one("pop")))
    n = F.when(F.col("op") == "push", F.col("__pushes")).when((F.col("op") == "pop") & F.col("ok"), F.col("__pops"))
    return rows.withColumn("n", n).select(*log.columns, "depth", "ok", "n")


def pairs(log: DataFrame, block: int = 65_536) -> DataFrame:
    """inst, n, push_seq, pop_seq and value of each successful pop with the push that it took."""
    rows = depth(log, block)
    pushed = rows.where("op = 'push'").select("inst", "n", F.col("seq").alias("push_seq"), "value")
    popped = rows.where("op = 'pop' and ok").select("inst", "n", F.col("seq").alias("pop_seq"))
    return pushed.join(popped, ["inst", "n"]).select("inst", "n", "push_seq", "pop_seq", "value")


def ring(n: Column, capacity: int) -> tuple[Column, Column]:
    """Slot and lap (from 1) of the n-th push (from 1) in a ring of the capacity, rounded up to a power of two."""
    size = rounded_capacity(capacity)
    at = n.cast("long") - 1
    return at.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(at, size.bit_length() - 1) + 1
