"""Bounded queues and channels in levels, so that one long instance is no single task.

A push or pop on a queue of capacity c maps its length x to min(c, max(0, x + d)). Such maps compose to maps of the same
shape, min(high, max(low, x + d)), so a block of any number of operations is three numbers. An instance's rows are cut by
rank into blocks, its blocks into blocks of blocks; the maps are composed upwards, and the lengths that each part starts
with come back down, each part being stepped through on its own, in native expressions. Which value a pop takes follows
from counting: the k-th successful pop takes the k-th admitted push.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspar.functions.keys import rounded_capacity
from foldspar.operators.running import running

BLOCK = 512
_FAR = 1 << 40  # beyond any length


def _held(x: Column, part: Column) -> Column:
    return F.greatest(part["low"], F.least(part["high"], x))


def _composed(parts: Column) -> Column:
    """The map (d, low, high) of the array's maps one after the other."""
    same = F.struct(F.lit(0).cast("long").alias("d"), F.lit(-_FAR).cast("long").alias("low"), F.lit(_FAR).cast("long").alias("high"))
    return F.aggregate(parts, same, lambda f, g: F.struct((f["d"] + g["d"]).alias("d"), _held(f["low"] + g["d"], g).alias("low"), _held(f["high"] + g["d"], g).alias("high")))


def _through(parts: Column, start: Column) -> Column:
    """Array of part, before and len: the lengths around each of the array's maps if the first one meets start."""
    none = F.array().cast("array<struct<before:bigint,len:bigint>>")
    after = lambda x, g: _held(x + g["d"], g)
    lengths = F.aggregate(
        parts,
        F.struct(start.cast("long").alias("x"), none.alias("out")),
        lambda a, g: F.struct(after(a["x"], g).alias("x"), F.concat(a["out"], F.array(F.struct(a["x"].alias("before"), after(a["x"], g).alias("len")))).alias("out")),
        lambda a: a["out"],
    )
    return F.zip_with(parts, lengths, lambda g, y: F.struct(g.alias("part"), y["before"].alias("before"), y["len"].alias("len")))


def _grouped(maps: DataFrame, block: int | None, *more: str) -> DataFrame:
    """inst, up and parts, the sorted maps of each block of places (of all places if block is None)."""
    up = F.lit(0).cast("long") if block is None else F.floor(F.col("at") / block).cast("long")
    return maps.groupBy("inst", up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "d", "low", "high", *more))).alias("parts"))


def _up(parts: DataFrame) -> DataFrame:
    return parts.select("inst", F.col("up").alias("at"), _composed(F.col("parts")).alias("f")).select("inst", "at", "f.d", "f.low", "f.high")


def _down(parts: DataFrame, starts: DataFrame) -> DataFrame:
    """A row for each part, with the lengths around it; starts holds the length before each block."""
    starts = starts.select(F.col("inst").alias("s_inst"), F.col("part.at").alias("s_up"), F.col("before").alias("start"))
    rows = parts.join(starts, parts["inst"].eqNullSafe(starts["s_inst"]) & (parts["up"] == starts["s_up"]))
    return rows.select("inst", F.explode(_through(F.col("parts"), F.col("start"))).alias("p")).select("inst", "p.*")


def _ranked(log: DataFrame, step: Column, capacity: int, block: int) -> list[DataFrame]:
    """The rows of log in blocks, with all columns in row; the blocks in blocks; and those of an instance together."""
    rows = running(log.withColumn("d", step.cast("long")), "inst", "seq", at=("sum", F.lit(1)))
    rows = rows.withColumns({"at": F.col("at") - 1, "low": F.lit(0).cast("long"), "high": F.lit(rounded_capacity(capacity)).cast("long"), "row": F.struct(*log.columns)})
    first = _grouped(rows, block, "row")
    second = _grouped(_up(first), block)
    return [first, second, _grouped(_up(second), None)]


def final_length(log: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """inst and the length that its queue ends with (ops push and pop; others do nothing)."""
    whole = _up(_ranked(log, _step("push", "pop"), capacity, block)[-1])
    return whole.select("inst", F.greatest("low", F.least("high", "d")).alias("len"))


def lengths(log: DataFrame, step: Column, capacity: int, block: int = BLOCK) -> DataFrame:
    """log (columns inst, seq and others) with before and len, the lengths around each row."""
    first, second, whole = _ranked(log, step, capacity, block)
    starts = whole.select("inst", F.explode(_through(F.col("parts"), F.lit(0))).alias("p")).select("inst", "p.*")
    return _down(first, _down(second, starts)).select("part.row.*", "before", "len")


def _step(push: str, pop: str) -> Column:
    return F.when(F.col("op") == push, 1).when(F.col("op") == pop, -1).otherwise(0)


def _outcomes(rows: DataFrame, push: str, pop: str) -> DataFrame:
    """Adds value to rows with status: what a rejected push gives back and a successful pop takes."""
    ok = F.col("status") == "ok"
    one = lambda name: F.when((F.col("op") == name) & ok, 1).otherwise(0).cast("long")
    rows = running(rows, "inst", "seq", __pushes=("sum", one(push)), __pops=("sum", one(pop)))
    pushed = rows.where((F.col("op") == push) & ok).select(F.col("inst").alias("p_inst"), F.col("__pushes").alias("n"), F.col("value").alias("taken"))
    rows = rows.withColumn("k", F.when((F.col("op") == pop) & ok, F.col("__pops")))
    rows = rows.join(pushed, (rows["inst"] == pushed["p_inst"]) & (rows["k"] == pushed["n"]), "left")
    value = F.when((F.col("op") == push) & ~ok, F.col("value")).when(F.col("op") == pop, F.col("taken"))
    return rows.select("inst", "seq", "op", "status", value.alias("value"), "len")


def queue(log: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """Ops push and pop (others do nothing): status ok, full or empty, the value pushed back or popped, and the length."""
    cap = rounded_capacity(capacity)
    rows = lengths(log.select("inst", "seq", "op", "value"), _step("push", "pop"), capacity, block)
    full, empty = (F.col("op") == "push") & (F.col("before") == cap), (F.col("op") == "pop") & (F.col("before") == 0)
    return _outcomes(rows.withColumn("status", F.when(full, "full").when(empty, "empty").otherwise("ok")), "push", "pop")


def channel(log: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """Ops try_send, try_recv, drop_sender and drop_receiver.

    A send to a dropped receiver is disconnected, even if the channel is full; a receive takes what is buffered before it
    sees that the sender is gone. A rejected value comes back with its status.
    """
    cap, op = rounded_capacity(capacity), F.col("op")
    gone = lambda name: F.when(op == name, F.col("seq"))
    rows = running(log.select("inst", "seq", "op", "value"), "inst", "seq", no_receiver=("min", gone("drop_receiver")), no_sender=("min", gone("drop_sender")))
    sent = (op == "try_send") & F.col("no_receiver").isNull()
    rows = lengths(rows, F.when(sent, 1).when(op == "try_recv", -1).otherwise(0), capacity, block)
    status = F.when((op == "try_send") & F.col("no_receiver").isNotNull(), "disconnected").when((op == "try_send") & (F.col("before") == cap), "full")
    status = status.when((op == "try_recv") & (F.col("before") == 0), F.when(F.col("no_sender").isNotNull(), "disconnected").otherwise("empty")).otherwise("ok")
    return _outcomes(rows.withColumn("status", status), "try_send", "try_recv")
