"""Operators whose outcomes depend on the evolving state of a container: one ordered fold for each instance.

An instance's log is sorted and folded by Python code in one group; instances run in parallel. What has a closed form is
in the other modules (bounded queues and channels in the module bounded), and insert-only forms of these operators are here as window expressions.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspar.functions.keys import rounded_capacity

_OUT = "inst long, seq long, op string, status string, value long, len long"


def _fold(log: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Applies make()'s function to the rows of each instance in order; it returns the row's outcome."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        step, out = make(), []
        for row in pdf.sort_values("seq").itertuples(index=False):
            out.append((row.inst, row.seq, row.op, *step(row)))
        names = [x.split()[0] for x in schema.split(", ")]
        return pd.DataFrame(out, columns=names).astype({n: "Int64" for n, t in (x.split() for x in schema.split(", ")) if t == "long"})

    return log.select("inst", "seq", "op", *columns).groupBy("inst").applyInPandas(run, schema)


def heap(log: DataFrame, capacity: int | None = None) -> DataFrame:
    """Ops push, pop, peek, remove (of key) and clear on a min-heap ordered by value, then key; key names the element.

    status is ok, full, empty or missing; value is what was popped, peeked, removed or pushed back.
    """

    def make():
        items: list = []
        live: dict = {}

        def top():
            while items and live.get(items[0][1]) != items[0][0]:
                heapq.heappop(items)
            return items[0] if items else None

        def step(row):
            status, value = "ok", None
            if row.op == "push":
                if capacity is not None and len(live) >= capacity:
                    status, value = "full", row.value
                else:
                    live[row.key] = row.value
                    heapq.heappush(items, (row.value, row.key))
            elif row.op in ("pop", "peek"):
                found = top()
                status, value = ("ok", found[0]) if found else ("empty", None)
                if found and row.op == "pop":
                    heapq.heappop(items)
                    del live[found[1]]
            elif row.op == "remove":
                status, value = ("ok", live.pop(row.key)) if row.key in live else ("missing", None)
            elif row.op == "clear":
                items.clear()
                live.clear()
            return status, value, len(live)

        return step

    return _fold(log, ["key", "value"], _OUT, make)


def slab(log: DataFrame, slots_per_slab: int, slabs: int | None = None) -> DataFrame:
    """Ops insert, remove (key is the seq of the insert to undo), vacant and clear on a slab store; slabs bounds it.

    The newest freed slot of the slab at the front of the free list goes first, then that slab's next unused slot; a full
    slab leaves the list and comes back to its front when a slot is freed. value is the slot's key, (slab << 32) | slot;
    vacant tells the one that the next insert takes. A cleared store keeps its slabs, all unused, the first one in front.
    """
    if slots_per_slab <= 0 or slabs == 0:
        raise ValueError("capacity must be positive")

    def make():
        freed: list[list[int]] = [[] for _ in range(slabs or 0)]
        bump: list[int] = [0] * (slabs or 0)
        front: list[int] = list(range(len(freed)))[::-1]  # the last one is the front
        held: dict = {}

        def step(row):
            if row.op == "vacant":
                if front:
                    s = front[-1]
                    return "ok", s << 32 | (freed[s][-1] if freed[s] else bump[s]), len(held)
                return ("ok", len(freed) << 32, len(held)) if slabs is None else ("full", None, len(held))
            if row.op == "clear":
                held.clear()
                freed[:], bump[:], front[:] = [[] for _ in freed], [0] * len(bump), range(len(freed))[::-1]
                return "ok", None, 0
            if row.op == "insert":
                if not front:
                    if slabs is not None:
                        return "full", None, len(held)
                    freed.append([])
                    bump.append(0)
                    front.append(len(freed) - 1)
                s = front[-1]
                if freed[s]:
                    slot = freed[s].pop()
                else:
                    slot, bump[s] = bump[s], bump[s] + 1
                if not freed[s] and bump[s] == slots_per_slab:
                    front.pop()
                held[row.seq] = (s, slot)
                return "ok", s << 32 | slot, len(held)
            if row.op == "remove":
                if row.key not in held:
                    return "missing", None, len(held)
                s, slot = held.pop(row.key)
                if not freed[s] and bump[s] == slots_per_slab:
                    front.append(s)
                freed[s].append(slot)
                return "ok", s << 32 | slot, len(held)
            return "ok", None, len(held)

        return step

    return _fold(log, ["key"], _OUT, make)


def slab_statistics(outcomes: DataFrame, slots_per_slab: int) -> DataFrame:
    """inst, len, slab_count and capacity of the stores that slab() went through."""
    by = outcomes.groupBy("inst").agg(F.max_by("len", "seq").alias("len"), (F.coalesce(F.max(F.when(F.col("op") == "insert", F.shiftrightunsigned("value", 32))), F.lit(-1)) + 1).alias("slab_count"))
    return by.withColumn("capacity", F.col("slab_count") * slots_per_slab)


def boxed(log: DataFrame, capacity: int) -> DataFrame:
    """Ops insert, remove (of key) and clear on a boxed store: keys count down from its capacity, the last one freed first."""
    cap = rounded_capacity(capacity)

    def make():
        free, held = list(range(cap)), {}

        def step(row):
            if row.op == "insert":
                if not free:
                    return "full", row.value, len(held)
                key = free.pop()
                held[key] = row.value
                return "ok", key, len(held)
            if row.op == "remove":
                if row.key not in held:
                    return "missing", None, len(held)
                free.append(int(row.key))
                return "ok", held.pop(row.key), len(held)
            if row.op == "clear":
                free[:] = range(cap)
                held.clear()
            return "ok", None, len(held)

        return step

    return _fold(log, ["key", "value"], _OUT, make)


def sequence(log: DataFrame, capacity: int | None = None) -> DataFrame:
    """Ops on a list of keys: push_back, push_front, pop_back, pop_front, insert_after and insert_before (of key, at value), move_to_back, move_to_front, unlink, clear.

    value is the key that was popped or pushed back; status is ok, full, empty or missing.
    """

    def make():
        items: list = []

        def step(row):
            op, key = row.op, row.key
            status, value = "ok", None
            if op in ("push_back", "push_front", "insert_after", "insert_before"):
                if capacity is not None and len(items) >= capacity:
                    status, value = "full", key
                elif op == "push_back":
                    items.append(key)
                elif op == "push_front":
                    items.insert(0, key)
                elif row.value not in items:
                    status, value = "missing", key
                else:
                    items.insert(items.index(row.value) + (op == "insert_after"), key)
            elif op in ("pop_back", "pop_front"):
                status, value = ("ok", items.pop(-1 if op == "pop_back" else 0)) if items else ("empty", None)
            elif op in ("move_to_back", "move_to_front", "unlink"):
                if key not in items:
                    status = "missing"
                else:
                    items.remove(key)
                    if op != "unlink":
                        items.insert(len(items) if op == "move_to_back" else 0, key)
            elif op == "clear":
                items.clear()
            return status, value, len(items)

        return step

    return _fold(log, ["key", "value"], _OUT, make)


def bounded_map(log: DataFrame, capacity: int) -> DataFrame:
    """Ops insert (upsert), get_or_insert, remove, pop_first, pop_last and clear on a sorted map; only a new key can find it full."""

    def make():
        held: dict = {}

        def step(row):
            status, value = "ok", None
            if row.op in ("insert", "get_or_insert"):
                old = held.get(row.key)
                if row.key not in held and len(held) >= capacity:
                    status, value = "full", row.value
                elif row.op == "insert":
                    value, held[row.key] = old, row.value
                else:
                    value = held.setdefault(row.key, row.value)
            elif row.op == "remove":
                status, value = ("ok", held.pop(row.key)) if row.key in held else ("missing", None)
            elif row.op in ("pop_first", "pop_last"):
                status, value = ("ok", held.pop((min if row.op == "pop_first" else max)(held))) if held else ("empty", None)
            elif row.op == "clear":
                held.clear()
            return status, value, len(held)

        return step

    return _fold(log, ["key", "value"], _OUT, make)


# Insert-only logs have closed forms.


def boxed_insert_key(inst: str, seq: str, capacity: int) -> Column:
    """Key of each insert into an empty boxed store, null where it is full."""
    cap = rounded_capacity(capacity)
    n = F.row_number().over(Window.partitionBy(inst).orderBy(seq))
    return F.when(n <= cap, (cap - n).cast("long"))


def slab_insert_key(inst: str, seq: str, slots_per_slab: int) -> Column:
    """Key of each insert into an empty growing slab store."""
    n = (F.row_number().over(Window.partitionBy(inst).orderBy(seq)) - 1).cast("long")
    return F.shiftleft(F.floor(n / slots_per_slab), 32).bitwiseOR(n % slots_per_slab)


def admitted(inst: str, seq: str, capacity: int) -> Column:
    """Whether an insert into an empty bounded structure is admitted."""
    return F.row_number().over(Window.partitionBy(inst).orderBy(seq)) <= capacity
