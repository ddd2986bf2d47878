"""Streaming forms of the conflation slot and the bounded queue: one keyed state for each instance.

Rows of a micro-batch are put in the order of seq before they are folded. A row that comes in a later batch than one with
a greater seq of its instance is handled when it comes. Both need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foldspar.functions.keys import rounded_capacity

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _ordered(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    parts = list(rows)
    return pd.concat(parts).sort_values("seq").itertuples(index=False) if parts else iter(())


class Slot(StatefulProcessor):
    """Ops write and read; a read gives the latest value if one was written since the last read."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "value long, fresh boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        value, fresh = self.held.get() if self.held.exists() else (None, False)
        out = []
        for row in _ordered(rows):
            if row.op == "write":
                value, fresh = int(row.value), True
            elif row.op == "read":
                out.append((key[0], row.seq, fresh, value if fresh else None))
                fresh = False
        self.held.update((value, fresh))
        yield pd.DataFrame(out, columns=["inst", "seq", "fresh", "delivered"]).astype({"inst": "int64", "seq": "int64", "fresh": "bool", "delivered": "Int64"})

    def close(self) -> None:
        pass


class Queue(StatefulProcessor):
    """Ops push and pop on a bounded queue."""

    def __init__(self, capacity: int):
        self.capacity = rounded_capacity(capacity)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "value long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items = [x[0] for x in self.items.get()]
        out = []
        for row in _ordered(rows):
            status, value = "ok", None
            if row.op == "push":
                if len(items) == self.capacity:
                    status, value = "full", int(row.value)
                else:
                    items.append(int(row.value))
            elif row.op == "pop":
                status, value = ("ok", items.pop(0)) if items else ("empty", None)
            out.append((key[0], row.seq, row.op, status, value, len(items)))
        self.items.clear()
        if items:
            self.items.put([(x,) for x in items])
        yield pd.DataFrame(out, columns=["inst", "seq", "op", "status", "value", "len"]).astype({"inst": "int64", "seq": "int64", "value": "Int64", "len": "int64"})

    def close(self) -> None:
        pass


def slot_reads(log: DataFrame) -> DataFrame:
    """inst, seq, fresh and delivered of each read in a streaming log."""
    return log.groupBy("inst").transformWithStateInPandas(Slot(), "inst long, seq long, fresh boolean, delivered long", "Append", "None")


def queue_outcomes(log: DataFrame, capacity: int) -> DataFrame:
    """The outcome of each row in a streaming log, as bounded.queue gives it for a whole one."""
    return log.groupBy("inst").transformWithStateInPandas(Queue(capacity), "inst long, seq long, op string, status string, value long, len long", "Append", "None")
