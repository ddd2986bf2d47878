"""Closed forms and folds against plain models on seeded random logs; golden sequences."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from foldspar.operators import bounded, fifo, folds, keyed, latest, ordered
from foldspar.operators.running import running
from foldspar.streaming import stateful

SCHEMA = "inst long, seq long, op string, key long, value long"


def log_of(spark, *steps, inst=0):
    return spark.createDataFrame([(inst, i, s[0], s[1] if len(s) > 2 else None, s[-1] if len(s) > 1 else None) for i, s in enumerate(steps)], SCHEMA)


def random_log(ops, seed, n=600, insts=5, keys=8):
    rng = random.Random(seed)
    return [(rng.randrange(insts), i, rng.choice(ops), rng.randrange(keys), rng.randrange(50)) for i in range(n)]


def outcomes(df, *columns):
    return [tuple(r) for r in df.orderBy("inst", "seq").select(*columns).collect()]


def by_inst(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("block", [4, 65_536])
def test_running_in_blocks(spark, block):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.choice([None, rng.randrange(-9, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "inst long, seq long, v long")
    got = outcomes(running(df, "inst", "seq", block, ("b",), s=("sum", F.col("v")), m=("min", F.col("v")), x=("last", F.col("v")), b=("sum", F.col("v"))), "inst", "seq", "s", "m", "x", "b")
    want, state = [], {}
    for i, q, v in by_inst(rows):
        s, m, x = state.get(i, (0, None, None))
        before = s
        if v is not None:
            s, m, x = s + v, v if m is None else min(m, v), v
        state[i] = (s, m, x)
        want.append((i, q, s, m, x, before))
    assert got == want


def test_slot_golden(spark):
    rows = latest.slot_log(log_of(spark, ("write", 1), ("write", 2), ("write", 3), ("peek",), ("read",), ("read",), ("write", 42), ("drop_writer",), ("read",)))
    assert outcomes(rows, "fresh", "delivered", "writer_gone")[3:] == [(True, None, False), (True, 3, False), (False, None, False), (True, None, False), (True, None, True), (True, 42, True)]


@pytest.mark.parametrize("seed", range(3))
def test_slot_against_a_model(spark, seed):
    rows = random_log(["write", "read", "peek"], seed)
    want, state = [], {}
    for i, q, op, _, v in by_inst(rows):
        value, fresh = state.get(i, (None, False))
        if op == "write":
            value, fresh = v, True
        want.append((i, q, fresh, value if op == "read" and fresh else None))
        state[i] = (value, fresh and op != "read")
    assert outcomes(latest.slot_log(spark.createDataFrame(rows, SCHEMA), 16), "inst", "seq", "fresh", "delivered") == want


@pytest.mark.parametrize("seed", range(3))
def test_queue_pairs_against_a_model(spark, seed):
    rows = random_log(["push", "pop", "pop"], seed)
    queues, want, depth = {}, [], []
    for i, q, op, _, v in by_inst(rows):
        d = queues.setdefault(i, deque())
        ok = True
        if op == "push":
            d.append((q, v))
        elif d:
            a = d.popleft()
            want.append((i, a[0], q, a[1]))
        else:
            ok = False
        depth.append((i, q, len(d), ok))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in fifo.pairs(df, 16).select("inst", "push_seq", "pop_seq", "value").collect()) == sorted(want)
    assert outcomes(fifo.depth(df, 16), "inst", "seq", "depth", "ok") == depth


def test_bounded_queue_golden(spark):
    got = outcomes(bounded.queue(log_of(spark, *[("push", k) for k in range(1, 6)], *[("pop",)] * 5), 4), "status", "value")
    assert got == [("ok", None)] * 4 + [("full", 5)] + [("ok", k) for k in range(1, 5)] + [("empty", None)]
    assert bounded.final_length(log_of(spark, *[("push", 1)] * 9, ("pop",)), 4).first().len == 3


def test_channel_golden(spark):
    got = outcomes(bounded.channel(log_of(spark, ("try_send", 1), ("try_send", 2), ("try_send", 3), *[("try_recv",)] * 3), 2), "status", "value")
    assert got == [("ok", None), ("ok", None), ("full", 3), ("ok", 1), ("ok", 2), ("empty", None)]
    got = outcomes(bounded.channel(log_of(spark, ("try_send", 1), ("try_send", 2), ("drop_sender",), *[("try_recv",)] * 3, ("drop_receiver",), ("try_send", 9)), 2), "status", "value")
    assert got == [("ok", None)] * 3 + [("ok", 1), ("ok", 2), ("disconnected", None), ("ok", None), ("disconnected", 9)]


@pytest.mark.parametrize(("seed", "block"), [(0, 4), (1, 16), (2, 4096)])
def test_bounded_queue_and_channel_against_models(spark, seed, block):
    rows = random_log(["try_send", "try_send", "try_recv", "drop_sender" if seed else "try_recv"], seed, 500, 3)
    rows += [(i, 450, "drop_receiver", 0, 0) for i in range(3)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    want, state = [], {}
    for i, q, op, _, v in by_inst(rows):
        d, gone = state.setdefault(i, (deque(), set()))
        status, value = "ok", None
        if op == "try_send":
            if "drop_receiver" in gone:
                status, value = "disconnected", v
            elif len(d) == 8:
                status, value = "full", v
            else:
                d.append(v)
        elif op == "try_recv":
            status, value = ("ok", d.popleft()) if d else ("disconnected" if "drop_sender" in gone else "empty", None)
        else:
            gone.add(op)
        want.append((i, q, op, status, value, len(d)))
    df = spark.createDataFrame(rows, SCHEMA)
    assert outcomes(bounded.channel(df, 7, block), "inst", "seq", "op", "status", "value", "len") == want
    ends = {i: x[-1] for i in range(3) for x in want if x[0] == i}
    if not seed:
        plain = df.where("op <> 'drop_receiver'").withColumn("op", F.when(F.col("op") == "try_send", "push").otherwise("pop"))
        got = {r.inst: r.len for r in bounded.final_length(plain, 7, block).collect()}
        last = {r.inst: r.len for r in bounded.queue(plain, 7, block).groupBy("inst").agg(F.max_by("len", "seq").alias("len")).collect()}
        assert got == last and ends


@pytest.mark.parametrize("seed", range(2))
def test_heap_against_a_model(spark, seed):
    rows = random_log(["push", "push", "pop", "peek", "remove", "clear"], seed)
    rows = [(i, q, "push" if op == "clear" and q % 5 else op, q if op != "remove" else max(0, q - 7), v) for i, q, op, _, v in rows]
    want, heaps = [], {}
    for i, q, op, k, v in by_inst(rows):
        h = heaps.setdefault(i, {})
        status, value = "ok", None
        if op == "push":
            if len(h) >= 9:
                status, value = "full", v
            else:
                h[k] = v
        elif op in ("pop", "peek"):
            if h:
                value, key = min((x, y) for y, x in h.items())
                if op == "pop":
                    del h[key]
            else:
                status = "empty"
        elif op == "remove":
            status, value = ("ok", h.pop(k)) if k in h else ("missing", None)
        else:
            h.clear()
        want.append((i, q, status, value, len(h)))
    assert outcomes(folds.heap(spark.createDataFrame(rows, SCHEMA), 9), "inst", "seq", "status", "value", "len") == want


def test_slab_golden(spark):
    insert, remove = ("insert",), lambda k: ("remove", k, None)
    got = outcomes(folds.slab(log_of(spark, insert, insert, insert, remove(1), insert), 8), "value")
    assert [x[0] for x in got] == [0, 1, 2, 1, 1]
    got = outcomes(folds.slab(log_of(spark, *[insert] * 4, remove(1), remove(2), insert, insert), 8), "value")
    assert [x[0] for x in got] == [0, 1, 2, 3, 1, 2, 2, 1]
    got = outcomes(folds.slab(log_of(spark, *[insert] * 5, remove(0), insert, insert), 2, 2), "status", "value")
    assert got == [("ok", 0), ("ok", 1), ("ok", 1 << 32), ("ok", (1 << 32) + 1), ("full", None), ("ok", 0), ("ok", 0), ("full", None)]


def test_slab_vacant_and_clear(spark):
    insert, vacant = ("insert",), ("vacant",)
    got = outcomes(folds.slab(log_of(spark, vacant, insert, vacant, insert, vacant, ("remove", 1, None), vacant, ("clear",), vacant, insert), 2), "value", "len")
    assert got == [(0, 0), (0, 1), (1, 1), (1, 2), (1 << 32, 2), (0, 1), (0, 1), (None, 0), (0, 0), (0, 1)]
    got = outcomes(folds.slab(log_of(spark, insert, vacant), 1, 1), "status", "value")
    assert got == [("ok", 0), ("full", None)]


def test_boxed_golden(spark):
    got = outcomes(folds.boxed(log_of(spark, ("insert", 5), ("insert", 6), ("remove", 3, None), ("insert", 7), ("remove", 0, None), ("clear",), ("insert", 8)), 4), "status", "value")
    assert got == [("ok", 3), ("ok", 2), ("ok", 5), ("ok", 3), ("missing", None), ("ok", None), ("ok", 3)]


@pytest.mark.parametrize("seed", range(2))
def test_sequence_against_a_list(spark, seed):
    ops = ["push_back", "push_front", "pop_back", "pop_front", "insert_after", "insert_before", "move_to_back", "move_to_front", "unlink"]
    rows = random_log(ops, seed, keys=40)
    want, lists = [], {}
    for i, q, op, k, v in by_inst(rows):
        x = lists.setdefault(i, [])
        status, value = "ok", None
        if op.startswith(("push", "insert")) and len(x) >= 12:
            status, value = "full", k
        elif op == "push_back":
            x.append(k)
        elif op == "push_front":
            x.insert(0, k)
        elif op.startswith("insert"):
            if v in x:
                x.insert(x.index(v) + (op == "insert_after"), k)
            else:
                status, value = "missing", k
        elif op.startswith("pop"):
            status, value = ("ok", x.pop(0 if op == "pop_front" else -1)) if x else ("empty", None)
        elif k in x:
            x.remove(k)
            if op.startswith("move"):
                x.insert(len(x) if op == "move_to_back" else 0, k)
        else:
            status = "missing"
        want.append((i, q, status, value, len(x)))
    assert outcomes(folds.sequence(spark.createDataFrame(rows, SCHEMA), 12), "inst", "seq", "status", "value", "len") == want


def test_bounded_map(spark):
    steps = [("insert", 5, 50), ("insert", 3, 30), ("insert", 5, 51), ("insert", 9, 90), ("get_or_insert", 3, 7), ("pop_first", None, None), ("get_or_insert", 9, 91), ("remove", 4, None), ("pop_last", None, None)]
    got = outcomes(folds.bounded_map(log_of(spark, *steps), 2), "status", "value", "len")
    assert got == [("ok", None, 1), ("ok", None, 2), ("ok", 50, 2), ("full", 90, 2), ("ok", 30, 2), ("ok", 30, 1), ("ok", 91, 2), ("missing", None, 2), ("ok", 91, 1)]


def test_upserts_and_latest(spark):
    log = spark.createDataFrame([(0, 1, "insert", 7, 1), (0, 2, "insert", 7, 2), (0, 3, "remove", 7, None), (0, 4, "insert", 7, 4)], SCHEMA)
    assert outcomes(latest.upserts(log), "old") == [(None,), (1,), (2,), (None,)]
    assert [r.value for r in latest.latest(log, ["inst", "key"]).collect()] == [4]


def test_sweep_golden(spark):
    df = spark.createDataFrame([(0, i, q) for i, q in enumerate([100, 50, 75])], "inst long, seq long, qty long")
    assert [tuple(r) for r in ordered.fill(df, "inst", "seq", "qty", F.lit(120), 2).orderBy("seq").select("filled", "left").collect()] == [(100, 0), (20, 30), (0, 75)]


def test_drains(spark):
    df = spark.createDataFrame([(0, x) for x in (30, 10, 50, 20, 40)], "inst long, v long")
    rows = ordered.drain_while(df, ["inst"], ["v"], F.col("v") <= 35).orderBy("v").collect()
    assert [r.v for r in rows if r.drained] == [10, 20, 30] and min(r.v for r in rows if not r.drained) == 40
    assert [r.v for r in ordered.drain_while(df, ["inst"], ["v"], F.col("v") != 20).collect() if r.drained] == [10]
    assert sorted(r.v for r in ordered.popped(df, ["inst"], ["v"], 2, True).collect()) == [10, 20, 30]


def test_split_and_append(spark):
    df = spark.createDataFrame([(0, i, k) for i, k in enumerate([1, 2, 3])], "inst long, pos long, key long")
    at = spark.createDataFrame([(0, 2)], "inst long, key long")
    got = {r.key: r.side for r in ordered.split_off(df, ["inst"], "pos", "key", at).collect()}
    assert got == {1: "head", 2: "tail", 3: "tail"}
    both = ordered.append(df, spark.createDataFrame([(0, 5, 8), (0, 6, 9), (1, 4, 7)], df.schema), ["inst"], "pos")
    assert [(r.inst, r.key) for r in both.orderBy("inst", "pos").collect()] == [(0, 1), (0, 2), (0, 3), (0, 8), (0, 9), (1, 7)]


def test_lower_bound_across_blocks(spark):
    rng = random.Random(2)
    entries = [(i, k, k * 10) for i in range(3) for k in rng.sample(range(1_000_000), 60)]
    probes = [(n, rng.randrange(4), rng.choice([e[1] for e in entries] + [rng.randrange(1_000_100) for _ in range(50)])) for n in range(300)]
    got = ordered.lower_bound(spark.createDataFrame(entries, "inst long, k long, v long"), spark.createDataFrame(probes, "n long, inst long, p long"), "inst", "k", "v", "p")
    want = {n: min((k for i2, k, _ in entries if i2 == i and k >= p), default=None) for n, i, p in probes}
    assert {r.n: r.found_key for r in got.collect()} == want


def test_keyed(spark):
    store = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "k long, v long")
    news = spark.createDataFrame([(2, 99), (3, 5), (4, 40)], "k long, v long")
    rows = lambda df, *cs: sorted((tuple(r) for r in df.select(*cs).collect()), key=str)
    assert rows(keyed.get(store, news.select("k"), "k", "v"), "k", "v") == [(2, 20), (3, None), (4, None)]
    assert rows(keyed.contains(store, news.select("k"), "k"), "k", "found") == [(2, True), (3, True), (4, False)]
    assert rows(keyed.remove(store, news, "k"), "k") == [(1,)]
    assert rows(keyed.replace(store, news, "k", "v"), "k", "v", "old_value") == [(1, 10, None), (2, 99, 20), (3, 5, None)]
    assert rows(keyed.or_insert(store, news, "k", "v"), "k", "v", "inserted") == [(1, 10, False), (2, 20, False), (3, None, False), (4, 40, True)]
    assert rows(keyed.modify(store, news, "k", "v", lambda v: v + 1), "k", "v") == [(1, 10), (2, 21), (3, None)]
    with pytest.raises(Exception, match="invalid key 4"):
        keyed.index(store, news.select("k"), "k", "v").collect()


def test_streams_equal_batches(spark, tmp_path):
    rows = random_log(["write", "read"], 5, 200)
    path = str(tmp_path / "log")
    for k in range(4):  # four files, in order of seq
        spark.createDataFrame(rows[50 * k : 50 * k + 50], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)

    def drained(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    batch = spark.createDataFrame(rows, SCHEMA)
    got = outcomes(drained(stateful.slot_reads(read()), "slots"), "inst", "seq", "fresh", "delivered")
    assert got == outcomes(latest.slot_log(batch).where("op = 'read'"), "inst", "seq", "fresh", "delivered")
    as_queue = lambda df: df.withColumn("op", F.when(F.col("op") == "write", "push").otherwise("pop"))
    got = outcomes(drained(stateful.queue_outcomes(as_queue(read()), 3), "queues"), "inst", "seq", "status", "value", "len")
    assert got == outcomes(bounded.queue(as_queue(batch), 3), "inst", "seq", "status", "value", "len")


def test_sizes_of_slabs_and_cleared_maps(spark):
    from foldspar.functions import keys

    assert keys.slab_sizing(1000, 64, 4096) == (64, 16) and keys.slab_sizing(1, 4096, 4096) == (1, 1) and keys.slab_sizing(65, 64, 4096) == (64, 2)
    for wrong in ((0, 8, 64), (5, 65, 64)):
        with pytest.raises(ValueError):
            keys.slab_sizing(*wrong)
    log = spark.createDataFrame([(1, 1, "insert", 1, 10), (1, 2, "clear", None, None), (1, 3, "pop_first", None, None), (1, 4, "insert", 2, 20)], "inst long, seq long, op string, key long, value long")
    assert [(r.status, r.len) for r in folds.bounded_map(log, 2).orderBy("seq").collect()] == [("ok", 1), ("ok", 0), ("empty", 0), ("ok", 1)]
