"""Queries over the driver's tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspar.functions import bits, keys
from foldspar.operators import bounded, fifo, folds, keyed, latest, ordered
from foldspar.operators.running import happened
from foldspar.sources.tables import op_log, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


c, lit = F.col, F.lit
STATUS = bits.IntEnum({"F": 0, "O": 1, "P": 2})
KIND = bits.IntEnum({"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4})
ORDER_ID = bits.Layout("u64", (bits.Member("status", "u8", 0, 2, STATUS), bits.Member("priority", "u8", 2, 3), bits.Member("custkey", "u32", 5, 24), bits.Member("orderkey", "u64", 29, 34)))
SNOWFLAKE = bits.Layout("u64", (bits.Member("sequence", "u16", 0, 12), bits.Member("worker", "u16", 12, 10), bits.Member("timestamp", "u64", 22, 41)))
MESSAGE = bits.TaggedLayout(
    "u64", 0, 4,
    {
        "Click": (0, (bits.Member("user", "u32", 4, 24), bits.flag("odd", 28))),
        "Purchase": (2, (bits.Member("user", "u32", 4, 24), bits.Member("kind", "u8", 28, 4, KIND), bits.Member("cents", "u32", 32, 28))),
        "View": (4, (bits.Member("user", "u32", 4, 24),)),
    },
)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    word = ORDER_ID.pack(strict=True, status=c("o_orderstatus"), priority=F.substring("o_orderpriority", 1, 1).cast("long"), custkey=c("o_custkey"), orderkey=c("o_orderkey"))
    return _orders(spark, d).select("o_orderkey", word.alias("id"))


_PACKED = "(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 4 + o_custkey * 32 + o_orderkey * 536870912)"


# -- bit fields, flags, enums, tagged words


@query("SELECT o_orderstatus AS status, count(*) AS n, max(o_orderkey) AS max_orderkey FROM orders WHERE o_custkey < 1000 GROUP BY 1")
def bits_pack_orders(spark, d):
    rows = _packed(spark, d).where(ORDER_ID.raw("id", "custkey") < 1000).select(ORDER_ID.unpack("id").alias("o"))
    return rows.groupBy(c("o.status").alias("status")).agg(F.count(lit(1)).alias("n"), F.max("o.orderkey").alias("max_orderkey"))


@query(f"SELECT o_orderkey, {_PACKED} AS id, o_orderstatus AS status, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority, o_custkey AS custkey, o_orderkey AS orderkey, CAST(NULL AS VARCHAR) AS problem FROM orders")
def bits_unpack_roundtrip(spark, d):
    return _packed(spark, d).select("o_orderkey", "id", ORDER_ID.unpack("id").alias("o"), ORDER_ID.status("id").alias("problem")).select("o_orderkey", "id", "o.*", "problem")


@query(f"SELECT o_orderkey, {_PACKED} AS id FROM orders WHERE substr(o_orderpriority, 1, 1) = '2'")
def bits_field_filter(spark, d):
    return _packed(spark, d).where(ORDER_ID.equals("id", "priority", 2))


@query("""SELECT o_orderkey, (o_custkey & ~CAST(4080 AS BIGINT)) | ((o_orderkey % 256) << 4) AS set_word, o_custkey & ~CAST(4080 AS BIGINT) AS cleared,
  (o_custkey & ~CAST(4080 AS BIGINT)) | ((o_orderkey % 512) << 4) AS leaked, (o_custkey >> 4) & 255 AS got FROM orders""")
def bits_set_clear(spark, d):
    f = bits.BitField(4, 8)
    return _orders(spark, d).select(
        "o_orderkey", f.set("o_custkey", c("o_orderkey") % 256).alias("set_word"), f.clear("o_custkey").alias("cleared"),
        f.set_unchecked("o_custkey", c("o_orderkey") % 512).alias("leaked"), f.get("o_custkey").alias("got"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 400 <= 255 THEN (o_custkey % 400) + 256 * (o_orderkey % 16) END AS word,
  CASE WHEN o_custkey % 400 > 255 THEN 'field ''low'': value ' || (o_custkey % 400) || ' exceeds max 255' END AS problem FROM orders""")
def bits_overflow_status(spark, d):
    layout = bits.Layout("u16", (bits.Member("low", "u8", 0, 8), bits.Member("high", "u8", 8, 8)))
    return _orders(spark, d).select("o_orderkey", layout.pack(low=c("o_custkey") % 400, high=c("o_orderkey") % 16).alias("p")).select("o_orderkey", c("p.value").alias("word"), c("p.status").alias("problem"))


@query("SELECT o_orderkey, o_orderkey AS low, o_custkey AS high, (o_orderkey >> 4) & 4095 AS middle, o_custkey & 255 AS top, (o_orderkey >> 60) | ((o_custkey & 15) << 4) AS across FROM orders")
def bits_wide_words(spark, d):
    layout = bits.Layout("u128", (bits.Member("low4", "u8", 0, 4), bits.Member("middle", "u16", 4, 12), bits.Member("across", "u8", 60, 8)))
    word = ("o_custkey", "o_orderkey")
    return _orders(spark, d).select("o_orderkey", c("o_orderkey").alias("low"), c("o_custkey").alias("high"), layout.get(word, "middle").alias("middle"), c("o_custkey").bitwiseAND(lit(255)).alias("top"), layout.get(word, "across").alias("across"))


@query("SELECT o_orderkey, o_custkey % 256 AS byte, CASE WHEN o_custkey % 256 >= 128 THEN o_custkey % 256 - 256 ELSE o_custkey % 256 END AS as_i8, o_custkey % 16 AS nibble FROM orders")
def bits_signed_fields(spark, d):
    layout = bits.Layout("u32", (bits.Member("whole", "i8", 0, 8), bits.Member("part", "i8", 8, 4)))
    rows = _orders(spark, d).withColumn("w", (c("o_custkey") % 256).bitwiseOR(F.shiftleft(c("o_custkey") % 16, 8)))
    return rows.select("o_orderkey", layout.raw("w", "whole").alias("byte"), layout.get("w", "whole").alias("as_i8"), layout.get("w", "part").alias("nibble"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey & 8) <> 0 AS is_set, count(*) AS n FROM lineitem GROUP BY ALL")
def flags_is_set(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", bits.Flag(3).is_set("l_partkey").alias("is_set")).agg(F.count(lit(1)).alias("n"))


@query("SELECT l_returnflag, sum(xor(l_partkey, 8)) AS toggled, sum(l_partkey | 8) AS was_set, sum(l_partkey & ~CAST(8 AS BIGINT)) AS cleared FROM lineitem GROUP BY 1".replace("sum(", "CAST(sum(").replace(") AS", ") AS BIGINT) AS"))
def flags_toggle(spark, d):
    f = bits.Flag(3)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.sum(g("l_partkey")).alias(n) for n, g in (("toggled", f.toggle), ("was_set", f.set), ("cleared", f.clear))])


@query("SELECT l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_suppkey | 1024 ELSE l_suppkey & ~CAST(1024 AS BIGINT) END) AS BIGINT) AS words FROM lineitem GROUP BY 1")
def flags_set_to(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.sum(bits.Flag(10).set_to("l_suppkey", c("l_returnflag") == "R")).alias("words"))


@query("SELECT event_id, event_type, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS BIGINT) AS code, event_type AS back FROM events")
def enum_encode_decode(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", KIND.encode(c("event_type")).alias("code")).withColumn("back", KIND.decode(c("code")))


@query("SELECT event_id, user_id % 7 AS code, CASE user_id % 7 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' WHEN 4 THEN 'view' END AS name, CASE WHEN user_id % 7 > 4 THEN 'field ''kind'': unknown discriminant ' || (user_id % 7) END AS problem FROM events")
def enum_unknown_code(spark, d):
    layout = bits.Layout("u64", (bits.Member("kind", "u8", 0, 4, KIND),))
    rows = table(spark, d, "events").select("event_id", (c("user_id") % 7).alias("code"))
    return rows.select("event_id", "code", layout.get("code", "kind").alias("name"), layout.status("code").alias("problem"))


def _messages(spark, d):
    rows = table(spark, d, "events")
    kind, user, cents = c("event_type"), c("user_id"), (F.abs(c("value")) * 100).cast("long") % 100_000
    word = (
        F.when(kind == "click", MESSAGE.pack("Click", strict=True, user=user, odd=user % 2 == 1))
        .when(kind == "purchase", MESSAGE.pack("Purchase", strict=True, user=user, kind=kind, cents=cents))
        .when(kind == "view", MESSAGE.pack("View", strict=True, user=user))
        .otherwise(F.shiftleft(user, 4).bitwiseOR(lit(15)))
    )
    return rows.select("event_id", word.alias("word"))


_CENTS = "(CAST(trunc(abs(value) * 100) AS BIGINT) % 100000)"
_WORD = f"""CASE event_type WHEN 'click' THEN user_id * 16 + (user_id % 2) * 268435456 WHEN 'purchase' THEN 2 + user_id * 16 + CAST(2 AS BIGINT) * 268435456 + {_CENTS} * 4294967296
  WHEN 'view' THEN 4 + user_id * 16 ELSE 15 + user_id * 16 END"""


@query(f"SELECT event_id, {_WORD} AS word FROM events")
def tagged_pack(spark, d):
    return _messages(spark, d)


@query("SELECT CASE event_type WHEN 'click' THEN 'Click' WHEN 'purchase' THEN 'Purchase' WHEN 'view' THEN 'View' END AS kind, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS views FROM events GROUP BY 1")
def tagged_kind_counts(spark, d):
    return _messages(spark, d).groupBy(MESSAGE.kind("word").alias("kind")).agg(F.count(lit(1)).alias("n"), F.count_if(MESSAGE.is_variant("word", "View")).alias("views"))


@query(f"""SELECT event_id, CASE WHEN event_type = 'purchase' THEN user_id END AS user, CASE WHEN event_type = 'purchase' THEN 'purchase' END AS kind, CASE WHEN event_type = 'purchase' THEN {_CENTS} END AS cents,
  CASE WHEN event_type <> 'purchase' THEN 'field ''__discriminant'': unknown discriminant ' || CAST({_WORD} AS VARCHAR) END AS problem FROM events""")
def tagged_as_variant(spark, d):
    rows = _messages(spark, d).select("event_id", MESSAGE.as_variant("word", "Purchase").alias("p"))
    return rows.select("event_id", c("p.value.user").alias("user"), c("p.value.kind").alias("kind"), c("p.value.cents").alias("cents"), c("p.status").alias("problem"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id % 1024, ms ORDER BY event_id) - 1 AS s FROM e)
SELECT event_id, s + (user_id % 1024) * 4096 + ms * 4194304 AS id, s AS sequence, user_id % 1024 AS worker, ms AS timestamp FROM n""")
def snowflake_ids(spark, d):
    rows = table(spark, d, "events").select("event_id", (c("user_id") % 1024).alias("w"), F.unix_millis(c("ts").cast("timestamp")).alias("ms"))
    rows = ordered.placed(rows, ["w", "ms"], ["event_id"], "s")
    rows = rows.select("event_id", SNOWFLAKE.pack(strict=True, sequence=c("s") - 1, worker=c("w"), timestamp=c("ms")).alias("id"))
    return rows.select("event_id", "id", SNOWFLAKE.unpack("id").alias("u")).select("event_id", "id", "u.*")


# -- conflation slots


def _slot_log(spark, d):
    return op_log(table(spark, d, "events"), c("user_id"), c("event_id"), {"click": "write", "purchase": "write", "view": "read", "error": "peek", "signup": "drop_writer"}, c("event_type"), value=c("event_id"))


_SLOT = """WITH l AS (SELECT user_id AS inst, event_id AS seq, event_type AS t,
  max(CASE WHEN event_type IN ('click', 'purchase') THEN event_id END) OVER w AS lw,
  max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lr,
  max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w AS gone FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) """


@query(_SLOT + "SELECT inst, seq, CASE WHEN lw > coalesce(lr, -1) THEN lw END AS delivered, gone IS NOT NULL AS writer_gone FROM l WHERE t = 'view'")
def slot_reads(spark, d):
    return latest.slot_log(_slot_log(spark, d)).where("op = 'read'").select("inst", "seq", "delivered", "writer_gone")


@query(_SLOT + "SELECT inst, seq, coalesce(lw > coalesce(lr, -1), false) AS fresh, false AS reader_gone FROM l WHERE t = 'error'")
def slot_has_update(spark, d):
    return latest.slot_log(_slot_log(spark, d)).where("op = 'peek'").select("inst", "seq", "fresh", "reader_gone")


@query("SELECT user_id AS inst, max(event_id) AS seq, max(event_id) AS value FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def slot_latest_per_user(spark, d):
    return latest.latest(_slot_log(spark, d).where("op = 'write'"), ["inst"]).select("inst", "seq", "value")


# -- queues and channels


def _queue_log(spark, d):
    return op_log(table(spark, d, "events"), c("user_id"), c("event_id"), {"click": "push", "view": "push", "signup": "push", "purchase": "pop", "error": "pop"}, c("event_type"), value=c("event_id"))


_QUEUE = """WITH l AS (SELECT user_id AS inst, event_id AS seq, CASE WHEN event_type IN ('purchase', 'error') THEN 'pop' ELSE 'push' END AS op FROM events),
s AS (SELECT *, sum(CASE op WHEN 'push' THEN 1 ELSE -1 END) OVER w AS s FROM l WINDOW w AS (PARTITION BY inst ORDER BY seq ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY inst ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS m FROM s),
o AS (SELECT *, op = 'push' OR m = coalesce(lag(m) OVER (PARTITION BY inst ORDER BY seq), 0) AS ok FROM m),
n AS (SELECT *, CASE WHEN ok THEN sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY inst, op ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS n FROM o) """


@query(_QUEUE + "SELECT a.inst, CAST(a.n AS BIGINT) AS n, a.seq AS push_seq, b.seq AS pop_seq, a.seq AS value FROM n a JOIN n b ON a.inst = b.inst AND a.n = b.n AND a.op = 'push' AND b.op = 'pop' AND b.ok")
def queue_pairs(spark, d):
    return fifo.pairs(_queue_log(spark, d))


@query(_QUEUE + "SELECT inst, seq, op, CAST(s - m AS BIGINT) AS depth, ok FROM n")
def queue_depth(spark, d):
    return fifo.depth(_queue_log(spark, d)).select("inst", "seq", "op", "depth", "ok")


@query(_QUEUE + "SELECT inst, seq, CAST((n - 1) % 8 AS BIGINT) AS slot, CAST((n - 1) // 8 + 1 AS BIGINT) AS lap FROM n WHERE op = 'push'")
def queue_ring_coords(spark, d):
    slot, lap = fifo.ring(c("n"), 5)
    return fifo.depth(_queue_log(spark, d)).where("op = 'push'").select("inst", "seq", slot.alias("slot"), lap.alias("lap"))


@query("""SELECT user_id AS inst, event_id AS seq, coalesce(bool_or(event_type = 'signup') OVER w, false) AS producer_gone, coalesce(bool_or(event_type = 'error') OVER w, false) AS consumer_gone FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def queue_disconnected(spark, d):
    log = op_log(table(spark, d, "events"), c("user_id"), c("event_id"), {"click": "push", "view": "pop", "purchase": "pop", "signup": "drop_producer", "error": "drop_consumer"}, c("event_type"))
    return happened(log, "inst", "seq", producer_gone="drop_producer", consumer_gone="drop_consumer").select("inst", "seq", "producer_gone", "consumer_gone")


_STEPPED = """WITH RECURSIVE l AS (SELECT user_id AS inst, event_id AS seq, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events{where}), """


@query(_STEPPED.format(where="") + """f AS (
  SELECT inst, rn, seq, t, CAST(0 AS BIGINT) AS before, CASE WHEN t IN ('purchase', 'error') THEN CAST(0 AS BIGINT) ELSE 1 END AS len FROM l WHERE rn = 1
  UNION ALL SELECT l.inst, l.rn, l.seq, l.t, f.len, greatest(0, least(4, f.len + CASE WHEN l.t IN ('purchase', 'error') THEN -1 ELSE 1 END)) FROM f JOIN l ON l.inst = f.inst AND l.rn = f.rn + 1),
p AS (SELECT *, CASE WHEN t IN ('purchase', 'error') THEN 'pop' ELSE 'push' END AS op FROM f),
q AS (SELECT *, CASE WHEN op = 'push' AND before = 4 THEN 'full' WHEN op = 'pop' AND before = 0 THEN 'empty' ELSE 'ok' END AS status FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY inst, op, status ORDER BY seq) AS n FROM q)
SELECT a.inst, a.seq, a.op, a.status, CASE WHEN a.status = 'full' THEN a.seq WHEN a.op = 'pop' AND a.status = 'ok' THEN b.seq END AS value, a.len
FROM n a LEFT JOIN n b ON a.op = 'pop' AND a.status = 'ok' AND b.op = 'push' AND b.status = 'ok' AND a.inst = b.inst AND a.n = b.n""")
def queue_bounded(spark, d):
    return bounded.queue(_queue_log(spark, d), 3)


@query(_STEPPED.format(where="") + """f AS (
  SELECT inst, rn, CASE WHEN t IN ('purchase', 'error') THEN CAST(0 AS BIGINT) ELSE 1 END AS len FROM l WHERE rn = 1
  UNION ALL SELECT l.inst, l.rn, greatest(0, least(4, f.len + CASE WHEN l.t IN ('purchase', 'error') THEN -1 ELSE 1 END)) FROM f JOIN l ON l.inst = f.inst AND l.rn = f.rn + 1)
SELECT inst, arg_max(len, rn) AS len FROM f GROUP BY inst""")
def queue_final_depth(spark, d):
    return bounded.final_length(_queue_log(spark, d), 4)


def _channel_log(spark, d):
    rows = table(spark, d, "events").withColumn("op", F.when(c("event_id") % 97 == 0, "drop_receiver").when(c("event_id") % 61 == 0, "drop_sender").when(c("event_type").isin("click", "view", "signup"), "try_send").otherwise("try_recv"))
    return rows.select(c("user_id").alias("inst"), c("event_id").alias("seq"), "op", lit(None).cast("long").alias("key"), c("event_id").alias("value"))


_CHANNEL = """WITH RECURSIVE l AS (SELECT user_id AS inst, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
  CASE WHEN event_id % 97 = 0 THEN 'drop_receiver' WHEN event_id % 61 = 0 THEN 'drop_sender' WHEN event_type IN ('click', 'view', 'signup') THEN 'try_send' ELSE 'try_recv' END AS op FROM events),
g AS (SELECT *, coalesce(bool_or(op = 'drop_receiver') OVER w, false) AS no_receiver, coalesce(bool_or(op = 'drop_sender') OVER w, false) AS no_sender FROM l
  WINDOW w AS (PARTITION BY inst ORDER BY seq ROWS UNBOUNDED PRECEDING)),
f AS (SELECT inst, rn, CAST([] AS BIGINT[]) AS before, CASE WHEN op = 'try_send' AND NOT no_receiver THEN [seq] ELSE [] END AS q FROM g WHERE rn = 1
  UNION ALL SELECT g.inst, g.rn, f.q, CASE WHEN g.op = 'try_send' AND NOT g.no_receiver AND len(f.q) < 4 THEN list_append(f.q, g.seq) WHEN g.op = 'try_recv' THEN f.q[2:] ELSE f.q END
  FROM f JOIN g ON g.inst = f.inst AND g.rn = f.rn + 1)
SELECT g.inst, g.seq, g.op,
  CASE WHEN op = 'try_send' THEN CASE WHEN no_receiver THEN 'disconnected' WHEN len(before) = 4 THEN 'full' ELSE 'ok' END
       WHEN op = 'try_recv' THEN CASE WHEN len(before) > 0 THEN 'ok' WHEN no_sender THEN 'disconnected' ELSE 'empty' END ELSE 'ok' END AS status,
  CASE WHEN op = 'try_send' AND (no_receiver OR len(before) = 4) THEN g.seq WHEN op = 'try_recv' THEN before[1] END AS value, CAST(len(q) AS BIGINT) AS len
FROM g JOIN f ON g.inst = f.inst AND g.rn = f.rn"""


@query(_CHANNEL)
def channel_outcomes(spark, d):
    return bounded.channel(_channel_log(spark, d), 4)


@query(f"SELECT status, count(*) AS n, count(value) AS values FROM ({_CHANNEL.replace('WITH RECURSIVE', 'WITH RECURSIVE')}) WHERE op = 'try_recv' GROUP BY 1")
def channel_drain_after_close(spark, d):
    return bounded.channel(_channel_log(spark, d), 4).where("op = 'try_recv'").groupBy("status").agg(F.count(lit(1)).alias("n"), F.count("value").alias("values"))


# -- heaps

_LINE = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
_LINE_SQL = ", ".join(_LINE)


def _lines(spark, d):
    return table(spark, d, "lineitem").select(*_LINE)


@query(f"SELECT {_LINE_SQL}, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_SQL}) AS BIGINT) AS place FROM lineitem")
def heap_drain_sorted(spark, d):
    return ordered.placed(_lines(spark, d), ["l_suppkey"], _LINE).withColumn("place", c("place").cast("long"))


@query(f"SELECT * FROM (SELECT {_LINE_SQL}, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_SQL}) AS place FROM lineitem) WHERE place <= 3")
def heap_topk(spark, d):
    return ordered.lowest(_lines(spark, d), ["l_suppkey"], _LINE, 3).withColumn("place", c("place").cast("long"))


@query("SELECT o_custkey, count(*) AS len, arg_min(o_totalprice, (o_totalprice, o_orderkey)) AS first_o_totalprice, arg_max(o_totalprice, (o_totalprice, o_orderkey)) AS last_o_totalprice, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS first_o_orderkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS last_o_orderkey FROM orders GROUP BY 1")
def heap_peek_by_group(spark, d):
    return ordered.ends(_orders(spark, d), ["o_custkey"], ["o_totalprice", "o_orderkey"], "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 50000")
def heap_drain_while(spark, d):
    return ordered.drain_upto(_orders(spark, d), "o_totalprice", lit(50000.0)).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, coalesce(min(CASE WHEN o_orderkey % 5 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING), 0) = 1 AS drained FROM orders")
def heap_drain_while_general(spark, d):
    return ordered.drain_while(_orders(spark, d), ["o_custkey"], ["o_totalprice", "o_orderkey"], c("o_orderkey") % 5 != 0).select("o_custkey", "o_orderkey", "drained")


@query(f"SELECT l_suppkey, count(*) AS n, min(l_extendedprice) AS low FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_SQL}) AS p FROM lineitem) WHERE p > 3 GROUP BY 1")
def heap_after_pops(spark, d):
    return ordered.popped(_lines(spark, d), ["l_suppkey"], _LINE, 3).groupBy("l_suppkey").agg(F.count(lit(1)).alias("n"), F.min("l_extendedprice").alias("low"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 100000) AS found FROM customer")
def heap_contains(spark, d):
    store = _orders(spark, d).where("o_totalprice < 100000").select(c("o_custkey").alias("c_custkey")).distinct()
    return keyed.contains(store, table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def heap_remove(spark, d):
    gone = table(spark, d, "customer").where("c_nationkey < 5").select(c("c_custkey").alias("o_custkey"))
    return keyed.remove(_orders(spark, d), gone, "o_custkey").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, CASE WHEN n IS NOT NULL THEN CAST(n AS DOUBLE) ELSE c_acctbal END AS c_acctbal, CASE WHEN n IS NOT NULL THEN c_acctbal END AS old_value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1) ON o_custkey = c_custkey")
def heap_replace(spark, d):
    news = _orders(spark, d).where("o_custkey % 3 = 0").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count(lit(1)).cast("double").alias("c_acctbal"))
    return keyed.replace(table(spark, d, "customer").select("c_custkey", "c_acctbal"), news, "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice - 1000 ELSE o_totalprice END AS o_totalprice FROM orders")
def heap_decrease_with(spark, d):
    orders = _orders(spark, d).select("o_orderkey", "o_totalprice")
    return keyed.modify(orders, orders.where("o_orderkey % 10 = 3"), "o_orderkey", "o_totalprice", lambda v: v - 1000)


def _heap_log(spark, d):
    rows = op_log(table(spark, d, "events"), c("user_id"), c("event_id"), {"click": "push", "view": "push", "purchase": "pop", "error": "peek", "signup": "push"}, c("event_type"), key=c("event_id"), value=(c("event_id") * 7919) % 1009)
    return rows


@query("""WITH RECURSIVE l AS (SELECT user_id AS inst, event_id AS seq, (event_id * 7919) % 1009 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
  CASE event_type WHEN 'purchase' THEN 'pop' WHEN 'error' THEN 'peek' ELSE 'push' END AS op FROM events),
f AS (SELECT inst, rn, CAST([] AS BIGINT[]) AS before, CASE WHEN op = 'push' THEN [v * 100000000 + seq] ELSE [] END AS h FROM l WHERE rn = 1
  UNION ALL SELECT l.inst, l.rn, f.h, CASE l.op WHEN 'push' THEN list_append(f.h, l.v * 100000000 + l.seq) WHEN 'pop' THEN list_filter(f.h, lambda x: x <> list_min(f.h)) ELSE f.h END
  FROM f JOIN l ON l.inst = f.inst AND l.rn = f.rn + 1)
SELECT l.inst, l.seq, l.op, CASE WHEN op <> 'push' AND len(before) = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN op <> 'push' THEN list_min(before) // 100000000 END AS value, CAST(len(h) AS BIGINT) AS len
FROM l JOIN f ON l.inst = f.inst AND l.rn = f.rn""")
def heap_interleaved(spark, d):
    return folds.heap(_heap_log(spark, d))


# -- lists

_ORDER = "l_shipdate, l_partkey, l_suppkey, l_orderkey, l_linenumber"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS BIGINT) AS place, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER.replace(',', ' DESC,')} DESC) AS BIGINT) AS from_back FROM lineitem")
def list_iter(spark, d):
    order = _ORDER.split(", ")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    rows = ordered.placed(ordered.placed(rows, ["l_orderkey"], order), ["l_orderkey"], order, "from_back", True)
    return rows.withColumns({n: c(n).cast("long") for n in ("place", "from_back")})


@query("""SELECT user_id AS inst, event_id AS key, lag(event_id) OVER w AS prev_key, lead(event_id) OVER w AS next_key, lag(event_id) OVER w IS NULL AS is_head, lead(event_id) OVER w IS NULL AS is_tail FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def list_prev_next(spark, d):
    rows = table(spark, d, "events").select(c("user_id").alias("inst"), c("event_id").alias("key"))
    return ordered.neighbours(rows, ["inst"], ["key"], "key")


@query("SELECT user_id, count(*) AS len, arg_min(event_type, event_id) AS first_event_type, arg_max(event_type, event_id) AS last_event_type, min(event_id) AS first_event_id, max(event_id) AS last_event_id FROM events GROUP BY 1")
def list_front_back(spark, d):
    return ordered.ends(table(spark, d, "events"), ["user_id"], ["event_id"], "event_type", "event_id")


@query("""WITH cut AS (SELECT user_id, min(event_id) AS p FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.user_id, event_id, CASE WHEN event_id < p THEN 'head' WHEN event_id >= p THEN 'tail' END AS side FROM events e LEFT JOIN cut ON e.user_id = cut.user_id""")
def list_split_off(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", c("event_id").alias("pos"), "event_type")
    at = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return ordered.split_off(rows, ["user_id"], "pos", "event_id", at).select("user_id", "event_id", "side")


@query("""WITH p AS (SELECT user_id, event_id, event_type = 'view' AS other, row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY event_id) AS pos FROM events),
l AS (SELECT user_id, max(pos) AS n FROM p WHERE NOT other GROUP BY 1)
SELECT p.user_id, event_id, CAST(pos + CASE WHEN other THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS pos FROM p LEFT JOIN l ON p.user_id = l.user_id""")
def list_append(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", (c("event_type") == "view").alias("other"))
    rows = ordered.placed(rows, ["user_id", "other"], ["event_id"], "pos").withColumn("pos", c("pos").cast("long"))
    return ordered.append(rows.where(~c("other")), rows.where("other"), ["user_id"], "pos").select("user_id", "event_id", "pos")


@query("SELECT user_id, event_type, max(event_id) AS last_seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY max(event_id)) AS BIGINT) AS place FROM events GROUP BY 1, 2")
def list_lru_order(spark, d):
    return ordered.recency(table(spark, d, "events"), ["user_id"], "event_type", "event_id").withColumn("place", c("place").cast("long"))


@query("SELECT CASE WHEN event_type = 'purchase' THEN 'settled' ELSE 'open' END AS list_id, count(*) AS len, min(event_id) AS first_key, max(event_id) AS last_key FROM events GROUP BY 1")
def list_move_between(spark, d):
    rows = table(spark, d, "events").select(F.when(c("event_type") == "purchase", "settled").otherwise("open").alias("list_id"), c("event_id").alias("key"))
    return ordered.ends(rows, ["list_id"], ["key"], "key")


@query("""WITH r AS (SELECT *, coalesce(sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT l_partkey, CAST(l_quantity AS BIGINT) AS l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS s FROM lineitem))
SELECT l_partkey, CAST(s AS BIGINT) AS s, l_quantity, CAST(greatest(0, least(l_quantity, 120 - before)) AS BIGINT) AS filled, CAST(l_quantity - greatest(0, least(l_quantity, 120 - before)) AS BIGINT) AS left FROM r""".replace("AS left FROM", 'AS "left" FROM'))
def list_fifo_fill(spark, d):
    rows = ordered.placed(table(spark, d, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"], "s")
    rows = rows.select("l_partkey", c("s").cast("long").alias("s"), c("l_quantity").cast("long").alias("l_quantity"))
    return ordered.fill(rows, "l_partkey", "s", "l_quantity", lit(120).cast("long"))


@query("SELECT user_id, event_id, CASE WHEN event_id = max(event_id) OVER (PARTITION BY user_id) THEN value * 2 ELSE value END AS value FROM events")
def list_back_mut(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "value")
    return ordered.change_end(rows, ["user_id"], ["event_id"], "value", lambda v: v * 2, backward=True)


@query("""WITH RECURSIVE l AS (SELECT user_id AS inst, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_id % 23 AS key, event_id % 7 AS value,
  CASE event_type WHEN 'click' THEN 'push_back' WHEN 'view' THEN 'push_front' WHEN 'signup' THEN 'insert_after' WHEN 'purchase' THEN 'pop_front' ELSE 'move_to_back' END AS op FROM events),
f AS (SELECT inst, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS q, CAST([] AS BIGINT[]) AS was FROM (SELECT DISTINCT inst FROM l)
  UNION ALL SELECT l.inst, l.rn, CASE
    WHEN op IN ('push_back', 'push_front', 'insert_after') AND len(q) >= 16 THEN q
    WHEN op = 'push_back' THEN list_append(q, key)
    WHEN op = 'push_front' THEN list_prepend(key, q)
    WHEN op = 'insert_after' AND list_contains(q, value) THEN q[1:list_position(q, value)] || [key] || q[list_position(q, value) + 1:len(q)]
    WHEN op = 'pop_front' THEN q[2:len(q)]
    WHEN op = 'move_to_back' AND list_contains(q, key) THEN q[1:list_position(q, key) - 1] || q[list_position(q, key) + 1:len(q)] || [key]
    ELSE q END, q
  FROM f JOIN l ON l.inst = f.inst AND l.rn = f.rn + 1)
SELECT l.inst, seq, op, CASE
    WHEN op IN ('push_back', 'push_front', 'insert_after') AND len(was) >= 16 THEN 'full'
    WHEN op = 'insert_after' AND NOT list_contains(was, value) THEN 'missing'
    WHEN op = 'pop_front' AND len(was) = 0 THEN 'empty'
    WHEN op = 'move_to_back' AND NOT list_contains(was, key) THEN 'missing' ELSE 'ok' END AS status,
  CASE WHEN op IN ('push_back', 'push_front', 'insert_after') AND len(was) >= 16 THEN key
    WHEN op = 'insert_after' AND NOT list_contains(was, value) THEN key
    WHEN op = 'pop_front' THEN was[1] END AS value, CAST(len(q) AS BIGINT) AS len
FROM f JOIN l ON l.inst = f.inst AND l.rn = f.rn""")
def list_positional(spark, d):
    """Inserts after a key, moves and pops in order."""
    ops = {"click": "push_back", "view": "push_front", "signup": "insert_after", "purchase": "pop_front", "error": "move_to_back"}
    log = op_log(table(spark, d, "events"), c("user_id"), c("event_id"), ops, c("event_type"), key=c("event_id") % 23, value=c("event_id") % 7)
    return folds.sequence(log, 16)


# -- sorted maps


@query("SELECT o_custkey, count(*) AS len, min(o_orderkey) AS first_o_orderkey, max(o_orderkey) AS last_o_orderkey, arg_min(o_totalprice, o_orderkey) AS first_o_totalprice, arg_max(o_totalprice, o_orderkey) AS last_o_totalprice FROM orders GROUP BY 1")
def map_first_last(spark, d):
    return ordered.ends(_orders(spark, d), ["o_custkey"], ["o_orderkey"], "o_orderkey", "o_totalprice")


@query("SELECT e.event_id, e.user_id AS c_custkey, c_acctbal FROM events e LEFT JOIN customer ON user_id = c_custkey")
def map_get(spark, d):
    return keyed.get(table(spark, d, "customer"), table(spark, d, "events").select("event_id", c("user_id").alias("c_custkey")), "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_custkey AS c_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS found FROM orders")
def map_contains(spark, d):
    return keyed.contains(table(spark, d, "customer").where("c_acctbal > 0"), _orders(spark, d).select("o_orderkey", c("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT e.event_id, e.user_id AS o_custkey, e.event_id * 3 AS probe, min(o_orderkey) AS found_key, arg_min(o_totalprice, o_orderkey) AS found_value
FROM events e LEFT JOIN orders ON o_custkey = e.user_id AND o_orderkey >= e.event_id * 3 GROUP BY ALL""")
def map_lower_bound(spark, d):
    probes = table(spark, d, "events").select("event_id", c("user_id").alias("o_custkey"), (c("event_id") * 3).alias("probe"))
    return ordered.lower_bound(_orders(spark, d), probes, "o_custkey", "o_orderkey", "o_totalprice", "probe")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS place FROM orders")
def map_iter_keys(spark, d):
    return ordered.placed(_orders(spark, d).select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]).withColumn("place", c("place").cast("long"))


def _map_log(spark, d):
    return op_log(table(spark, d, "events"), c("user_id") % 50, c("event_id"), {"click": "insert", "view": "insert", "purchase": "insert", "error": "remove"}, c("event_type"), key=c("event_id") % 11, value=c("event_id"))


@query("""WITH l AS (SELECT user_id % 50 AS inst, event_id AS seq, event_id % 11 AS key, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'insert' END AS op FROM events WHERE event_type <> 'signup')
SELECT inst, key, seq, op, lag(CASE WHEN op = 'insert' THEN seq END) OVER (PARTITION BY inst, key ORDER BY seq) AS old FROM l""")
def map_upsert_old_value(spark, d):
    return latest.upserts(_map_log(spark, d)).select("inst", "key", "seq", "op", "old")


@query("SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(c_acctbal, t) AS c_acctbal, c_custkey IS NULL AS inserted FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def map_or_insert(spark, d):
    news = _orders(spark, d).groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return keyed.or_insert(table(spark, d, "customer").where("c_custkey % 2 = 0"), news, "c_custkey", "c_acctbal")


@query("SELECT k AS c_custkey, coalesce(c_acctbal, 0) AS c_acctbal, c_custkey IS NULL AS inserted FROM (SELECT c_custkey AS k FROM customer WHERE c_nationkey > 9 UNION SELECT o_custkey FROM orders) LEFT JOIN (SELECT * FROM customer WHERE c_nationkey > 9) ON k = c_custkey")
def map_or_default(spark, d):
    return keyed.or_default(table(spark, d, "customer").where("c_nationkey > 9"), _orders(spark, d).select(c("o_custkey").alias("c_custkey")), "c_custkey", "c_acctbal", lit(0))


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def map_and_modify(spark, d):
    hit = _orders(spark, d).where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    return keyed.modify(table(spark, d, "customer").select("c_custkey", "c_acctbal"), hit, "c_custkey", "c_acctbal", lambda v: v * 2)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 2 <> 0")
def map_sweep_remove(spark, d):
    return _orders(spark, d).where("o_orderkey % 2 <> 0").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, CAST(place AS BIGINT) AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders) WHERE place <= 2")
def map_pop_last_n(spark, d):
    return ordered.lowest(_orders(spark, d).select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 2, True).withColumn("place", c("place").cast("long"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) WHERE place > 2")
def map_pop_first_n(spark, d):
    return ordered.popped(_orders(spark, d).select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 2)


@query("""WITH RECURSIVE l AS (SELECT user_id AS inst, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_id % 31 AS key,
  CASE event_type WHEN 'click' THEN 'insert' WHEN 'view' THEN 'get_or_insert' WHEN 'purchase' THEN 'pop_first' WHEN 'signup' THEN 'pop_last' ELSE 'remove' END AS op FROM events),
f AS (SELECT inst, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ks, CAST([] AS BIGINT[]) AS vs, CAST(NULL AS BIGINT) AS old, CAST(0 AS BIGINT) AS had FROM (SELECT DISTINCT inst FROM l)
  UNION ALL SELECT inst, rn,
    CASE WHEN op IN ('insert', 'get_or_insert') THEN CASE WHEN pos IS NULL AND len(ks) < 6 THEN list_append(ks, key) ELSE ks END WHEN pos IS NULL THEN ks ELSE ks[1:pos - 1] || ks[pos + 1:len(ks)] END,
    CASE WHEN op IN ('insert', 'get_or_insert') THEN CASE WHEN pos IS NULL THEN CASE WHEN len(ks) < 6 THEN list_append(vs, seq) ELSE vs END WHEN op = 'insert' THEN vs[1:pos - 1] || [seq] || vs[pos + 1:len(vs)] ELSE vs END
      WHEN pos IS NULL THEN vs ELSE vs[1:pos - 1] || vs[pos + 1:len(vs)] END, vs[pos], len(ks)
  FROM (SELECT l.*, ks, vs, nullif(coalesce(list_position(ks, CASE op WHEN 'pop_first' THEN list_min(ks) WHEN 'pop_last' THEN list_max(ks) ELSE key END), 0), 0) AS pos FROM f JOIN l ON l.inst = f.inst AND l.rn = f.rn + 1))
SELECT l.inst, seq, op, CASE WHEN op IN ('insert', 'get_or_insert') THEN CASE WHEN old IS NULL AND had >= 6 THEN 'full' ELSE 'ok' END
    WHEN old IS NOT NULL THEN 'ok' WHEN op = 'remove' THEN 'missing' ELSE 'empty' END AS status,
  CASE WHEN old IS NOT NULL THEN old WHEN op = 'get_or_insert' OR (op = 'insert' AND had >= 6) THEN seq END AS value, CAST(len(ks) AS BIGINT) AS len
FROM f JOIN l ON l.inst = f.inst AND l.rn = f.rn""")
def map_bounded(spark, d):
    """Upserts into a bounded sorted map with pops."""
    ops = {"click": "insert", "view": "get_or_insert", "purchase": "pop_first", "error": "remove", "signup": "pop_last"}
    log = op_log(table(spark, d, "events"), c("user_id"), c("event_id"), ops, c("event_type"), key=c("event_id") % 31, value=c("event_id"))
    return folds.bounded_map(log, 6)


# -- slabs and keyed stores


@query("SELECT o_orderkey, (o_custkey << 32) | o_orderkey AS key, o_custkey AS slab, o_orderkey AS slot FROM orders")
def slab_key_codec(spark, d):
    rows = _orders(spark, d).select("o_orderkey", keys.slab_key(c("o_custkey"), c("o_orderkey")).alias("key"))
    return rows.select("o_orderkey", "key", keys.slab_of("key").alias("slab"), keys.slot_of("key").alias("slot"))


@query("SELECT user_id, event_id, CAST(CASE WHEN n <= 64 THEN 64 - n END AS BIGINT) AS boxed, ((n - 1) // 16 << 32) | ((n - 1) % 16) AS slab, n <= 50 AS admitted FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def boxed_insert_keys(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", folds.boxed_insert_key("user_id", "event_id", 50).alias("boxed"), folds.slab_insert_key("user_id", "event_id", 16).alias("slab"), folds.admitted("user_id", "event_id", 50).alias("admitted"))


@query("SELECT event_type, user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def keyed_last_write(spark, d):
    return latest.latest(table(spark, d, "events").select("event_type", "user_id", "event_id", "value"), ["event_type", "user_id"], "event_id")


@query("SELECT c_nationkey, count(*) AS len FROM customer GROUP BY 1")
def keyed_len(spark, d):
    return keyed.size(table(spark, d, "customer"), "c_nationkey")


@query("SELECT o_orderkey, o_custkey AS c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def keyed_index(spark, d):
    customers = table(spark, d, "customer")
    probes = keyed.only(_orders(spark, d).select("o_orderkey", c("o_custkey").alias("c_custkey")), customers, "c_custkey")
    return keyed.index(customers, probes, "c_custkey", "c_name").select("o_orderkey", "c_custkey", "c_name")


def _slab_log(spark, d):
    rows = table(spark, d, "events").select(c("user_id").alias("inst"), c("event_id").alias("seq"), "event_type")
    rows = ordered.neighbours(rows, ["inst"], ["seq"], "seq")
    return rows.select("inst", "seq", F.when(c("event_type").isin("purchase", "error"), "remove").otherwise("insert").alias("op"), c("prev_key").alias("key"))


@query()
def slab_lifo_alloc(spark, d):
    """Inserts and removes on a slab store with slots reused: a fold, tested against a plain model."""
    return folds.slab(_slab_log(spark, d), 4)


@query("""WITH RECURSIVE l AS (SELECT user_id AS inst, event_id AS seq, event_type IN ('purchase', 'error') AS out, lag(event_id) OVER w AS prev, lag(event_type) OVER w AS pt, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT *, CASE WHEN NOT out THEN 1 WHEN prev IS NOT NULL AND pt NOT IN ('purchase', 'error') THEN -1 ELSE 0 END AS d FROM l),
s AS (SELECT inst, rn, sum(d) OVER (PARTITION BY inst ORDER BY rn) AS n FROM d)
SELECT inst, CAST(arg_max(n, rn) AS BIGINT) AS len, CAST(ceil(max(n) / 4) AS BIGINT) AS slab_count, CAST(ceil(max(n) / 4) * 4 AS BIGINT) AS capacity FROM s GROUP BY inst""")
def slab_statistics(spark, d):
    return folds.slab_statistics(folds.slab(_slab_log(spark, d), 4), 4)


@query("""WITH RECURSIVE l AS (SELECT user_id AS inst, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_id % 8 AS key, event_type IN ('purchase', 'error') AS rem FROM events),
f AS (SELECT inst, CAST(0 AS BIGINT) AS rn, CAST([0, 1, 2, 3, 4, 5, 6, 7] AS BIGINT[]) AS free, CAST([NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL] AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS taken, CAST(NULL AS BIGINT) AS old
  FROM (SELECT DISTINCT inst FROM l)
  UNION ALL SELECT inst, rn, CASE WHEN NOT rem THEN free[1:len(free) - 1] WHEN was IS NULL THEN free ELSE list_append(free, key) END,
    CASE WHEN rem THEN held[1:key] || [NULL] || held[key + 2:8] WHEN top IS NULL THEN held ELSE held[1:top] || [seq] || held[top + 2:8] END, top, was
  FROM (SELECT l.*, free, held, free[len(free)] AS top, held[key + 1] AS was FROM f JOIN l ON l.inst = f.inst AND l.rn = f.rn + 1))
SELECT l.inst, seq, CASE WHEN rem THEN 'remove' ELSE 'insert' END AS op, CASE WHEN rem THEN CASE WHEN old IS NULL THEN 'missing' ELSE 'ok' END WHEN taken IS NULL THEN 'full' ELSE 'ok' END AS status,
  CASE WHEN rem THEN old WHEN taken IS NULL THEN seq ELSE taken END AS value, CAST(8 - len(free) AS BIGINT) AS len
FROM f JOIN l ON l.inst = f.inst AND l.rn = f.rn""")
def boxed_lifo_alloc(spark, d):
    """Inserts and removes on a boxed store."""
    log = op_log(table(spark, d, "events"), c("user_id"), c("event_id"), {"click": "insert", "view": "insert", "signup": "insert", "purchase": "remove", "error": "remove"}, c("event_type"), key=c("event_id") % 8, value=c("event_id"))
    return folds.boxed(log, 8)
