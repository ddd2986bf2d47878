"""Chat formatting with cumulative-snapshot collapse, in native expressions.

A chat log often holds a conversation several times, each snapshot longer by a few turns. Every turn gets its ordinal in
the conversation and a 128-bit hash of that, its role and its text; the running exclusive-or of these is a rolling hash
of each turn prefix. A conversation whose full hash is a proper prefix's hash in another is dropped by an anti-join, and
of equal conversations the smallest conv_id stays. What is left is rendered.

Ordinals come from one range sort of all turns without their texts, which splits a conversation of any length, whatever
its turn numbers: a turn's place in its partition and the counts of the partitions before it. Running values are formed in
blocks of ``BLOCK`` ordinals and then over the blocks, and each block is rendered as a part of its own, so no task gathers
a conversation, a null turn number or a null conv_id as a whole.

Defined results: turns go by turn number (null first), then role (null first), then the MD5 of the text (null first);
rows equal in all four columns count once; null role or text renders as empty; rows with null conv_id form one
conversation; an empty table gives no rows; other columns are ignored. Markers inside a text are broken up so that they
cannot open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspar.llm.common import materialise

BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>"
ORDER = ["conv_id", "turn", "role", "m"]
_PLACES = (1 << 33) - 1  # the part of monotonically_increasing_id() that counts within a partition


def _known(c: str) -> Column:
    """The column as text that tells null from empty."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def _key() -> list[Column]:
    """128 bits that name a turn: its conversation, number, role and text's MD5."""
    told = [_known(c) for c in ORDER]
    return [F.xxhash64(*told).alias("ka"), F.xxhash64(*reversed(told), F.lit(1)).alias("kb")]


def _hashed(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("m"), "text")


def _turns(conversations: DataFrame) -> DataFrame:
    """Each distinct turn without its text, with its ordinal n in its conversation and the block of that."""
    rows = _hashed(conversations).select(*ORDER).dropDuplicates()
    rows = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in ORDER]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in ORDER])
    place = F.monotonically_increasing_id()
    rows = materialise(rows.withColumn("at", place).withColumns({"slice": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit(_PLACES))}), "chat-turns")
    slices = rows.groupBy(F.col("conv_id").alias("s_conv"), F.col("slice").alias("s_slice")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("s_conv").orderBy("s_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = materialise(slices.select("s_conv", "s_slice", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first") + 1).alias("shift")), "chat-slices")
    rows = rows.join(slices, rows["conv_id"].eqNullSafe(slices["s_conv"]) & (rows["slice"] == slices["s_slice"]))
    n = F.col("at") + F.col("shift")
    return materialise(rows.select(*ORDER, n.alias("n"), F.floor((n - 1) / BLOCK).cast("long").alias("block")), "chat-ordinals")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n (turns in the prefix), a and b (its hash): a row for each prefix of each conversation."""
    told = [_known("role"), _known("m")]
    rows = turns.select("conv_id", "block", "n", F.xxhash64("n", *told).alias("a"), F.xxhash64(*reversed(told), "n").alias("b"))
    inside = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("b_conv").orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block")).agg(F.bit_xor("a").alias("ra"), F.bit_xor("b").alias("rb"))
    blocks = blocks.select("b_conv", "b_block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("ra", "rb")])
    blocks = materialise(blocks, "chat-blocks")
    rows = rows.withColumns({"a": F.bit_xor("a").over(inside), "b": F.bit_xor("b").over(inside)})
    rows = rows.join(blocks, rows["conv_id"].eqNullSafe(blocks["b_conv"]) & (rows["block"] == blocks["b_block"]))
    return rows.select("conv_id", "n", F.col("a").bitwiseXOR(F.col("ra")).alias("a"), F.col("b").bitwiseXOR(F.col("rb")).alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay, and n_equal, how many were equal to it, itself included."""
    length = materialise(turns.groupBy(F.col("conv_id").alias("l_conv")).agg(F.max("n").alias("length")), "chat-length")
    p = prefixes(turns)
    p = materialise(p.join(length, p["conv_id"].eqNullSafe(length["l_conv"])).drop("l_conv"), "chat-prefixes")
    whole = p.where("n = length").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    proper = p.where("n < length").groupBy("n", "a", "b").agg(F.count(F.lit(1)).alias("k"))
    return whole.join(proper, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_equal")


def _clean(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for marker in (START, END):
        out = F.replace(out, F.lit(marker), F.lit("< " + marker[1:]))
    return out


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_equal and rendered: the maximal conversations in parts of BLOCK turns each.

    Texts move to their turn's ordinal, repeated rows being one by then, and those that stay once more to their part.
    """
    turns = _turns(conversations)
    keep = materialise(maximal(turns).withColumnRenamed("conv_id", "m_conv"), "chat-kept")
    kept = turns.join(keep, turns["conv_id"].eqNullSafe(keep["m_conv"])).select(*_key(), "conv_id", "n", "block", "n_turns", "n_equal")
    kept = materialise(kept, "chat-places")
    texts = _hashed(conversations).select(*_key(), "role", "text").groupBy("ka", "kb").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    rows = texts.join(kept, ["ka", "kb"])
    # a key without nulls, by which groups are dealt
    same = [F.first(c).alias(c) for c in ("conv_id", "n_turns", "n_equal")]
    parts = rows.groupBy(_known("conv_id").alias("key"), "block").agg(F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("turns"), *same)
    one = lambda t: F.concat(F.lit(START), _clean(t["role"]), F.lit("\n"), _clean(t["text"]), F.lit(END + "\n"))
    return parts.select("conv_id", (F.col("block") + 1).alias("part"), "n_turns", "n_equal", F.array_join(F.transform("turns", one), "").alias("rendered"))


ORACLE = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS i FROM d),
c AS (SELECT conv_id, count(*) AS n, list(struct_pack(r := role, x := text) ORDER BY i) AS a FROM t GROUP BY conv_id),
kept AS (
  SELECT a, n, min(conv_id) AS conv_id, count(*) AS n_equal FROM c
  WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.n > c.n AND d.a[1:c.n] = c.a) GROUP BY a, n)
SELECT t.conv_id, (i - 1) // 256 + 1 AS part, max(n) AS n_turns, max(n_equal) AS n_equal,
  string_agg('<|im_start|>' || replace(replace(coalesce(role, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
    || replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY t.conv_id, (i - 1) // 256
"""
