"""Mixing sources to target weights, in native expressions.

Words are counted per document and summed per source (partial sums first, so a hot source is no burden). Sources in
code-point order, null last, take the weights in turn. Their targets share ``share`` times all words in proportion to
the weights, none above ``cap`` times its source's words; what a capped source cannot take goes to the others. That
fixed point is found in one sort: with the sources ordered by cap * words / weight, a source is capped exactly if the
level that the budget reaches after capping all sources before it is at least its own ratio.

Each document is then emitted floor(rate) times, rate being target / words of its source, plus once more if a number
hashed from the seed and its doc_id lies below the fraction. The decision depends on nothing else, so reruns agree.

Defined results: null text has no words; a source without words has target and rate 0; a null source is a source of its
own; rows with equal doc_id share the draw; an empty table gives an empty result. The table of sources (one short row
each) passes through one sorting task; the documents never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspar.llm.common import NOT_SPACE, materialise, text_or_empty

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(NOT_SPACE + "+")).cast("long")


def targets(sized: DataFrame, source: str, size: str, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Columns mix_source, source_size and target, a row for each source of sized."""
    totals = sized.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last()))
    totals = totals.withColumn("place", place)
    totals = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1))
    every = Window.partitionBy(F.lit(0))
    by_ratio = every.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    s = F.col("source_size").cast("double")
    totals = totals.withColumns({"ratio": cap * s / F.col("weight"), "budget": share * F.sum(s).over(every), "all_weight": F.sum("weight").over(every)})
    totals = totals.withColumns({"before_size": F.coalesce(F.sum(s).over(by_ratio), F.lit(0.0)), "before_weight": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))})
    level = (F.col("budget") - cap * F.col("before_size")) / (F.col("all_weight") - F.col("before_weight"))
    totals = totals.withColumn("capped", F.col("ratio") <= level)
    free_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every)
    capped_size = F.sum(F.when(F.col("capped"), s).otherwise(0.0)).over(every)
    last = (F.col("budget") - cap * capped_size) / F.when(free_weight > 0, free_weight)
    return totals.select("mix_source", "source_size", F.when(F.col("capped"), cap * s).otherwise(last * F.col("weight")).alias("target"))


def draw(doc_id: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the document's id."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(doc_id: str, target: str = "target", source_size: str = "source_size", seed: str = SEED) -> Column:
    """How often a document is emitted, with its source's target and words in the columns so named."""
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    return (F.floor(rate) + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mixed(docs: DataFrame, **rules) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target and taken of every document."""
    sized = materialise(docs.select("doc_id", "source", n_words().alias("size")), "mixing-sizes")
    t = targets(sized, "source", "size", **rules)
    rows = sized.join(t, sized["source"].eqNullSafe(t["mix_source"]))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies("doc_id")).alias("taken"))


def emit(docs: DataFrame, **rules) -> DataFrame:
    """docs with each row as often as the mix takes it, numbered from 1 in mix_copy (underscores added if docs has that name)."""
    t = targets(docs.select("source", n_words().alias("__mix_size")), "source", "__mix_size", **rules)
    t = materialise(t.toDF("__mix_source", "__mix_words", "__mix_target"), "mixing-targets")
    rows = docs.join(t, F.col("source").eqNullSafe(F.col("__mix_source"))).withColumn("__mix_n", copies("doc_id", "__mix_target", "__mix_words")).where("__mix_n > 0")
    name = "mix_copy"
    while name in docs.columns:
        name += "_"
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), "__mix_n")).alias(name))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM totals),
ratios AS (SELECT *, 2.0::DOUBLE * s / w AS ratio, 1.5::DOUBLE * sum(s) OVER () AS budget, sum(w) OVER () AS all_w FROM weighed),
levels AS (
  SELECT *, (budget - 2.0::DOUBLE * coalesce(sum(s) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS level FROM ratios
  WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
last AS (
  SELECT (max(budget) - 2.0::DOUBLE * sum(CASE WHEN ratio <= level THEN s ELSE 0 END)) / nullif(sum(CASE WHEN ratio <= level THEN 0 ELSE w END), 0) AS l FROM levels),
targets AS (SELECT source, s, CASE WHEN ratio <= level THEN 2.0::DOUBLE * s ELSE l * w END AS target FROM levels, last),
rated AS (
  SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
