"""URL filters: fixed host and path rules, then association rules mined with FP-growth, in native expressions.

URLs become sets of tokens (host labels, path words, query names). From a bounded sample of labelled pages, whose
transactions hold the tokens and an item for a bad label, FP-growth mines the combinations that imply the bad label;
those with enough support and confidence, and no shorter rule inside them that is as sure, are the filter. Each rule is
posted once in an inverted index, under its rarest token; a URL's tokens look up rules there and a found rule's whole
antecedent is verified. Every distinct URL is matched once, so a URL that many pages share is no burden.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; with few
labelled rows no rule is mined and every url is allowed that no fixed rule blocks; repeated rows are judged alike;
null page ids count as unlabelled; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspar.llm.common import about, materialise

#: (verdict, host, path): fixed values of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BAD = "#bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed(host: str, path: str, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct of rule and verdict by the longest rule that fits the columns host and path, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: str, host: str, path: str) -> Column:
    """Distinct tokens: h: labels of the host, p: words of the path with digits as 0, q: names in the query."""
    names = F.split(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\?([^#]*)", 1), "&")
    parts = [
        F.transform(F.split(F.col(host), r"\."), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.split(F.col(path), "[/._-]+"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), "[0-9]+", "0"))),
        F.transform(names, lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))),
    ]
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, max_rows: int = 20_000, min_support: float = 0.002, min_confidence: float = 0.8, min_count: int = 20) -> DataFrame | None:
    """Rules (antecedent, token, confidence, support) from rows with tokens and bad; None without rows.

    At most about max_rows rows are mined, the share with the smallest hashes. A rule needs the support min_support and
    min_count rows, so that a few rows show nothing.
    """
    n = labelled.count()
    if n < min_count:
        return None
    min_support = max(min_support, min_count / min(n, max_rows))
    rows = labelled.where(about(max_rows, n, "page_id", "tokens"))
    rows = materialise(rows.select(F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0), "url-transactions")
    if rows.isEmpty():
        return None
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support")
    rules = materialise(rules, "url-rules")
    short = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("sure"))
    posted = rules.withColumn("first", F.explode("antecedent"))
    inner = short.withColumn("first", F.explode("part")).join(posted, "first").where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("sure") >= F.col("confidence")))
    rules = rules.join(inner.select("antecedent").distinct(), "antecedent", "left_anti")
    often = rows.select(F.explode("items").alias("token")).groupBy("token").count()
    rarest = rules.withColumn("token", F.explode("antecedent")).join(often, "token").groupBy("antecedent", "confidence", "support").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    return materialise(rarest, "url-index")


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **mining) -> DataFrame:
    """The contract's columns for every page: page_id, host, path, rule and verdict.

    A page is labelled by the row of labels with its page_id as doc_id; quality 0 or toxic 1 is a bad label.
    """
    rows = pages.select("page_id", "url", host().alias("host"), path().alias("path"))
    rows = rows.withColumn("fixed", fixed("host", "path", rules))
    bad = labels.select(F.col("doc_id").alias("l_id"), F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).alias("bad"))
    labelled = materialise(rows.join(bad, rows["page_id"] == bad["l_id"]).select("page_id", tokens("url", "host", "path").alias("tokens"), "bad"), "url-labelled")
    mined = mine(labelled, **mining)
    if mined is None:
        blocked = F.lit(False)
    else:
        urls = rows.select("url").where("fixed is null").distinct().withColumns({"host": host(), "path": path()})
        urls = urls.select("url", tokens("url", "host", "path").alias("tokens")).withColumn("token", F.explode("tokens"))
        index = mined.select("token", "antecedent")
        hit = urls.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0).select(F.col("url").alias("b_url")).distinct().withColumn("hit", F.lit(True))
        hit = materialise(hit, "url-hits")  # so that the rows of a url that many pages share can be split
        rows = rows.join(hit, rows["url"] == hit["b_url"], "left")
        blocked = F.col("hit").isNotNull()
    method = F.when(blocked, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce(F.col("fixed.verdict"), method).alias("verdict"))
