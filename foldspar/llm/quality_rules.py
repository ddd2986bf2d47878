"""Quality rules and robust multivariate outliers, in native expressions.

Every text gets word and line statistics in one row-local pass; transformed ratios of them form a vector, and for each
language and source a minimum-covariance-determinant estimate gives the centre and the scatter against which the row's
squared Mahalanobis distance is judged. It is sought from three starts (medians with median deviations, mean with
covariance, medians with the scatter of directions) by concentration steps on the closest half of the distinct vectors;
after two steps the start with the least determinant goes on until it stops falling, then all rows but far ones are
taken. Junk of up to nearly half of a group's distinct vectors does not move it.

The vector's parts vary in clean prose, so their scatter comes from the data: mean word length, signs per character,
variety of words and share of short words, each with ``PRIOR`` words of usual prose added so that short texts, whose
ratios are noise, lie near the middle. A least standard deviation of ``LEAST`` only keeps matrices regular.

A group's estimate is drawn towards the one over all rows with the weight of ``SHRINK`` rows, so that small groups need
no rule of their own; a twentieth of the overall scatter is always in it, so that a group of near copies is no point.

Defined results: null or empty text has no words, so the base rule fails it; null language or source is a group of its
own; repeated rows are judged alike and count once in the estimates; a table with fewer than five distinct vectors for
each part of the vector defines no estimate, so only the base rules reject there; an empty table gives an empty result;
further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspar.llm.common import NOT_SPACE, materialise, text_or_empty, words

#: The vector's parts.
PARTS = ("word_length", "signs", "variety", "short_words")
#: Words of usual prose that are added to each text, and their characters, signs a character and share of short words.
PRIOR, PRIOR_CHARS, PRIOR_SIGNS, PRIOR_SHORT = 100, 5.0, 0.03, 0.3
PRIOR_SIZE = 20
LEAST = 1e-3
SHRINK, ALWAYS = 50, 0.05
STARTS = 3
#: Longest word that counts as short.
SHORT = 3
SYMBOLS = r"[#*$%&|<>]"
LONGEST = 2**30
D = len(PARTS)


def chi_square(tail: float, d: int = D) -> float:
    """Upper quantile of the chi-square distribution with an even number of degrees of freedom, by bisection."""
    upper = lambda x: exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(d // 2))
    low, high = 0.0, 2000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) > tail else (low, mid)
    return low


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_signs, n_short, n_distinct, their names after prefix."""
    p, t = f"{prefix}_s_", text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
    df = df.withColumns({f"{p}w": words(t), f"{p}l": lines})
    w = F.col(f"{p}w")
    df = df.withColumn(f"{p}h", F.transform(w, lambda x: F.xxhash64(x)))
    windows = F.col(f"{p}h")
    df = df.withColumn(f"{p}d", F.size(F.array_distinct(windows)))
    for span in (1, 2, 4):  # a hash of 2, 4, then 8 words from each place on
        windows = F.zip_with(windows, F.slice(windows, span + 1, LONGEST), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(f"{p}h", windows)
        windows = F.col(f"{p}h")
    df = df.withColumn(f"{p}h", F.slice(windows, 1, F.greatest(F.size(w) - 7, F.lit(0))))
    h = F.col(f"{p}h")
    repeated = F.size(F.array_distinct(h)) < F.size(h)
    df = df.withColumn(f"{p}r", F.when(repeated, _covered(h)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn(f"{p}j", F.array_join(w, ""))
    return df.withColumns(
        {
            f"{prefix}n_words": F.size(w).cast("long"),
            f"{prefix}word_chars": F.length(f"{p}j").cast("long"),
            f"{prefix}n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            f"{prefix}n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long"),
            f"{prefix}n_repeat_words": F.col(f"{p}r"),
            f"{prefix}n_signs": F.length(F.regexp_replace(f"{p}j", r"[\p{L}\p{M}\p{N}]+", "")).cast("long"),
            f"{prefix}n_short": F.size(F.filter(w, lambda x: F.length(x) <= SHORT)).cast("long"),
            f"{prefix}n_distinct": F.col(f"{p}d").cast("long"),
        }
    ).drop(*(f"{p}{x}" for x in "wlhrdj"))


def _covered(h: Column) -> Column:
    """Words in the windows whose hash occurs twice or more in the array: a sort brings equal hashes together."""
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    alone = lambda s, x, j: F.coalesce(x["h"] != F.get(s, j - 1)["h"], F.lit(True)) & F.coalesce(x["h"] != F.get(s, j + 1)["h"], F.lit(True))
    return F.aggregate(
        F.array(placed),
        F.lit(0),
        lambda _, s: F.aggregate(
            F.sort_array(F.transform(F.filter(s, lambda x, j: ~alone(s, x, j)), lambda x: x["i"])),
            F.struct(F.lit(-8).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(8), i - a["last"])).alias("n")),
            lambda a: a["n"],
        ),
    )


def _vector(prefix: str) -> dict[str, Column]:
    c = lambda x: F.col(f"{prefix}{x}").cast("double")
    n, chars = c("n_words") + float(PRIOR), c("word_chars") + PRIOR * PRIOR_CHARS
    return {
        "word_length": F.log(chars / n),
        "signs": F.log((c("n_signs") + PRIOR * PRIOR_CHARS * PRIOR_SIGNS) / chars),
        "variety": F.log(c("n_distinct") + float(PRIOR_SIZE)) / F.log(c("n_words") + float(PRIOR_SIZE)),
        "short_words": (c("n_short") + PRIOR * PRIOR_SHORT) / n,
    }


def _distance(x: list[Column], estimate: str) -> Column:
    """Squared Mahalanobis distance of x by the struct column estimate (its m, and its lower inverse factor v)."""
    e, total = F.col(estimate), F.lit(0.0)
    for i in range(D):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + e["v"][i * D + j] * (x[j] - e["m"][j])
        total = total + row * row
    return total


def _scatter(m: Column, s: Column, scale: float) -> Column:
    """From means m and mean products s the scaled covariance with the least variances on its diagonal."""
    return F.array(*[(s[i * D + j] - m[i] * m[j]) * F.lit(scale) + F.lit(LEAST**2 if i == j else 0.0) for i in range(D) for j in range(D)])


def _factored(df: DataFrame) -> DataFrame:
    """Adds e, a struct of the columns m and c (the scatter) and the inverse of c's Cholesky factor, v; and det, c's determinant."""
    low: dict = {}
    for j in range(D):  # a column of the factor at a time
        rest = {i: F.col("c")[i * D + j] - sum((low[i, k] * low[j, k] for k in range(j)), F.lit(0.0)) for i in range(j, D)}
        root = F.sqrt(F.greatest(rest[j], F.lit(1e-12)))
        df = df.withColumns({f"l{i}{j}": root if i == j else rest[i] / root for i in rest})
        low |= {(i, j): F.col(f"l{i}{j}") for i in rest}
    inverse: dict = {}
    for i in range(D):  # a row of the inverse at a time
        row = {j: (F.lit(1.0 if i == j else 0.0) - sum((low[i, k] * inverse[k, j] for k in range(j, i)), F.lit(0.0))) / low[i, i] for j in range(i + 1)}
        df = df.withColumns({f"v{i}{j}": value for j, value in row.items()})
        inverse |= {(i, j): F.col(f"v{i}{j}") for j in row}
    v = F.array(*[inverse.get((i, j), F.lit(0.0)) for i in range(D) for j in range(D)])
    det = F.lit(1.0)
    for i in range(D):
        det = det * low[i, i] * low[i, i]
    return df.withColumns({"e": F.struct("m", "c", v.alias("v")), "det": det})


def estimates(vectors: DataFrame, keys: list[str], keep: float = 0.5, reweight: float = 0.025) -> DataFrame:
    """MCD estimate e (m, c, v) of each group of keys over the columns x0.. of vectors; n is the group's rows.

    Each step keeps the share ``keep`` of a group's rows that lie closest and takes their mean and covariance anew; a
    step cannot raise the determinant, and the steps end when none falls by a twentieth any more. A last step takes all
    rows but those beyond the upper quantile ``reweight`` of the estimate. Groups are only ever aggregated, so a hot one
    is pre-aggregated where its rows lie.
    """
    x = [F.col(f"x{i}") for i in range(D)]
    g = [f"g_{k}" for k in keys]
    same = lambda a, b: _all(a[k].eqNullSafe(b[f"g_{k}"]) for k in keys)
    products = lambda y: F.array(*[F.avg(a * b) for a in y for b in y])
    middle = lambda c: F.percentile_approx(c, 0.5, 10_000)
    medians = vectors.groupBy(*keys).agg(F.array(*[middle(c) for c in x]).alias("m"), F.count(F.lit(1)).alias("n"))
    m = materialise(medians.select(*[F.col(k).alias(f"g_{k}") for k in keys], "m", "n"), "mcd-medians")
    off = vectors.join(m, same(vectors, m)).groupBy(*g).agg(F.first("m").alias("m"), F.first("n").alias("n"), F.array(*[middle(F.abs(x[i] - F.col("m")[i])) for i in range(D)]).alias("mad"))
    off = materialise(off.withColumn("mad", F.transform("mad", lambda y: F.greatest(y * 1.4826, F.lit(LEAST)))), "mcd-deviations")

    z = [(x[i] - F.col("m")[i]) / F.col("mad")[i] for i in range(D)]
    far = F.sqrt(sum((y * y for y in z), F.lit(1e-12)))
    moved = vectors.join(off, same(vectors, off)).groupBy(*g).agg(
        F.first("m").alias("m"), F.first("n").alias("n"), F.first("mad").alias("mad"), F.array(*[F.avg(c) for c in x]).alias("mean"), products(x).alias("s"), products([y / far for y in z]).alias("u")
    )
    at = lambda i, j: F.col("mad")[i] * F.col("mad")[j]
    plain = F.array(*[at(i, j) if i == j else F.lit(0.0) for i in range(D) for j in range(D)])
    turned = F.array(*[F.col("u")[i * D + j] * at(i, j) * D + F.lit(LEAST**2 if i == j else 0.0) for i in range(D) for j in range(D)])
    starts = F.array(F.struct(F.col("m"), plain.alias("c")), F.struct(F.col("mean").alias("m"), _scatter(F.col("mean"), F.col("s"), 1.0).alias("c")), F.struct(F.col("m"), turned.alias("c")))
    begun = moved.select(*g, "n", F.posexplode(starts).alias("start", "p")).select(*g, "n", "start", "p.m", "p.c")
    # a start's determinant is no step's outcome, so the first step may raise it
    e = materialise(_factored(begun).select(*g, "n", "start", "e", F.lit(float("inf")).alias("det")), "mcd-start")

    def stepped(cut: DataFrame, scale: float) -> DataFrame:
        kept = vectors.join(cut, same(vectors, cut)).where(_distance(x, "e") <= F.col("cut"))
        new = kept.groupBy(*g, "start").agg(F.array(*[F.avg(c) for c in x]).alias("m"), products(x).alias("s"), F.first("n").alias("n"), F.first("det").alias("was"))
        return _factored(new.withColumn("c", _scatter(F.col("m"), F.col("s"), scale)))

    steps, falling = 0, True
    while falling:
        near = vectors.join(e, same(vectors, e)).withColumn("d2", _distance(x, "e"))
        cut = near.groupBy(*g, "start").agg(F.percentile_approx("d2", keep, 10_000).alias("cut"), F.first("e").alias("e"), F.first("n").alias("n"), F.first("det").alias("det"))
        new = stepped(cut, consistency(keep))
        # det is the least so far, so each further step needs a group that falls below all its former ones
        new = new.select(*g, "n", "start", "e", F.least("det", "was").alias("det"), F.coalesce(F.col("det") < 0.95 * F.col("was"), F.lit(False)).alias("fell"))
        steps += 1
        if steps == 2:
            best = F.min_by(F.struct("start", "e", "fell"), F.struct("det", "start"))
            new = new.groupBy(*g, "n").agg(best.alias("b"), F.min("det").alias("det")).select(*g, "n", "b.start", "b.e", "det", F.lit(True).alias("fell"))
        e = materialise(new, "mcd-step")
        falling = not e.where("fell").isEmpty()
    last = stepped(e.withColumn("cut", F.lit(chi_square(reweight))), consistency(1 - reweight))
    return materialise(last.select(*g, "e", "n"), "mcd-reweighted")


def consistency(keep: float) -> float:
    """By it the covariance of the closest share keep of a normal sample in D dimensions is scaled."""
    half = chi_square(1 - keep) / 2
    return keep / (1 - exp(-half) * sum(half**i / factorial(i) for i in range(D // 2 + 1)))


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def drawn(groups: DataFrame, overall) -> DataFrame:
    """groups with e drawn towards the row overall's e: by SHRINK rows, and by the share ALWAYS of the scatter at least."""
    if overall is None or overall["n"] < 5 * D:
        return groups.withColumn("e", F.lit(None).cast(groups.schema["e"].dataType))
    m0, c0 = (F.array(*[F.lit(y) for y in overall["e"][k]]) for k in "mc")
    by = F.lit(float(SHRINK)) / (F.col("n") + SHRINK)
    more = F.greatest(by, F.lit(ALWAYS))
    m = F.zip_with(F.col("e.m"), m0, lambda a, b: a + by * (b - a))
    c = F.zip_with(F.col("e.c"), c0, lambda a, b: a + more * (b - a))
    return _factored(groups.withColumns({"m": m, "c": c}))


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_words: int = 20, max_repeat_percent: int = 30, tail: float = 1e-7, prefix: str = "fq_", keep_text: bool = True) -> DataFrame:
    """df (without its text unless keep_text) with the statistics, base_failed, distance and kept, their names after prefix.

    A row is rejected if a normal vector would lie as far with the probability ``tail`` only. The texts are read once:
    df with its statistics is written to the shared folder, the estimates are made from the narrow columns of that
    table, and the verdict is a join of it with the few estimates on language and source. Rows that the base rules fail
    are not estimated from.
    """
    p = prefix
    rows = with_statistics(df, text, p)
    failed = (F.col(f"{p}n_words") < min_words) | (100 * F.col(f"{p}n_repeat_words") > max_repeat_percent * F.col(f"{p}n_words"))
    rows = rows.withColumns({f"{p}base_failed": failed} | {f"{p}x{i}": c for i, c in enumerate(_vector(p).values())})
    rows = materialise(rows if keep_text else rows.drop(text), "quality-statistics")
    xs = [F.col(f"{p}x{i}").alias(f"x{i}") for i in range(D)]
    own = F.struct(F.col(lang).alias("lang"), F.col(source).alias("source"), F.lit(False).alias("whole"))
    every = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(True).alias("whole"))
    narrow = rows.where(~F.col(f"{p}base_failed")).select(F.col(lang).cast("string").alias(lang), F.col(source).cast("string").alias(source), *xs).distinct()
    narrow = narrow.select(F.explode(F.array(own, every)).alias("g"), *[f"x{i}" for i in range(D)])
    vectors = materialise(narrow.select("g.*", *[f"x{i}" for i in range(D)]), "quality-vectors")
    found = estimates(vectors, ["lang", "source", "whole"])
    overall = found.where("g_whole").first()
    groups = materialise(drawn(found.where(~F.col("g_whole")), overall).select(F.col("g_lang").alias(f"{p}g_lang"), F.col("g_source").alias(f"{p}g_source"), F.col("e").alias(f"{p}e")), "quality-estimates")
    same = F.col(lang).cast("string").eqNullSafe(F.col(f"{p}g_lang")) & F.col(source).cast("string").eqNullSafe(F.col(f"{p}g_source"))
    rows = rows.join(groups, same, "left").drop(f"{p}g_lang", f"{p}g_source")
    rows = rows.withColumn(f"{p}distance", _distance([F.col(f"{p}x{i}") for i in range(D)], f"{p}e"))
    far = F.coalesce(F.col(f"{p}distance") > chi_square(tail), F.lit(False))
    return rows.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & ~far).drop(f"{p}e", *[f"{p}x{i}" for i in range(D)])


def documents_judged(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    p = "fq_"
    out = judge(docs.select("doc_id", "text", "lang", "source"), prefix=p, keep_text=False)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return out.select("doc_id", *[F.col(f"{p}{n}").alias(n) for n in names])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules and the outlier test keep, with docs' columns."""
    return judge(docs, prefix="__fq_").where("__fq_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
