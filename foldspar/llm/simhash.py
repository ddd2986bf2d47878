"""SimHash near-dedup with a segment-popcount embedding.

A fingerprint's 32 two-bit segments are mapped to their bit counts. The Manhattan distance of two such vectors is at
most the Hamming distance of the fingerprints; kept in unary, it is the bit count of an exclusive-or. Vectors within
distance 2 agree on at least three of five groups of segments, so each vector is put into the ten grid cells named by
three groups' counts; pairs that meet in a cell are first judged by the Manhattan bound, then by the exact distance.

Only distinct fingerprints enter the join, with the smallest doc_id of each. A cell with more than ``BUSY`` of them is
not paired out: its fingerprints are set out with their 64 one-bit neighbours instead, since two fingerprints differ in
at most two bits exactly if they share one of those, and at most 65 fingerprints do; that is linear in the cell. All
links together give the components.

Defined results: null text counts as empty; empty texts have fingerprint zero and link like any other; rows with null
doc_id belong to components but never name one (a component of such rows only has a null id); repeated rows share a
component; an empty table gives no rows; other columns are ignored by the query and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspar.llm.common import id_type, in_batches, materialise
from foldspar.llm.components import components

SHINGLE, SEED = 3, 42
BUSY = 64
_ODD = 0x5555555555555555
#: The segments (two bits each) of the five groups.
_GROUPS = [range(0, 7), range(7, 14), range(14, 20), range(20, 26), range(26, 32)]


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of k words (of all words if there are fewer), A-Z lower-cased, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-k] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """ident and fp (a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(shingle_hashes(x, k)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=[ident, "fp"])

    return in_batches(docs.select(ident, text), run, f"{ident} {id_type(docs, ident)}, fp long")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def embedded(fp: Column) -> Column:
    """The bit counts of the two-bit segments in unary: 00, 01 or 11."""
    low, high = fp.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _cells(points: DataFrame) -> DataFrame:
    masks = [_signed(sum(3 << 2 * s for g in some for s in g)) for some in combinations(_GROUPS, 3)]
    places = F.array(*[F.struct(F.lit(i).cast("byte").alias("grid"), F.col("v").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])
    return points.withColumn("v", embedded(F.col("fp"))).select("fp", "v", F.explode(places).alias("at")).select("fp", "v", "at.grid", "at.cell")


def links(points: DataFrame) -> DataFrame:
    """Pairs a, b of the distinct values fp of points that differ in at most two bits: all of them, or, where a cell is busy, enough to connect what they connect."""
    cells = _cells(points)
    # written first, so that the join reads plain exchanges, whose hot parts can be split; so are the grouped sides below
    sizes = materialise(cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
    shared = materialise(cells.join(sizes, ["grid", "cell"]), "simhash-cells")
    some = shared.where(F.col("n") <= BUSY)
    x, y = some.alias("x"), some.alias("y")
    close = (F.bit_count(F.col("x.v").bitwiseXOR(F.col("y.v"))) <= 2) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2)
    paired = x.join(y, (F.col("x.grid") == F.col("y.grid")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") > F.col("y.fp")) & close)
    paired = paired.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    around = shared.where(F.col("n") > BUSY).select("fp").distinct().select("fp", F.explode(flips).alias("z"))
    met = around.groupBy("z").agg(F.collect_set("fp").alias("some")).where(F.size("some") > 1)  # at most 65
    hung = met.select(F.explode("some").alias("a"), F.array_min("some").alias("b")).where("a <> b")
    return paired.unionByName(hung).distinct()


def grouped(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The contract's columns for every document: doc_id, fingerprint and component_id."""
    rows = materialise(fingerprints(docs, k=k), "simhash-fingerprints")
    points = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    roots = components(links(points))
    named = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(least, "root").select(F.col("fp").alias("n_fp"), "component_id"), "simhash-named")
    rows = rows.join(named, rows["fp"] == named["n_fp"])
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by similarity.
#
# 1. The method above, on fingerprints of the whole text: embedding, grid cells, Manhattan bound, exact distance. Those
#    within two bits are candidates. They catch copies with very few changes only.
# 2. For a similarity of 0.8 the same fingerprints are taken of samples: the SAMPLE shingles that are least under one of
#    SKETCHES permutations. Texts of similarity s agree on a sample, and so on its fingerprint, with probability near
#    s ** SAMPLE. (Other samples differ in some twelve bits, so only equal ones are of use.) Each row is a candidate with
#    the first of its bucket.
# 3. Where that leaves a bucket in several components, its rows are joined by their rarest shingles: of two sets with the
#    similarity t, in any order of all shingles, the first common one is among the first n - ceil(t n) + 1 of either,
#    and from it on both have t / (1 + t) of the sizes' sum left. With the frequent ones last, that of rows which only
#    share a passage is in none of them. No such pair is lost.
#
# Candidates are linked if the share of equal minima in BINS bins reaches the similarity.

SKETCHES, SAMPLE, BINS = 24, 4, 2048
#: Rows of a run of one shingle that are compared with the others at a time.
CHUNK = 256
#: Rows of apart buckets that hold a shingle from which it counts as frequent.
FREQUENT = 64
_rng = np.random.default_rng(20)
_XOR, _MUL = (_rng.integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def _sampled(h: np.ndarray, first: int, last: int) -> np.ndarray:
    """The SAMPLE values of h that are least under each of some permutations."""
    x, m = _XOR[first:last, None], _MUL[first:last, None]
    p = (h[None, :] ^ x) * m
    p ^= p >> np.uint64(32)
    return h[np.argpartition(p * m, SAMPLE, axis=1)[:, :SAMPLE]]


def sketch(text: str | None, k: int = 5) -> tuple[list[int], bytes, int, bytes]:
    """SKETCHES fingerprints of samples of the text's shingles, a byte for the least of each bin (0: none), the fingerprint of all, a digest of their set."""
    every = shingle_hashes(text, k)
    h = np.unique(every)
    digest = xxhash.xxh3_128_digest(h.tobytes())
    if not len(h):
        return [0] * SKETCHES, bytes(BINS), 0, digest
    if len(h) <= SAMPLE:
        picked = np.broadcast_to(h, (SKETCHES, len(h)))
    else:
        step = max(1, (1 << 17) // len(h))  # permutations at a time, so that a long text takes no more memory
        picked = np.concatenate([_sampled(h, at, at + step) for at in range(0, SKETCHES, step)])
    sized = picked.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(picked).view(np.uint8).reshape(SKETCHES, sized, 8), axis=2, bitorder="little").sum(axis=1)
    prints = np.packbits(2 * bits > sized, axis=1, bitorder="little").view(np.int64).ravel().tolist()
    at = np.searchsorted(h, _EDGES)
    inside = at < np.append(at[1:], len(h))
    value = ((h[np.minimum(at, len(h) - 1)] >> np.uint64(16)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return prints, np.where(inside, value, 0).astype(np.uint8).tobytes(), fingerprint(every), digest


def _share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of equal minima in the bins that either has, row by row."""
    either = ((x > 0) | (y > 0)).sum(axis=-1)
    same = ((x == y) & (x > 0)).sum(axis=-1)
    return np.where(either > 0, same / np.maximum(either, 1), 1.0)


def _bins(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share = _share(_bins(batch.column(2)), _bins(batch.column(3)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], names=["a", "b", "share"])


def _linked(pairs: DataFrame, bins: DataFrame, least: float) -> DataFrame:
    """a and b of the pairs a, b of rows whose estimated similarity is least or more."""
    pairs = pairs.join(bins, pairs["a"] == bins["r"]).select("a", "b", F.col("bins").alias("x"))
    pairs = pairs.join(bins, pairs["b"] == bins["r"]).select("a", "b", "x", F.col("bins").alias("y"))
    return materialise(in_batches(pairs, _similar, "a long, b long, share double").where(F.col("share") >= least).select("a", "b"), "simhash-linked")


def _near_prints(made: DataFrame) -> DataFrame:
    """Pairs a, b of rows by the fingerprints of whole texts: each row with the first one of an equal fingerprint, and first ones within two bits."""
    points = materialise(made.groupBy("whole").agg(F.min("row").alias("first")), "simhash-points")
    same = made.select("row", "whole").join(points, "whole").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    near = links(points.select(F.col("whole").alias("fp")))
    for end in ("a", "b"):
        near = near.join(points.select(F.col("whole").alias(end), F.col("first").alias(f"row_{end}")), end)
    return same.unionByName(near.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")))


def one_of_each(docs: DataFrame, k: int = 5, similarity: float = 0.8, slack: float = 0.01, text: str = "text") -> DataFrame:
    """docs without the rows that are linked, directly or through others, to an earlier row.

    Links take shingles of k words and an estimated similarity of at least ``similarity - slack`` (the estimate's
    standard error is at most 0.01, for texts of many thousand shingles, and vanishes for short ones).
    """
    base = materialise(docs.withColumn("__sim_row", F.monotonically_increasing_id()), "simhash-documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(x, k) for x in batch.column(1).to_pylist()]
            kinds = (pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in made], kind) for i, kind in enumerate(kinds))], names=["row", "prints", "bins", "whole", "digest"])

    texts = base.select("__sim_row", text)
    made = materialise(in_batches(texts, run, "row long, prints array<long>, bins binary, whole long, digest binary"), "simhash-sketches")
    spots = made.select("row", F.posexplode("prints").alias("j", "fp")).withColumn("j", F.col("j").cast("byte"))
    first = materialise(spots.groupBy("j", "fp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-first")
    shared = materialise(spots.join(first, ["j", "fp"]), "simhash-shared")
    pairs = shared.where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    bins = made.select(F.col("row").alias("r"), "bins")
    least = similarity - slack
    roots = components(_linked(pairs.unionByName(_near_prints(made)).distinct(), bins, least))
    runs = _prefixes(_apart(shared.where("n > 2"), roots, made), texts, k, least - slack)
    # the likeliest first: what they connect is not paired out
    for every in (False, True):
        found = materialise(_candidates(runs, roots, least - slack, every), "simhash-candidates")
        roots = _merged(roots, _linked(found, bins, least))
    gone = roots.select(F.col("node").alias("__sim_node"))
    return base.join(gone, base["__sim_row"] == gone["__sim_node"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _merged(roots: DataFrame, linked: DataFrame) -> DataFrame:
    """roots after their components are joined by the links a, b between rows."""
    for end in ("a", "b"):
        named = roots.select(F.col("node").alias("was"), F.col("root").alias("now"))
        linked = linked.join(named, linked[end] == named["was"], "left").withColumn(end, F.coalesce("now", end)).drop("was", "now")
    more = components(linked).select(F.col("node").alias("was"), F.col("root").alias("now"))
    kept = roots.join(more, roots["root"] == more["was"], "left").select("node", F.coalesce("now", "root").alias("root"))
    return materialise(kept.unionByName(more.select(F.col("was").alias("node"), F.col("now").alias("root"))), "simhash-roots")


def _apart(shared: DataFrame, roots: DataFrame, made: DataFrame) -> DataFrame:
    """The rows of buckets that lie in several components; of rows of a component with the same shingles one."""
    labelled = shared.join(roots, shared["row"] == roots["node"], "left").select("j", "fp", "row", F.coalesce("root", "row").alias("label"))
    labelled = materialise(labelled, "simhash-labelled")
    apart = labelled.groupBy("j", "fp").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("j", "fp")
    rows = labelled.join(materialise(apart, "simhash-apart"), ["j", "fp"], "left_semi").select("row", "label").distinct()
    rows = rows.join(made.select("row", "digest"), "row").groupBy("label", "digest").agg(F.min("row").alias("row"))
    return materialise(rows.select("row"), "simhash-apart-rows")


def _prefixes(rows: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """w, row, n, pos: the shingles w that the prefixes of at least two of the rows hold; n: how many the row has, pos: its place in their order."""
    ident, text = texts.columns
    some = materialise(texts.join(rows, texts[ident] == rows["row"], "left_semi"), "simhash-apart-texts")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(np.unique(shingle_hashes(x, k)) for batch in batches for x in batch.column(1).to_pylist()):
            h, n = np.unique(held, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

    # near counts do, as any order that all rows share is right
    counts = in_batches(some, counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).toArrow()
    often, times = counts.column("h").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    by_hash = np.argsort(often)
    known = rows.sparkSession.sparkContext.broadcast((often[by_hash], times[by_hash]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for row, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.unique(shingle_hashes(x, k))
                if len(h):
                    prefix = h[np.lexsort((h, _times(h, *known.value)))][: len(h) - ceil(least * len(h) - 1e-9) + 1]
                    parts.append((prefix.view(np.int64), np.full(len(prefix), row), np.full(len(prefix), len(h)), np.arange(len(prefix))))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True)], names=["w", "row", "n", "pos"])

    found = materialise(in_batches(some, cut, "w long, row long, n long, pos long"), "simhash-prefixes")
    twice = materialise(found.groupBy("w").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("w"), "simhash-twice")
    return materialise(found.join(twice, "w", "left_semi"), "simhash-runs")


def _gathered(arrays: Iterator[np.ndarray], most: int = 1 << 22) -> Iterator[np.ndarray]:
    """The arrays one after the other, in pieces of about most values."""
    held, size = [], 0
    for x in arrays:
        held.append(x)
        size += len(x)
        if size >= most:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _times(h: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often the frequent ones of h occur, 0 for the others; often is sorted."""
    if not len(often):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
    return np.where(often[at] == h, times[at], 0)


def _candidates(runs: DataFrame, roots: DataFrame, least: float, every: bool) -> DataFrame:
    """Pairs a, b of rows of different components that have a shingle of their prefixes in common and, from it on, may reach least.

    Of a run of rows with the same shingle all such pairs, or those with the row that has most of its shingles left.
    """
    rows = runs.join(roots, runs["row"] == roots["node"], "left").select("w", "row", "n", "pos", F.coalesce("root", "row").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if batch.column(0)[-1] == held[0].column(0)[0]:
                continue  # still the same run
            table = pa.Table.from_batches(held)
            w = table.column(0).to_numpy()
            done = int(np.searchsorted(w, w[-1]))  # the last one may go on in the next batch
            yield from _paired(table.slice(0, done), least, every)
            held = table.slice(done).combine_chunks().to_batches()
        if held:
            yield from _paired(pa.Table.from_batches(held), least, every)

    return rows.repartition("w").sortWithinPartitions("w").mapInArrow(run, "a long, b long").distinct()


def _paired(table: pa.Table, least: float, every: bool) -> Iterator[pa.RecordBatch]:
    """The candidates of whole runs."""
    w, row, n, pos, label = (x.to_numpy() for x in table.columns)
    start = np.concatenate([[0], np.flatnonzero(w[1:] != w[:-1]) + 1])
    end = np.append(start[1:], len(w))
    apart = np.flatnonzero(np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for s, e in zip(start[apart].tolist(), end[apart].tolist(), strict=True):
        r, own, size = row[s:e], label[s:e], n[s:e]
        left = size - pos[s:e]
        if every:
            values, counts = np.unique(own, return_counts=True)
            large = values[np.argmax(counts)]
            some = np.flatnonzero(own != large)
        else:
            large, some = None, np.array([np.argmax(left / size)])
        for at in range(0, len(some), CHUNK):
            i = some[at : at + CHUNK, None]
            # the common ones from here on are as many at most as either has left
            may = (own[i] != own) & (np.minimum(left[i], left) >= least / (1 + least) * (size[i] + size) - 1e-6)
            x, y = np.nonzero(may & ((own == large) | (r[i] > r)) if every else may)
            out.append((r[i[x, 0]], r[y]))
            if sum(len(a) for a, _ in out[-64:]) > 1 << 16:
                yield _two(out)
                out = []
    if out:
        yield _two(out)


def _two(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*pairs, strict=True)], names=["a", "b"])
