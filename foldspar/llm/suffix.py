"""Suffix-array dedup of byte strings by prefix doubling over sampled positions.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed. Prefix doubling ranks the
suffixes by longer and longer prefixes and drops a position once its rank is unique. Here a rank is a hash name, the
pair of names at growing offsets gives the next name, and the rounds that Spark groups and sorts are at ``HALF`` and at
``LENGTH`` bytes. Positions are sampled so that the rounds are small: the ``LENGTH``-byte windows of a text choose the
place of the least ``HALF``-byte name in them, an anchor; equal windows choose equal anchors at equal offsets.

1. One row per anchor (its name, the windows that chose it, a name of all bytes those windows cover). Anchors whose
   ``HALF``-byte name is unique are dropped: none of their windows occurs twice.
2. Anchors are ranked by the pair of both names. Where the pair occurs again all their windows do, and are removed.
3. The few left (at the ends of repeated passages) and one of each ranked class with the same name are cut out of the
   texts, and each of their windows is ranked by its ``LENGTH``-byte name among those with the same anchor name: in
   sorted runs where a name has at most ``HOT`` members, else by an aggregation over the pairs of names.

Texts are hashed in pieces of ``PIECE`` windows; a piece's edge only moves anchors to the third round. Rows are numbered
in a written copy of the texts, so that neither equal nor colliding ids can mix the spans of two texts.

Defined results: text is its UTF-8 bytes, null is empty; texts shorter than LENGTH lose nothing; repeated rows are
copies of each other, so all of their bytes go if they are long enough; a null doc_id is an id like others; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspar.llm.common import id_type, in_batches, materialise, text_or_empty

LENGTH, HALF = 400, 200
HOT = 4096
PIECE = 1 << 21
_SPAN = 23  # bits for the number of windows after the first one; the first one's place lies above
_rng = np.random.default_rng(400)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    return x


def names(data: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each of the lengths (rising) the names of the strings of that length from each place on, by doubling."""
    h, n, level, out = _BYTE[data], 1, 0, []
    for length in lengths:
        while 2 * n <= length:
            h = _stir(h[:-n] * _ODD[level] + h[n:]) if len(h) > n else h[:0]
            n, level = 2 * n, level + 1
        rest = length - n  # the last pair overlaps
        out.append(h if not rest else _stir(h[:-rest] * _ODD[16 + level] + h[rest:]) if len(h) > rest else h[:0])
    return out


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values the place of the least one, the leftmost of equals."""
    at, n = np.arange(len(h), dtype=np.int32), 1
    while n < width:
        step = min(n, width - n)
        left = h[:-step] <= h[step:]
        at, h = np.where(left, at[:-step], at[step:]), np.where(left, h[:-step], h[step:])
        n += step
    return at


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arrays of an anchor each: its name, the pair's second name, the first window, the number of windows after it, weight.

    Neighbours with equal names (text that repeats byte by byte) are one entry of weight 2.
    """
    parts = []
    for start in range(0, len(data) - LENGTH + 1, PIECE):
        half, whole = names(data[start : start + PIECE + LENGTH - 1], HALF, LENGTH)
        at = least_places(half, LENGTH - HALF + 1)
        edge = np.flatnonzero(at[1:] != at[:-1]) + 1
        low, high = np.concatenate([[0], edge]), np.concatenate([edge - 1, [len(at) - 1]])
        name = half[at[low]]
        shape = ((high - low) * 1024 + at[low] - low).astype(np.uint64)
        cover = _stir(whole[low] * _ODD[28] + whole[high] * _ODD[29] + shape * _ODD[30])
        new = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (cover[1:] != cover[:-1])]))
        last = np.concatenate([new[1:] - 1, [len(name) - 1]])
        parts.append((name[new], cover[new], low[new] + start, high[last] - low[new], np.where(last > new, 2, 1)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts: list[list] = [[], [], [], [], []]
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            if len(data) >= LENGTH:
                name, cover, low, more, weight = anchors(data)
                for kept, x in zip(parts, (name, cover, np.full(len(name), row), (low << _SPAN) | more, weight), strict=True):
                    kept.append(x)
        if parts[0]:
            name, cover, row, spot, weight = (np.concatenate(x) for x in parts)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(cover.view(np.int64)), pa.array(row), pa.array(spot), pa.array(weight.astype(np.int32))], names=["name", "cover", "row", "spot", "weight"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed anchors' windows. Columns: row, text, wanted (list of name, spot, open, hot)."""
    for batch in batches:
        out: list[tuple] = []
        for row, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                low, more = w["spot"] >> _SPAN, w["spot"] & ((1 << _SPAN) - 1)
                out.append((w["name"], row, low, w["open"], w["hot"], data[low : low + more + LENGTH]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["name", "row", "low", "open", "hot", "bytes"])


def _windows(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the batch's cuts: the number of the cut, its place in it, its name."""
    cuts = batch.column("bytes").to_pylist()
    sizes = np.array([len(x) for x in cuts], np.int64)
    whole = names(np.frombuffer(b"".join(cuts), np.uint8), LENGTH)[0]
    starts, n = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(cuts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return owner, place, whole[starts[owner] + place]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extents of the repeated windows of open cuts; rows come sorted by anchor name, and whole names are judged at a time."""

    def judged(table: pa.Table) -> pa.RecordBatch:
        owner, place, name = _windows(table)
        group = np.array(table.column("name").to_pylist(), np.int64).view(np.uint64)
        _, at, count = np.unique(np.stack([group[owner], name], axis=1), axis=0, return_inverse=True, return_counts=True) if len(owner) else (0, owner, owner)
        open_ = np.array(table.column("open").to_pylist(), bool)
        hit = np.flatnonzero((count[at.ravel()] > 1) & open_[owner]) if len(owner) else owner
        new = np.concatenate([[True], (owner[hit][1:] != owner[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)]) if len(hit) else np.empty(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(hit) - 1]]) if len(hit) else first
        low = np.array(table.column("low").to_pylist(), np.int64)
        a, b = hit[first], hit[last]
        rows = np.array(table.column("row").to_pylist(), np.int64)[owner[a]]
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(low[owner[a]] + place[a]), pa.array(low[owner[b]] + place[b] + LENGTH)], names=["row", "start", "end"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        name = table.column("name").to_numpy()
        done = int(np.searchsorted(name, name[-1]))  # the last name may go on in the next batch
        if done:
            yield judged(table.slice(0, done))
        held = table.slice(done).combine_chunks().to_batches()
    if held:
        yield judged(pa.Table.from_batches(held))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, place, name = _windows(batch)
        take = pa.array(owner)
        start = pa.array(np.array(batch.column("low").to_pylist(), np.int64)[owner] + place) if len(owner) else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("name").take(take), pa.array(name.view(np.int64)), batch.column("row").take(take), start, batch.column("open").take(take)], names=["name", "whole", "row", "start", "open"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: doc_id, text, gone (list of start, end, or null)."""
    for batch in batches:
        out = []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            kept, removed, at = [], 0, 0
            runs: list[list[int]] = []
            for a, b in sorted((x["start"], x["end"]) for x in gone or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            for a, b in runs:
                kept.append(data[at:a])
                removed, at = removed + b - a, b
            kept.append(data[at:])
            rest = b"".join(kept)
            out.append((len(data), removed, len(runs), rest, rest.decode("utf-8", "replace")))
        numbers = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array([x[3] for x in out], pa.binary()), pa.array([x[4] for x in out], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text"])


def repeated(keyed: DataFrame) -> DataFrame:
    """row, start, end: extents that cover every repeated string of LENGTH bytes, for keyed's columns row and text.

    The numbers in row must differ.
    """
    found = materialise(in_batches(keyed.select("row", "text"), _anchored, "name long, cover long, row long, spot long, weight int"), "suffix-anchors")
    # each grouped side of a join by name is written first: the join then reads plain exchanges, whose hot parts can be split
    often = materialise(found.groupBy("name").agg(F.sum("weight").alias("n")).where("n > 1").select("name"), "suffix-often")
    shared = materialise(found.join(often, "name", "left_semi"), "suffix-half")
    classes = shared.groupBy("name", "cover").agg(F.sum("weight").alias("n"), F.min(F.struct("row", "spot")).alias("one"))
    classes = materialise(classes.select("name", "cover", "n", "one.row", "one.spot"), "suffix-ranks")
    extent = [F.shiftright("spot", _SPAN).alias("start"), (F.shiftright("spot", _SPAN) + F.col("spot").bitwiseAND(F.lit((1 << _SPAN) - 1)) + LENGTH).alias("end")]
    settled = shared.join(classes.where("n > 1").select("name", "cover"), ["name", "cover"], "left_semi").select("row", *extent)

    by_name = classes.groupBy("name").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("least = 1")
    by_name = materialise(by_name, "suffix-open")
    members = classes.join(by_name, "name").select("row", F.struct("name", "spot", (F.col("n") == 1).alias("open"), (F.col("m") > HOT).alias("hot")).alias("w"))
    wanted = members.groupBy("row").agg(F.collect_list("w").alias("wanted")).withColumnRenamed("row", "w_row")  # at most what the text holds
    texts = keyed.join(wanted, keyed["row"] == wanted["w_row"]).select("row", "text", "wanted")
    cuts = materialise(in_batches(texts, _cut, "name long, row long, low long, open boolean, hot boolean, bytes binary"), "suffix-cuts")
    few = cuts.where(~F.col("hot")).repartition("name").sortWithinPartitions("name")
    few = in_batches(few, _matched, "row long, start long, end long")
    many = in_batches(cuts.where("hot"), _exploded, "name long, whole long, row long, start long, open boolean")
    twice = many.groupBy("name", "whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "whole")
    twice = materialise(twice, "suffix-twice")
    many = many.join(twice, ["name", "whole"], "left_semi").where("open").select("row", "start", (F.col("start") + LENGTH).alias("end"))
    return settled.unionByName(few).unionByName(many)


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and text (these as text) of every document.

    In text a character that a span cuts through is shown as U+FFFD.
    """
    keyed = docs.select("doc_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    keyed = materialise(keyed, "suffix-texts")
    gone = repeated(keyed).groupBy(F.col("row").alias("g_row")).agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    rows = keyed.join(gone, keyed["row"] == gone["g_row"], "left").select("doc_id", "text", "gone")
    return in_batches(rows, _kept, f"doc_id {id_type(docs)}, n_bytes long, n_removed long, n_spans long, kept binary, text string")


def removed(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document, and the text that is left."""
    return cleaned(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")
