"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters within k edits of a piece of text shares at least m - q + 1 - q * k of its q-grams with it, on
diagonals at most k apart. So the q-grams that a document shares with an item are counted in diagonal bands that
overlap by half; bands with enough of them give regions, and a banded alignment of the item with the region verifies
the edit distance. Text and items are compared lower-cased with white space runs as one space.

The benchmark is read in blocks of at most ``BLOCK`` characters (or one item), each block's index is broadcast and all
documents pass it in one scan; documents are never shuffled.

The budget shrinks with the length: items of under 22 characters match without edits only, and those of fewer than ``Q``
characters, which have no q-gram, by exact search.

Defined results: null or empty text matches nothing; null items and items that are empty after normalisation are passed
over; item_id may have any type; an item that occurs twice in the benchmark is reported under each of its rows; repeated
documents are each reported; empty tables give no matches; other columns are ignored or pass through. Offsets are code
points of the document as it stands, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foldspar.llm.common import id_type, in_batches

Q = 7
RATE = 0.10
BLOCK = 4_000_000
PIECE = 2_000_000
_BITS = 22
_RUN = re.compile(r"\S+")


def normalised(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def origins(text: str) -> np.ndarray:
    """For each character of normalised(text) the place in text that it comes from, and the text's length after the last."""
    out: list[int] = []
    grows = len(text.lower()) != len(text)  # a few capitals become two characters
    for m in _RUN.finditer(text):
        if out:
            out.append(m.start() - 1)  # the space
        out += [k for k in range(m.start(), m.end()) for _ in text[k].lower()] if grows else range(m.start(), m.end())
    return np.array([*out, len(text)], np.int64)


def located(text: str, start: int, end: int) -> tuple[int, int]:
    """The extent in text of the characters start..end of normalised(text)."""
    at = origins(text)
    return int(at[start]), int(at[end - 1]) + 1 if end > start else int(at[start])


def codes(text: str) -> np.ndarray:
    """A byte for each code point; equal characters have equal bytes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (points ^ (points >> 8) ^ (points >> 16)).astype(np.uint8)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """The q bytes from each place on as one number."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    out, n = c.astype(np.uint64), 1
    while n < q:
        step = min(n, q - n)
        out = out[:-step] | (out[step:] << np.uint64(8 * step))
        n += step
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


class Index:
    """The q-grams of a block of items with where they occur, and each item's budget, threshold and band width."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE):
        self.items = [(i, t) for i, x in items if (t := normalised(x))]
        m = np.array([len(t) for _, t in self.items], np.int64)
        self.budget = np.minimum((m * rate).astype(np.int64), np.maximum(0, (m - Q + 1 - 8) // Q))
        self.least = m - Q + 1 - Q * self.budget
        self.stride = 2 * self.budget + 1
        parts = [grams(codes(t)) for _, t in self.items]
        every = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.item, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.short: dict[int, dict[str, list[int]]] = {}  # items without a q-gram by length and text
        for i, (_, t) in enumerate(self.items):
            if len(t) < Q:
                self.short.setdefault(len(t), {}).setdefault(t, []).append(i)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[_slot(self.grams)] = True

    def regions(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(document, item, lowest diagonal of the band) where a band holds enough shared q-grams."""
        if not len(self.grams):
            return
        joined = "\x00".join(texts)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[: len(texts)]
        g = grams(codes(joined))
        at = np.flatnonzero(self.seen[_slot(g)])
        rank = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        same = self.grams[rank] == g[at]
        at, rank = at[same], rank[same]
        n = self.count[rank]
        if not n.sum():
            return
        posting = np.repeat(self.first[rank] - np.cumsum(n) + n, n) + np.arange(n.sum())
        doc = np.searchsorted(starts, at, side="right") - 1
        local = np.repeat(at - starts[doc], n)
        doc, item = np.repeat(doc, n), self.item[posting].astype(np.int64)
        # a diagonal below zero is one of a text that lacks the item's beginning; shifted by the item's length it is none
        longest = int(self.least.max() + Q * self.budget.max() + Q)
        shifted = (local - self.place[posting]).astype(np.int64)
        band = (shifted + longest) // self.stride[item] + 1
        width = int(band.max()) + 2
        key = (doc * len(self.items) + item) * width + band
        keys = np.concatenate([key, key - 1])
        values, count = np.unique(keys, return_counts=True)
        values = values[count >= self.least[values // width % len(self.items)]]
        if not len(values):
            return
        kept = np.flatnonzero(values[np.minimum(np.searchsorted(values, keys), len(values) - 1)] == keys)
        kept = kept[np.argsort(keys[kept], kind="stable")]
        first = np.searchsorted(keys[kept], values)
        for j, hits in enumerate(np.split(kept % len(key), first[1:])):
            pair, band_no = divmod(int(values[j]), width)
            d, i = divmod(pair, len(self.items))
            places, diagonals = self.place[posting[hits]], shifted[hits]
            if _enough(places, diagonals, int(self.stride[i]), int(self.least[i])):
                yield d, i, (band_no - 1) * int(self.stride[i]) - longest

    def exact(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, start, end) of each place of an item of fewer than Q characters."""
        if not self.short:
            return
        joined = "\x00".join(texts)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[: len(texts)]
        c = codes(joined)
        for n, items in self.short.items():
            for at in np.flatnonzero(np.isin(grams(c, n), np.concatenate([grams(codes(t), n) for t in items]))).tolist():
                d = int(np.searchsorted(starts, at, side="right")) - 1
                a = at - int(starts[d])
                for i in items.get(texts[d][a : a + n], ()):
                    yield d, i, a, a + n

    def matches(self, texts: list[str]) -> list[tuple[int, object, int, int, int, int]]:
        """(document, item id, start, end, distance, budget) in the normalised texts, the nearest of touching regions.

        Texts are taken together up to ``PIECE`` characters; a longer one goes in pieces that overlap by more than any
        match, and what two pieces find is reported once.
        """
        if not self.items:
            return []
        lap = 2 * max(len(t) + 4 * int(k) for (_, t), k in zip(self.items, self.budget, strict=True))
        found: set = set()
        held: list[tuple[int, int, str]] = []
        size = 0
        for d, text in enumerate(texts):
            for at in range(0, max(1, len(text) - lap), PIECE):
                held.append((d, at, text[at : at + PIECE + lap]))
                size += len(held[-1][2])
                if size >= PIECE:
                    found |= self._found(held)
                    held, size = [], 0
        return _apart(found | self._found(held))

    def _found(self, held: list[tuple[int, int, str]]) -> set:
        return {(held[d][0], i, held[d][1] + a, held[d][1] + b, distance, k, n) for d, i, a, b, distance, k, n in self._matches([t for _, _, t in held])} if held else set()

    def _matches(self, texts: list[str]) -> list[tuple]:
        found: dict = {}
        for d, i, low in self.regions(texts):
            ident, item = self.items[i]
            k, stride = int(self.budget[i]), int(self.stride[i])
            a, b = max(0, low - k), min(len(texts[d]), low + 2 * stride + len(item) + k)
            region = texts[d][a:b]
            if (exact := region.find(item)) >= 0:
                distance, end, start = 0, exact + len(item), exact
            else:
                distance, end = align(item, region, low - a - k, low - a + 2 * stride + k, k)
                if distance > k:
                    continue
                back = align(item[::-1], region[:end][::-1], -k - 1, k + 1)
                start = end - back[1]
            key = (d, i, (a + end) // max(1, len(item) // 2))
            found[key] = min(found.get(key, (10**9, 0, 0)), (distance, a + start, a + end))
        short = [(d, self.items[i][0], start, end, 0, 0, i) for d, i, start, end in self.exact(texts)]
        return short + [(d, self.items[i][0], start, end, distance, int(self.budget[i]), i) for (d, i, _), (distance, start, end) in found.items()]


def _apart(found: set) -> list[tuple]:
    """Of matches of one item that overlap in a document the nearest, the first of equals; without the item's number."""
    out: list = []
    for x in sorted(found, key=lambda x: (x[0], x[6], x[2], x[3])):
        if out and (out[-1][0], out[-1][6]) == (x[0], x[6]) and x[2] < out[-1][3]:
            if x[4] < out[-1][4]:
                out[-1] = x
        else:
            out.append(x)
    return [x[:6] for x in sorted(out, key=lambda x: (x[0], x[2], x[3], x[6]))]


def _enough(places: np.ndarray, diagonals: np.ndarray, width: int, least: int) -> bool:
    """Whether at least least places of the item are hit on width neighbouring diagonals."""
    if len(np.unique(places)) < least:
        return False
    order = np.argsort(diagonals, kind="stable")
    places, diagonals = places[order], diagonals[order]
    last = np.searchsorted(diagonals, diagonals + width)
    starts = np.flatnonzero(np.append(True, diagonals[1:] != diagonals[:-1]) & (last - np.arange(len(last)) >= least))
    return any(len(np.unique(places[a : last[a]])) >= least for a in starts)


def align(item: str, region: str, low: int, high: int, most: int | None = None) -> tuple[int, int]:
    """Least edit distance of item to a piece of region whose alignment keeps to the diagonals low..high, and its end.

    Of equally near pieces the first wins. Once no piece can be within most, the distance is only known to be larger.
    """
    x = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), np.uint32)
    y = np.frombuffer(region.encode("utf-32-le", "surrogatepass"), np.uint32)
    m, n, width = len(x), len(y), high - low + 1
    t = np.arange(width)
    far = m + n + 1
    column = t + low  # of the text, before row 0
    row = np.where((column >= 0) & (column <= n), 0, far).astype(np.int32)
    t32, low_far = t.astype(np.int32), np.int32(far)
    padded = np.full(n + 2 * (m + width) + abs(low) + abs(high) + 2, 0xFFFFFFFF, np.uint32)
    shift = m + width + abs(low)
    padded[shift : shift + n] = y
    for i in range(m):
        character = padded[shift + low + i : shift + low + i + width]
        step = row + (character != x[i])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        first, last = max(0, -low - i - 1), max(0, min(width, n - low - i))  # the diagonals whose column lies in the text
        step[:first], step[last:] = low_far, low_far
        row = np.minimum.accumulate(step - t32) + t32
        row[last:] = low_far
        if most is not None and i % 8 == 7 and row.min() > most:
            return int(row.min()), 0
    best = int(row.argmin())
    return int(row[best]), best + low + m


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items, dealt by hash to blocks; one block at a time is fetched and indexed."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, ceil(total / BLOCK))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end, distance and budget of each place where a document holds an item within the budget."""
    context = docs.sparkSession.sparkContext
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def passed(items) -> DataFrame:
        index = context.broadcast(Index(items, rate))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                found = index.value.matches([normalised(x) for x in texts])
                spots = [located(texts[x[0]], x[2], x[3]) for x in found]
                ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                numbers = [pa.array(x, pa.int64()) for x in ([a for a, _ in spots], [b for _, b in spots], [x[4] for x in found], [x[5] for x in found])]
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], kind), *numbers], names=["doc_id", "item_id", "start", "end", "distance", "budget"])

        return in_batches(docs.select("doc_id", "text"), run, f"doc_id {id_type(docs)}, item_id {id_type(benchmark, 'item_id')}, start long, end long, distance long, budget long")

    return reduce(DataFrame.unionByName, [passed(items) for items in _blocks(benchmark)])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of docs that hold no item of the benchmark within the budget."""
    context = docs.sparkSession.sparkContext
    for items in _blocks(benchmark):
        docs = _without(docs, context.broadcast(Index(items, rate)), text)
    return docs


def _without(docs: DataFrame, index, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            bad = {x[0] for x in index.value.matches([normalised(x) for x in texts])}
            yield batch.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_())) if bad else batch

    return in_batches(docs, run, docs.schema)
