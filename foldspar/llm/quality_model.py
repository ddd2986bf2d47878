"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's words are split into a letter core and the signs around it. Features are hashed cores, hashed pairs of
neighbouring words, hashed sign runs, and tokens for upper-case words and for word triples that occurred earlier in the
text; each feature's value is its share of the words, so texts of any length compare. Training goes a few times over a
sample of at most about ``max_rows`` labelled rows and ``max_chars`` characters, in one task; the weights, of fixed size, are broadcast, and every
document's score is a sparse dot product with them.

Defined results: null text counts as empty, and a text without words gets the score of the bias alone; rows with null
doc_id have no label and are not held out; rows with null quality are not trained on; a doc_id labelled twice trains
twice; with no labelled row every score is 0.5; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspar.llm.common import about, id_type, in_batches

BITS = 18
SIZE = 1 << BITS
UPPER, AGAIN, SIGNS = SIZE, SIZE + 1, SIZE + 2  # places of their own after the hashed ones
WIDTH = SIZE + 3
CORE = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)
SCALE = 8.0
CACHE = 200_000

ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.02, 0.5, 3


class Features:
    """Feature places and values of a text; words met before are looked up."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def _word(self, word: str) -> int:
        """20 bits for the core, then 20 for the signs (0: none but usual ones), then one each for signs and upper case."""
        before, core, after = CORE.match(word).groups()
        signs = (before + after).strip(".,;:'\"()?")
        if not core:
            signs, core = signs or before + after, ""
        code = crc32(core.lower().encode("utf-8", "surrogatepass")) & 0xFFFFF
        if signs:
            code |= (crc32(signs.encode("utf-8", "surrogatepass")) & 0xFFFFF) << 20 | 1 << 40
        if len(core) > 2 and core.isupper():
            code |= 1 << 41
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = code
        return code

    def places(self, text: str) -> tuple[np.ndarray, int]:
        """Places of all features, one entry for each time, and the number of words."""
        get, new = self.cache.get, self._word
        code = np.array([c if (c := get(w)) is not None else new(w) for w in text.split()], np.int64)
        n = len(code)
        if not n:
            return np.empty(0, np.int64), 0
        core = code & 0xFFFFF
        sign = code[(code >> 40) & 1 == 1]
        parts = [core & (SIZE - 1), np.full(int(((code >> 41) & 1).sum()), UPPER), np.full(len(sign), SIGNS), (((sign >> 20) & 0xFFFFF) * 40503 + 77) & (SIZE - 1)]
        if n > 1:
            parts.append((core[:-1] * 1000003 + core[1:] * 8191 + 11) & (SIZE - 1))
        if n > 2:
            triple = (core[:-2] << 40) ^ (core[1:-1] << 20) ^ core[2:]
            parts.append(np.full(n - 2 - len(np.unique(triple)), AGAIN))
        return np.concatenate(parts), n

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct places with their values, the bias's last."""
        places, n = self.places(text)
        at, count = np.unique(places, return_counts=True)
        return np.append(at, WIDTH), np.append(count * (SCALE / max(1, n)), 1.0)


def trained(sparse: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the last is the bias) by FTRL-proximal passes over rows of places, values and a label, in the given order."""
    z, squares = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)

    def weights(at) -> np.ndarray:
        a, s = z[at], squares[at]
        return np.where(np.abs(a) <= L1, 0.0, -(a - np.sign(a) * L1) / ((BETA + np.sqrt(s)) / ALPHA + L2))

    for _ in range(PASSES):
        for at, x, label in sparse:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / ALPHA * w
            squares[at] += g * g
    return weights(np.arange(WIDTH + 1))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_chars: int = 1 << 28) -> np.ndarray:
    """Weights learnt from rows of labels that are not held out.

    At most about max_rows rows are picked by hash, and of them, in the order of the hash, as many as have max_chars
    characters together: what one task holds is bounded in both.
    """
    usable = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("label")).where(~held_out("l_id") & F.col("l_id").isNotNull() & F.col("quality").isin(0, 1))
    n = usable.count()
    if not n:
        return np.zeros(WIDTH + 1)
    usable = usable.withColumn("h", F.xxhash64(F.lit("quality"), "l_id")).where(about(max_rows, n, "h"))
    rows = docs.select("doc_id", "text").join(usable, docs["doc_id"] == usable["l_id"]).select("h", "l_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sparse, left = Features(), [], max_chars
        for batch in batches:
            for text, label in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (left := left - len(text or "")) < 0:
                    break
                sparse.append((*features.sparse(text or ""), label))
            if left < 0:
                break
        for _ in batches:  # the rest is not trained on
            pass
        yield pa.RecordBatch.from_arrays([pa.array([trained(sparse).tobytes()], pa.binary())], names=["weights"])

    one = rows.repartition(1).sortWithinPartitions("h", "l_id", "text", "label")
    made = in_batches(one, run, "weights binary").first()
    return np.frombuffer(made[0]) if made else np.zeros(WIDTH + 1)


def scored(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **fitting) -> DataFrame:
    """The contract's columns for every document."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fitting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), weights.value
        for batch in batches:
            score = []
            for text in batch.column(2).to_pylist():
                places, n = features.places(text or "")
                score.append(w[places].sum() * (SCALE / max(1, n)) + w[WIDTH])
            p = 1 / (1 + np.exp(-np.clip(np.array(score), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return in_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), run, f"doc_id {id_type(docs)}, held_out boolean, score double, predicted int")
