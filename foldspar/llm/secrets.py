"""Secret scans: fixed patterns, and a sliding-window Shannon entropy per character class over candidate strings.

Candidates are runs of characters that tokens are written in. In each of them, runs of one character class (hexadecimal,
or base 64) are read by a window of fixed length whose character counts and entropy change by one character in and one
out. Windows above the class's threshold that mix digits and letters are hits; hits that touch merge into spans of kind
``entropy``. Allow-listed candidates are passed over, and so are hits inside a span of a fixed pattern. Addresses (scheme,
host, port and path, but not userinfo, query or fragment; the domain of an e-mail) are cut out of candidates.

Offsets are code points, the end exclusive. Defined results: null text counts as empty; a text without secrets has zero
counts, the hash of the empty string and empty spans; repeated rows are scanned alike; an empty table gives no rows;
other columns are ignored by the query and pass through the redaction untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspar.llm.common import id_type, in_batches

#: Fixed values of the contract.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
WINDOW = 20
#: Class, its characters, least entropy in bits of a window of it.
CLASSES = (("hex", re.compile("[0-9A-Fa-f]{20,}"), 3.0), ("base64", re.compile("[A-Za-z0-9+/=_-]{20,}"), 3.75))
MIN_DIGITS, MIN_LETTERS = 2, 4
#: Candidates that hold one of these are no secrets: examples, UUIDs, digests named as such, alphabets.
ALLOW = (
    re.compile("EXAMPLE|example|Example"),
    re.compile(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    re.compile("^(?:sha(?:1|256|384|512)|md5)[-=]"),
    re.compile("0123456789|ABCDEFGHIJ|abcdefghij"),
)
#: Addresses: what follows a scheme without its userinfo, up to the end of the path; names after www.; domains after @.
ADDRESS = re.compile(r"""(?:://(?:[^\s/?#@"'`<>,;|()\[\]{}\\]*@)?|\bwww\.)(?P<rest>[\w.-]*(?::[0-9]{1,5}(?![\w.~%+=-]))?(?:/[\w.~%/+-]*)?)|(?P<domain>@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b)""")
_TERM = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind, as (start, end, kind)."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of windows whose characters of one class are too evenly spread for words, merged where they touch."""
    hits = []
    passed = [m.span("rest") if m["domain"] is None else m.span("domain") for m in ADDRESS.finditer(text)]
    nth = 0
    for m in CANDIDATE.finditer(text):
        at = m.start()
        while nth < len(passed) and passed[nth][1] <= at:
            nth += 1
        k = nth
        while k < len(passed) and passed[k][0] < m.end():  # what is not of an address is judged
            hits += _judged(text, at, passed[k][0])
            at, k = passed[k][1], k + 1
        hits += _judged(text, at, m.end())
    merged: list[list[int]] = []
    for a, b in sorted(hits):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b, "entropy") for a, b in merged]


def _judged(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Extents of the windows in text[start:end] that are hits; none if it is too short or allow-listed."""
    run = text[start:end]
    if len(run) < WINDOW or run.isalpha() or not any(c.isdigit() for c in run) or any(a.search(run) for a in ALLOW):
        return []
    return [(start + part.start() + a, start + part.start() + b) for _, pattern, least in CLASSES for part in pattern.finditer(run) for a, b in _windows(part.group(), least)]


def _windows(run: str, least: float) -> Iterator[tuple[int, int]]:
    """Extents of consecutive windows of run with at least that entropy, each window's counts made from the last one's."""
    counts: dict[str, int] = {}
    terms, digits, letters, start, end = 0.0, 0, 0, -1, -1
    for i, c in enumerate(run):
        n = counts[c] = counts.get(c, 0) + 1
        terms += _TERM[n] - _TERM[n - 1]
        digits, letters = digits + c.isdigit(), letters + c.isalpha()
        if i >= WINDOW:
            out = run[i - WINDOW]
            n = counts[out] = counts[out] - 1
            terms += _TERM[n] - _TERM[n + 1]
            digits, letters = digits - out.isdigit(), letters - out.isalpha()
        if i >= WINDOW - 1 and digits >= MIN_DIGITS and letters >= MIN_LETTERS and log2(WINDOW) - terms / WINDOW >= least - 1e-9:
            first = i - WINDOW + 1
            if start >= 0 and first > end:
                yield start, end
                start = -1
            start, end = (first if start < 0 else start), i + 1
    if start >= 0:
        yield start, end


def all_spans(text: str) -> tuple[list, list]:
    """The base spans, and those with the method's beside them, each by start and kind."""
    base = sorted(base_spans(text), key=_place)
    more = [x for x in entropy_spans(text) if not any(a <= x[0] and x[1] <= b for a, b, _ in base)]
    return base, sorted(base + more, key=_place)


def _place(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))


def found(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident and found, an array of spans (start, end, kind, base) in their order, for every row; base marks the fixed patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b, "kind": kind, "base": kind != "entropy"} for a, b, kind in all_spans(x)[1]] if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _FOUND)], names=[ident, "found"])

    return in_batches(docs.select(ident, text), run, f"{ident} {id_type(docs, ident)}, found array<struct<start:bigint,end:bigint,kind:string,base:boolean>>")


def scan(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["base"])
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:3]]
    return found(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"))


def redacted(text: str, mark: str) -> str:
    parts, at = [], 0
    for a, b, _ in all_spans(text)[1]:
        if b > at:
            parts += [text[at:a], mark] if a >= at else []
            at = b
    return "".join([*parts, text[at:]]) if at else text


def redact(docs: DataFrame, text: str = "text", chars: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with mark in place of each run of overlapping spans, and the length in the column chars, if there is one, renewed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            old = batch.column(place).to_pylist()
            new = [x and redacted(x, mark) for x in old]
            columns = list(batch.columns)
            if new != old:
                columns[place] = pa.array(new, batch.schema.field(place).type)
                if (n := batch.schema.get_field_index(chars)) >= 0 and pa.types.is_integer(batch.schema.field(n).type):
                    kept = columns[n].to_pylist()
                    columns[n] = pa.array([len(b) if a != b else k for a, b, k in zip(old, new, kept, strict=True)], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return in_batches(docs, run, docs.schema)
