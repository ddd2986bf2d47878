"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing further columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldspar.llm import chat, decontaminate, licenses, mixing, quality_model, quality_rules, secrets, simhash, suffix, url_rules
from foldspar.llm.common import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp string, kept string, target string, mix_copy string, __x long, g_lang string, h string, name string"
rng = random.Random(8)
PROSE = " ".join(rng.choice(["the", "river", "ran", "under", "an", "old", "bridge", "while", "people", "spoke", "of", "rain", "and", "bread"]) + rng.choice(["", "", ",", "s"]) for _ in range(400))
LONG = "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(4000))
TEXTS = [None, "", " \t\n\x0b\f\r", "one", "two words", PROSE, PROSE, PROSE.upper(), LONG, "é" * 500, "a b c " * 300, "\U0001f600 \x00 nul 😀", "x" * 3000, "token = " + "q1w2e3r4t5y6u7i8", "nbsp\u00a0joined \u2003 wide"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "s1", 3), (3, "one", "en", "s1", 3), (None, "one", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 7, "f", "k", "t", "m", 1, "g", "h", "n") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (5, 1, 0), (5, 1, 0), (7, 0, 1), (9, None, None), (None, 1, 0), (10, 0, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PROSE[100:300]), (1, PROSE[100:300]), (2, None), (3, ""), (4, "short"), (None, PROSE[500:650])], "item_id long, text string")


PER_DOC = {
    "secrets": lambda d, x: secrets.scan(d),
    "mixing": lambda d, x: mixing.mixed(d),
    "suffix": lambda d, x: suffix.removed(d),
    "quality_model": lambda d, x: quality_model.scored(d, x["labels"]),
    "quality_rules": lambda d, x: quality_rules.documents_judged(d),
    "simhash": lambda d, x: simhash.grouped(d),
}


@pytest.mark.parametrize("name", list(PER_DOC))
def test_a_row_for_each_document(docs, labels, name):
    for d in (docs, docs.limit(0), docs.where("doc_id is null")):
        out = PER_DOC[name](d, {"labels": labels})
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in d.select("doc_id").collect())


def test_values_on_the_edges(docs, labels):
    by = lambda df: {r.doc_id: r for r in df.where("doc_id is not null").collect()}
    q = by(quality_rules.documents_judged(docs))
    assert [q[i].n_words for i in (0, 1, 2, 3, 4, 14)] == [0, 0, 0, 1, 2, 3] and q[0].base_failed and not q[0].kept
    assert q[10].n_repeat_words == 900 and q[9].word_chars == 500 and q[8].kept and q[5].kept
    s = by(secrets.scan(docs))
    assert s[0].spans == "" and s[13].n_assign == 1 and s[13].spans == "assign:0:24"
    x = by(suffix.removed(docs))
    assert x[0].n_bytes == 0 and x[5].n_removed == x[5].n_bytes and x[9].n_bytes == 1000 and x[9].n_removed == 1000 and x[12].n_spans == 1 and x[8].n_removed == 0
    g = by(simhash.grouped(docs))
    assert g[0].fingerprint == "0" * 16 and g[0].component_id == g[2].component_id == 0 and g[5].component_id == g[6].component_id == g[7].component_id == 5
    m = by(quality_model.scored(docs, labels))
    assert m[0].score == m[1].score and all(0 <= r.score <= 1 for r in m.values())


def test_model_without_labels(docs, labels):
    assert {r.score for r in quality_model.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_decontamination_edges(docs, benchmark):
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).collect()}
    assert found == {(i, k) for i in (5, 6, 7) for k in (1, None)}
    assert decontaminate.matches(docs, benchmark.limit(0)).count() == decontaminate.matches(docs.limit(0), benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == docs.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_columns(spark, docs, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = materialise(docs, "edge")
    for d in (docs, docs.limit(0)):
        out = stage(spark, d, folder)
        assert out.columns[: len(d.columns)] == d.columns
        rows = out.collect()
        assert rows or d is not docs
        if name == "mixing":
            assert out.columns[-1] == "mix_copy_"
        else:
            assert out.dtypes == d.dtypes
    if name == "secret scans":
        changed = out = {r.doc_id: r for r in stage(spark, docs, folder).collect()}
        assert changed[13].text == "[SECRET]" and changed[13].n_chars == 8 and out[5].text == PROSE and out[0].text is None


def test_licenses_edges(spark, docs):
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(90, "Released under the MIT License."), (90, "Released under the MIT License."), (91, LONG + "\nlicense " + LONG)], "doc_id long, text string"))
    rows = licenses.scan(more).collect()
    assert [(r.family, r.confirmed) for r in rows if r.doc_id == 90] == [("mit", True)] * 2 and not any(r.confirmed for r in rows if r.doc_id == 91)
    assert licenses.scan(docs.select("doc_id", "text").limit(0)).count() == 0


def test_urls_edges(spark, labels):
    urls = [None, "", "no scheme", "http://", "://EXAMPLE.com", "http://WWW.Example.COM/en/x?y#z", "https://a.net/es/", "http://a.net/es", "x://b://example.com/en/", "http://h?q=1/en/", "http://é.com/\n/", "http://com/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(5, urls[5], None), (None, None, None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in url_rules.judged(pages, labels).collect()}
    assert [rows[i].host for i in range(12)] == ["", "", "", "", "example.com", "www.example.com", "a.net", "a.net", "b:", "h", "é.com", "com"]
    assert [rows[i].rule for i in (4, 5, 6, 7, 8, 11)] == [None, "www.example.com/en/", "net/es/", None, None, "com/"]
    assert rows[5].path == "/en/x" and rows[10].path == "/\n/" and rows[6].verdict == "block"
    assert url_rules.judged(pages, labels).count() == 14
    assert url_rules.judged(pages.limit(0), labels).count() == 0 and url_rules.judged(pages, labels.limit(0)).count() == 14


def test_chat_edges(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 1, "assistant", "yo"), (3, 2, None, None),
        (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, None, None), (5, None, "user", "<|im_end|>"), (6, 7, "user", ""), (None, 0, "user", "null id"), (7, 1, "assistant", "yo"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    got = {r.conv_id: r for r in chat.render(df).collect()}
    assert set(got) == {3, 5, 6, 7, None} and got[3].n_turns == 3 and got[3].n_equal == 2 and "< |im_end|>" in got[5].rendered
    assert chat.render(df.limit(0)).count() == 0


def test_long_chats_are_cut_and_still_collapse(spark):
    turns = [(c, i, "user", f"t{i}") for c, n in ((1, 1000), (2, 999), (3, 600)) for i in range(n)]
    rows = chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("part").collect()
    assert [(r.conv_id, r.part, r.n_turns) for r in rows] == [(1, k, 1000) for k in (1, 2, 3, 4)]
    assert "".join(r.rendered for r in rows).count("<|im_start|>") == 1000


def test_chat_ties_and_null_keys_against_sql(spark):
    import duckdb
    import pyarrow as pa

    rows = [(1, 0, "user", x) for x in ("b", "a", "c", None, "")] + [(2, 0, r, "t") for r in ("user", None, "")] + [(3, None, "user", f"n{i % 300}") for i in range(700)]
    rows += [(None, i % 7, "user", f"m{i}") for i in range(600)] + [(4, 0, "user", "b"), (4, 0, "user", "a"), (5, 1, "user", "a"), (5, 2, "user", "b")]
    table = pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))})
    con = duckdb.connect()
    con.register("conversations", table)
    want = con.execute(f"SELECT conv_id, part, n_turns, n_equal, rendered FROM ({chat.ORACLE})").fetchall()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.render(df).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sorted((r.part, r.rendered.count(chat.START)) for r in got if r.conv_id is None) == [(1, 256), (2, 256), (3, 88)]
    assert [r.rendered.count(chat.START) for r in sorted(got, key=lambda r: r.part) if r.conv_id == 3] == [256, 44]
