"""Operators against brute force, SQL, exact round trips or held-out accuracy."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from foldspar.llm import components, decontaminate, licenses, mixing, quality_model, quality_rules, secrets, simhash, suffix, url_rules
from foldspar.llm import queries as corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("name", list(corpus.ORACLES))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    df = corpus.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    norm = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    got = con.execute(corpus.ORACLES[name])
    at = [[d[0] for d in got.description].index(c) for c in columns]
    assert sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(norm(r[i]) for i in at) for r in got.fetchall()), key=repr)


# -- 2


def plain_entropy(s):
    return -sum(n / len(s) * np.log2(n / len(s)) for n in Counter(s).values())


def test_windows_have_the_entropy_they_are_judged_by():
    rng = random.Random(1)
    for _ in range(200):
        run = "".join(rng.choice("abcdef0123456789"[: rng.randint(3, 16)]) for _ in range(rng.randint(20, 60)))
        w = secrets.WINDOW
        good = [i for i in range(len(run) - w + 1) if plain_entropy(run[i : i + w]) >= 3.0 - 1e-9 and sum(c.isdigit() for c in run[i : i + w]) >= 2 and sum(c.isalpha() for c in run[i : i + w]) >= 4]
        covered = {k for a, b in secrets._windows(run, 3.0) for k in range(a, b)}
        assert covered == {k for i in good for k in range(i, i + w)}


def test_secret_base_spans(spark, folder, texts):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in corpus.QUERIES["op2_secret_scan"](spark, folder).collect():
        t = texts[r.doc_id]
        found = [(m.start(), m.end(), 0) for m in assign.finditer(t) if len(m[2]) >= 12] + [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        found.sort(key=lambda x: (x[0], x[2]))
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, b, k in found)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in found) for k in range(3)) and r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("x password=token:abcdefghijklmnopqrst", ""),  # the first match is too short and takes the second's start
        ("Api-Key", ""), ("aPi_KeY : 'abcdefghijkl'", "assign:0:23"), ("AKIA" + "A" * 13, ""), ("AKIA" + "A" * 14, "access:0:18"),
        ("é " + "0123456789abcde", ""), ("é 0123456789abcdef", "hex:2:18"), ("pa\u017fsword=abcdefghijklmn", ""),
        ("see Zk3pQ9vX7mB2nL5tR8wY1cD4 ok", "entropy:4:28"), ("see https://x/Zk3pQ9vX7mB2nL5tR8wY1cD4 ok", ""), ("123e4567-E89B-12D3-A456-426614174000", ""), ("averyveryverylongwordwithoutdigits", ""),
    ],
)
def test_secret_cases(text, spans):
    assert secrets._joined(secrets.all_spans(text)[1]) == spans


@pytest.mark.parametrize(
    "around",
    ['{"url":"https://x.io","k":"%s"}', "ann@b.org,%s", "https://u:%s@h.io/", "https://%s@h.io/a", "https://h.io/a?k=%s", "www.h.io/a?b=c&k=%s", "https://x.io/a,%s", "ann@b.org:%s", "http://h/#%s", "see https://u:%s@h.io:80/a?b"],
)
def test_secrets_beside_addresses(around):
    secret = "Zk3pQ9vX7mB2nL5tR8wY1cD4hJ6gF0sA"
    at = around.index("%s")
    found = secrets.entropy_spans(around % secret)
    assert len(found) == 1 and found[0][0] <= at and found[0][1] >= at + len(secret) and "[S]" in secrets.redacted(around % secret, "[S]")


@pytest.mark.parametrize("text", ["https://x.io/a/%s", "www.x.io/%s/b", "https://x.io:80/%s.html", "ann@%s.org", "https://u@x.io/%s?a=b", "https://%s.io"])
def test_parts_of_addresses_are_no_secrets(text):
    assert secrets.entropy_spans(text % "Zk3pQ9vX7mB2nL5tR8wY1cD4") == []


def test_entropy_spans_against_brute_force():
    rng = random.Random(11)
    n = secrets.WINDOW
    for _ in range(300):
        parts = ["".join(rng.choice(rng.choice(["abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", "ab1", "xyz"])) for _ in range(rng.randint(1, 70))) for _ in range(6)]
        text = rng.choice([" ", ",", "\n", " the "]).join(parts)
        want = set()
        for m in re.finditer(r"[A-Za-z0-9+/=_-]{20,}", text):
            if any(a.search(m.group()) for a in secrets.ALLOW):
                continue
            for least, kind in ((3.0, "[0-9A-Fa-f]+"), (3.75, ".+")):
                for k in range(m.start(), m.end() - n + 1):
                    x = text[k : k + n]
                    if re.fullmatch(kind, x) and plain_entropy(x) >= least - 1e-9 and sum(c.isdigit() for c in x) >= 2 and sum(c.isalpha() for c in x) >= 4:
                        want |= set(range(k, k + n))
        assert {k for a, b, _ in secrets.entropy_spans(text) for k in range(a, b)} == want


def test_redaction():
    assert secrets.redacted("a token = \"0123456789abcdef0123\" b", "*") == 'a *" b' and secrets.redacted("plain", "*") == "plain"


# -- 3


def distance(item, region):
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(region, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_alignment_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(120):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(5, 30)))
        region = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert decontaminate.align(item, region, -len(item), len(region))[0] == distance(item, region)


def test_long_texts_go_in_pieces(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(3)] + [(0, " ".join(word() for _ in range(20)))]
    texts = [" ".join(w for k in range(60) for w in ([items[k % 4][1]] if rng.random() < 0.2 else [word() for _ in range(10)])) for _ in range(6)]
    index = decontaminate.Index(items)
    whole = index.matches(texts)
    assert len(whole) == sum(len(re.findall(re.escape(t), x)) for _, t in items for x in texts)
    for piece in (700, 3000):
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        assert index.matches(texts) == whole


def test_decontamination_finds_what_is_within_budget(spark, folder):
    rng = random.Random(3)
    con = duckdb.connect()
    items = con.execute(f"SELECT item_id, text FROM '{folder}/benchmark.parquet' ORDER BY 1").fetchall()
    background = [r[0] for r in con.execute(f"SELECT text FROM '{folder}/documents.parquet' WHERE length(text) > 1500 LIMIT 40").fetchall()]
    docs, want = [], set()
    for n, (i, t) in enumerate(items * 2):
        x = decontaminate.normalised(t)
        k = int(min(len(x) * decontaminate.RATE, (len(x) - 14) // 7))
        edits = rng.choice([0, 1, k // 2, k, 3 * k])
        y = list(x)
        for _ in range(edits):
            at = rng.randrange(len(y))
            y[at : at + rng.choice([0, 1])] = rng.choice(["q", "zz"[:1], ""])
        y = "".join(y).upper() if n % 3 == 0 else "".join(y).replace(" ", " \n ")
        a, b = rng.choice(background), rng.choice(background)
        docs.append((n, f"{a[:rng.randint(0, 900)]} {y} {b[:rng.randint(0, 900)]}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(df, bench).collect()}
    for n, text in docs:
        for i, t in items:
            x, z = decontaminate.normalised(t), decontaminate.normalised(text)
            k = int(min(len(x) * decontaminate.RATE, (len(x) - 14) // 7))
            if (n % len(items)) == [j for j, _ in items].index(i) or i < 3:
                near = distance(x, z)
                assert ((n, i) in got) == (near <= k), (n, i, near, k)
                if near <= k:
                    want.add((n, i))
                    r = got[n, i]
                    assert r.distance == near == distance(x, decontaminate.normalised(text[r.start : r.end]))
    assert want


def test_short_items_are_found(spark):
    items = [(1, "Who wrote the iliad?"), (2, "2 + 2?"), (3, "wrote t"), (4, "why is the sky blue at noon?"), (5, " "), (6, "2 +  2?")]
    docs = [(1, "Q: who  wrote the Iliad? A: Homer"), (2, "So 2 + 2? and 2 + 2? Yes"), (3, "he wrote to her"), (4, "why is the sky blu at noon?"), (5, "2+2"), (6, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.distance, r.budget) for r in decontaminate.matches(df, bench).collect())
    assert got == [(1, 1, 3, 24, 0, 0), (1, 3, 8, 15, 0, 0), (2, 2, 3, 9, 0, 0), (2, 2, 14, 20, 0, 0), (2, 6, 3, 9, 0, 0), (2, 6, 14, 20, 0, 0), (3, 3, 3, 10, 0, 0), (4, 4, 0, 27, 1, 2)]
    assert [r.doc_id for r in decontaminate.clean(df, bench).collect()] == [5, 6]


def test_items_with_ids_of_other_types_and_places_in_the_text(spark):
    text = "\tİ Some  Words\n before THE  long\u2003item of the benchmark STANDS here, and after"
    df = spark.createDataFrame([("d1", text)], "doc_id string, text string")
    bench = spark.createDataFrame([("i-1", "the long item of the benchmark stands here")], "item_id string, text string")
    (r,) = decontaminate.matches(df, bench).collect()
    assert (r.doc_id, r.item_id, r.distance) == ("d1", "i-1", 0) and text[r.start : r.end] == "THE  long\u2003item of the benchmark STANDS here"
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice(["a", "B", " ", "\n\t", "İ", "ß", "\u2003", "😀"]) for _ in range(rng.randint(1, 30)))
        at = decontaminate.origins(t)
        assert all((c == " " and t[at[k]].isspace()) or c in t[at[k]].lower() for k, c in enumerate(decontaminate.normalised(t)))


# -- 4


def test_mix_comes_near_the_targets(spark, folder, docs, texts):
    rows = mixing.mixed(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == len(WORD.findall(texts[r.doc_id])) and r.taken <= 2 * r.size
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    goal, free, left = {}, set(size), 1.5 * sum(size.values())
    while True:  # shares by weight; who is above its cap stops there and the rest is shared anew
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}
        if not over:
            break
        goal |= {s: 2.0 * size[s] for s in over}
        free -= over
        left -= sum(goal[s] for s in over)
    goal |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert all(abs(goal[s] - target[s]) < 1e-6 * goal[s] for s in goal)
    assert abs(sum(taken.values()) - sum(target.values())) < 0.1 * sum(target.values())
    assert sorted(rows) == sorted(mixing.mixed(docs.repartition(7)).collect())
    emitted = Counter()
    for r in mixing.emit(docs).collect():
        emitted[r.doc_id] += len(WORD.findall(r.text or ""))
    assert {r.doc_id: r.taken for r in rows if r.taken} == {k: v for k, v in emitted.items() if v}


# -- 5


def plain_removed(docs):
    n, count = suffix.LENGTH, Counter()
    for b in docs:
        count.update(b[p : p + n] for p in range(len(b) - n + 1))
    out = []
    for b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([390, 399, 400, 401, 450, 900]))) for _ in range(10)]
    docs = []
    for i in range(70):
        t = ""
        for _ in range(rng.randint(1, 5)):
            q, kind = rng.choice(passages), rng.random()
            t += q[rng.randint(0, 60) : len(q) - rng.randint(0, 60)] if kind < 0.5 else "xy" * rng.randint(1, 400) if kind < 0.6 else "".join(rng.choice("qrstuv ") for _ in range(rng.randint(1, 500)))
        docs.append((i, t))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (101, docs[3][1])]
    got = sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(zip([i for i, _ in docs], plain_removed([t.encode() for _, t in docs]), strict=True))


def test_suffix_on_the_documents(spark, folder, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in corpus.QUERIES["op5_suffix_dedup"](spark, folder).collect()}
    assert got == dict(zip(texts, plain_removed([t.encode() for t in texts.values()]), strict=True))


def test_names_and_anchors_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 100, 3000, dtype=np.uint8), np.full(900, 120, np.uint8)])
    short, whole = suffix.names(data, 200, 400)
    for h, n in ((short, 200), (whole, 400)):
        strings = [data[p : p + n].tobytes() for p in range(len(data) - n + 1)]
        assert len(h) == len(strings) and len(set(zip(strings, h.tolist(), strict=True))) == len(set(strings)) == len(set(h.tolist()))
    assert (suffix.least_places(short, 201) == [p + int(np.argmin(short[p : p + 201])) for p in range(len(short) - 200)]).all()
    for piece in (1 << 21, 512):
        monkeypatch.setattr(suffix, "PIECE", piece)
        name, _, low, more, _ = suffix.anchors(data)
        assert sum(more + 1) == len(data) - 399 and (np.diff(low) == more[:-1] + 1).all() and set(name.tolist()) <= set(short.tolist())


# -- 6


def test_quality_model_on_held_out_rows(spark, folder):
    at = os.environ.get("TEST_LARGER_SF_DIR", "/root/testdata/sf0.01")
    at = at if os.path.isdir(at) else folder
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in corpus.QUERIES["op6_quality_classifier"](spark, at).collect() if r.held_out and r.doc_id in labels]
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    right = sum(r.predicted == labels[r.doc_id] for r in rows)
    low, high = ([r.score for r in rows if labels[r.doc_id] == y] for y in (0, 1))
    assert right >= 0.95 * len(rows) and np.mean([a < b for a in low for b in high]) > 0.97
    from zlib import crc32

    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def plain_features(text):
    """Places with their values by the module's definition, a word at a time."""
    from zlib import crc32

    out, seen, before, n = Counter(), set(), [], 0
    words = text.split()
    for w in words:
        head, core, tail = quality_model.CORE.match(w).groups()
        signs = (head + tail).strip(".,;:'\"()?")
        if not core:
            signs = signs or head + tail
        c = crc32(core.lower().encode()) & 0xFFFFF
        out[c % quality_model.SIZE] += 1
        if signs:
            out[((crc32(signs.encode()) & 0xFFFFF) * 40503 + 77) % quality_model.SIZE] += 1
            out[quality_model.SIGNS] += 1
        if len(core) > 2 and core.isupper():
            out[quality_model.UPPER] += 1
        before.append(c)
        if len(before) > 1:
            out[(before[-2] * 1000003 + c * 8191 + 11) % quality_model.SIZE] += 1
        if len(before) > 2:
            out[quality_model.AGAIN] += tuple(before[-3:]) in seen
            seen.add(tuple(before[-3:]))
    return {k: v * quality_model.SCALE / len(words) for k, v in out.items() if v} | {quality_model.WIDTH: 1.0}


def test_quality_scores_against_plain_training(spark, docs, texts):
    """Every score from one-weight-at-a-time updates and plain dot products."""
    labels = {i: i % 2 for i in sorted(texts)[:60]}
    order = sorted((r.h, r.i) for r in spark.createDataFrame([(i,) for i in labels], "i long").selectExpr("xxhash64('quality', i) h", "i").collect())
    from zlib import crc32

    order = [i for _, i in order if crc32(str(i).encode()) % 4 != 2]
    z, sq = defaultdict(float), defaultdict(float)
    q = quality_model

    def weight(k):
        return 0.0 if abs(z[k]) <= q.L1 else -(z[k] - np.sign(z[k]) * q.L1) / ((q.BETA + sq[k] ** 0.5) / q.ALPHA + q.L2)

    rows = [(plain_features(texts[i]), labels[i]) for i in order]
    for _ in range(q.PASSES):
        for x, y in rows:
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-np.clip(sum(w[k] * v for k, v in x.items()), -35, 35)))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - ((sq[k] + g * g) ** 0.5 - sq[k] ** 0.5) / q.ALPHA * w[k]
                sq[k] += g * g
    df = spark.createDataFrame([(i, y, "x") for i, y in labels.items()], "doc_id long, quality int, text string")
    for r in quality_model.scored(docs, df).collect()[:80]:
        x = plain_features(texts[r.doc_id])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(sum(weight(k) * v for k, v in x.items()), -35, 35)))) < 1e-6


# -- 7


def test_licenses(spark, docs):
    cues = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit"}
    extra = [(10_000 + i, f"{pre}{t}{post}") for i, (t, pre, post) in enumerate((t, a, b) for t in cues for a, b in (("", ""), ("Some words first.\n", "\nand more"), ("x\n\n", ""), ("Note: ", " Thanks.")))]
    lookalikes = [(20_000 + i, t) for i, t in enumerate(["His driving license expired in June.", "The copyright lecture was long.", "A licence to print money, they said."])]
    rows = licenses.scan(docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra + lookalikes, "doc_id long, text string"))).collect()
    found = defaultdict(set)
    for r in rows:
        if r.confirmed:
            found[r.doc_id].add(r.family)
    for i, t in extra:
        assert found[i] == {next(f for k, f in cues.items() if k in t)}, (i, t, found[i])
    assert not any(found[i] for i, _ in lookalikes)
    for r in docs.collect():
        if want := {f for k, f in cues.items() if k in (r.text or "")}:
            assert want <= found[r.doc_id]


def test_wrapped_licenses(spark, docs):
    import textwrap

    long = [(f, t) for f, some in licenses.TEMPLATES.items() for t in some if len(t) > 85]
    cases = [(f, t, w, mark, pre) for f, t in long for w in (70, 76, 80) for mark in ("", " * ") for pre in ("", "Some words first.\n")]
    rows = [(30_000 + i, f, pre + "\n".join(mark + x for x in textwrap.wrap(t, w)) + "\n\nand more of it") for i, (f, t, w, mark, pre) in enumerate(cases)]
    extra = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    found = defaultdict(set)
    for r in licenses.scan(docs.select("doc_id", "text").unionByName(extra)).where("confirmed").collect():
        found[r.doc_id].add(r.family)
    assert [(f, t, found[i]) for i, f, t in rows if f not in found[i]] == []


# -- 8


def test_urls_against_brute_force(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    url = {r.page_id: r.url for r in pages.collect()}
    for r in corpus.QUERIES["op8_url_filter"](spark, folder).collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", url[r.page_id])
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path) and r.rule == (max(fits)[1] if fits else None) and (not fits or r.verdict == max(fits)[2])


def test_mined_rules_block_what_the_labels_show(spark):
    rng = random.Random(4)
    hosts = ["good", "fine", "pills", "casino"]
    rows = [(i, f"https://{rng.choice(['www', 'm'])}.{rng.choice(hosts)}.org/{rng.choice(['en', 'buy', 'news'])}/{i}?ref=x") for i in range(1500)]
    bad = lambda u: "casino" in u or ("pills" in u and "/buy/" in u)
    pages = spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 0 if bad(u) else 1, 0) for i, u in rows if i % 2], "doc_id long, quality int, toxic int")
    assert all((r.verdict == "block") == bad(dict(rows)[r.page_id]) for r in url_rules.judged(pages, labels).collect())


# -- 9


def test_quality_statistics_against_brute_force(spark, folder, texts):
    rows = corpus.QUERIES["op9_quality_rules"](spark, folder).collect()
    for r in rows:
        t = texts[r.doc_id]
        w = WORD.findall(t)
        where = defaultdict(list)
        for i in range(len(w) - 7):
            where[tuple(w[i : i + 8])].append(i)
        covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [r for r in rows if not r.base_failed and r.doc_id in labels]
    assert all(r.kept for r in judged if labels[r.doc_id] == 1)
    assert np.mean([not r.kept for r in judged if labels[r.doc_id] == 0] or [1]) > 0.9


# -- 10


def plain_fingerprint(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    v = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(v[k + 1 :] ^ v[k]) <= 2):
            a, b = find(i), find(ids[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, folder, texts):
    rows = corpus.QUERIES["op10_simhash"](spark, folder).collect()
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)


@pytest.mark.parametrize("busy", [64, 3])
def test_links_connect_what_is_near(spark, monkeypatch, busy):
    monkeypatch.setattr(simhash, "BUSY", busy)
    rng = random.Random(6)
    points = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            points.add(x)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    order = sorted(simhash._signed(x) for x in points)
    df = spark.createDataFrame([(x,) for x in order], "fp long")
    pairs = simhash.links(df).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in pairs)
    roots = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    want = plain_components({x: x & (2**64 - 1) for x in order})
    assert {x: roots.get(x, x) for x in order} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (1001, 1002), (7, 7), (1000, 1001)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 401)} | {1001: 1000, 1002: 1000}


def test_one_of_each_group_stays(spark):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(3000)]
    docs, groups = [], []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(60, 900))]
        members = [base]
        for _ in range(rng.choice([0, 1, 5])):
            x = list(base)
            for _ in range(max(1, len(x) // 100)):  # about one word of 100: a similarity of about 0.9
                x[rng.randrange(len(x))] = rng.choice(words)
            members.append(x)
        groups.append(range(len(docs), len(docs) + len(members)))
        docs += [(len(docs) + k, " ".join(m)) for k, m in enumerate(members)]
    half = docs[0][1].split()
    docs.append((len(docs), " ".join(half[: len(half) // 2] + [rng.choice(words) for _ in range(len(half))])))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [sum(i in kept for i in g) for g in groups] == [1] * len(groups) and len(docs) - 1 in kept


@pytest.mark.parametrize("chunk", [256, 20])
def test_pairs_behind_a_template_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(12)
    word = lambda: "w%d" % rng.randrange(10**9)
    common = [word() for _ in range(850)]
    docs = []
    for _ in range(60):  # pairs at about 0.87 that share the template with all others, at about 0.74
        own = [word() for _ in range(150)]
        docs += [common + own[:80] + own[80:], common + own[:80] + [word() for _ in range(70)]]
    sets = [set(simhash.shingle_hashes(" ".join(d), 5).tolist()) for d in docs]
    near = [(i, k) for i in range(len(docs)) for k in range(i) if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])]
    assert near == [(i + 1, i) for i in range(0, len(docs), 2)]
    rng.shuffle(order := list(range(len(docs))))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame([(i, " ".join(docs[i])) for i in order], "doc_id long, text string")).collect()}
    assert [(i in kept) + (i + 1 in kept) for i in range(0, len(docs), 2)] == [1] * 60


# -- the pipeline


def test_pipeline_against_plain_stages(spark, folder, texts):
    kept = {r.doc_id for r in quality_rules.documents_judged(spark.read.parquet(f"{folder}/documents.parquet")).collect() if r.kept}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    copies, first = {}, {}
    rows = corpus_pipeline.run(spark, folder).collect()
    seen = {r.doc_id for r in rows}
    assert seen <= kept and not any(i in texts[d] for d in seen for i in items)
    for d in sorted(seen):
        assert first.setdefault(texts[d], d) == d  # no exact copies are left
    for r in rows:
        assert r.text == secrets.redacted(texts[r.doc_id], "[SECRET]") and r.n_chars == len(r.text)
        copies.setdefault(r.doc_id, set()).add(r.mix_copy)
    assert all(x == set(range(1, len(x) + 1)) for x in copies.values()) and max(map(len, copies.values())) <= 2
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "secret scans", "mixing"]
