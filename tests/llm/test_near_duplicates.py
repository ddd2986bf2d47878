"""Candidates of the near-duplicate stage against brute force."""

import random

from foldspar.llm import simhash


def test_whole_fingerprints_within_two_bits_are_candidates(spark):
    rng = random.Random(3)
    points = []
    for _ in range(30):
        x = rng.getrandbits(64)
        points += [x, x, x ^ 1 << rng.randrange(64), x ^ 3 << rng.randrange(63), x ^ 7 << rng.randrange(62)]
    made = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(points)], "row long, whole long")
    got = {(max(r.a, r.b), min(r.a, r.b)) for r in simhash._near_prints(made).collect()}
    first = {x: i for i, x in reversed(list(enumerate(points)))}
    want = {(i, first[x]) for i, x in enumerate(points) if first[x] != i}
    want |= {(max(i, k), min(i, k)) for x, i in first.items() for y, k in first.items() if x != y and (x ^ y).bit_count() <= 2}
    assert got == want


def test_rare_shingles_lose_no_pair_and_pair_out_no_template(spark):
    rng = random.Random(14)
    word = lambda: "w%d" % rng.randrange(10**9)
    common = [word() for _ in range(420)]
    docs = []
    for _ in range(100):  # pairs at about 0.87 that share the template with all others, at about 0.73
        own = [word() for _ in range(80)]
        docs += [common + own, common + own[:45] + [word() for _ in range(35)]]
    sets = [set(simhash.shingle_hashes(" ".join(d), 5).tolist()) for d in docs]
    near = {(i, k) for i in range(len(docs)) for k in range(i) if len(sets[i] & sets[k]) >= 0.78 * len(sets[i] | sets[k])}
    assert near == {(i + 1, i) for i in range(0, len(docs), 2)}
    texts = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "__sim_row long, text string")
    none = spark.createDataFrame([], "node long, root long")
    runs = simhash._prefixes(spark.range(len(docs)).withColumnRenamed("id", "row"), texts, 5, 0.78)
    got = {(max(r.a, r.b), min(r.a, r.b)) for r in simhash._candidates(runs, none, 0.78, True).collect()}
    assert near <= got and len(got) < 2 * len(docs)  # of 19 900 pairs
