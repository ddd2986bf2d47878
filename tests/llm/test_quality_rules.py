"""The minimum-covariance-determinant verdict against a plain one, and its robustness."""

import os

import numpy as np
import pytest

from foldspar.llm import quality_rules as rules

D = rules.D


def part(values, share):
    """The element at that share of the sorted values, as the engine's percentiles take it."""
    return np.sort(values)[max(0, int(np.ceil(share * len(values))) - 1)]


def d2(x, m, c):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def scatter(x, scale):
    return x.mean(axis=0), np.cov(x.T, bias=True) * scale + np.eye(D) * rules.LEAST**2 if len(x) > 1 else np.eye(D) * rules.LEAST**2


def plain_mcd(x):
    med = np.array([part(x[:, i], 0.5) for i in range(D)])
    mad = np.array([max(1.4826 * part(abs(x[:, i] - med[i]), 0.5), rules.LEAST) for i in range(D)])
    z = (x - med) / mad
    u = z / np.sqrt((z * z).sum(axis=1) + 1e-12)[:, None]
    least = np.eye(D) * rules.LEAST**2
    runs = [(med, np.diag(mad**2)), scatter(x, 1.0), (med, np.outer(mad, mad) * (u.T @ u / len(x)) * D + least)]

    def step(m, c):
        d = d2(x, m, c)
        return scatter(x[d <= part(d, 0.5) * (1 + 1e-12)], rules.consistency(0.5))

    done = []
    for m, c in runs:
        dets = []
        for _ in range(2):
            m, c = step(m, c)
            dets.append(np.linalg.det(c))
        done.append((min(dets), m, c))
    det, m, c = min(done, key=lambda y: y[0])
    while True:
        m, c = step(m, c)
        if not np.linalg.det(c) < 0.95 * det:
            break
        det = np.linalg.det(c)
    return scatter(x[d2(x, m, c) <= rules.chi_square(0.025)], rules.consistency(0.975))


def test_the_verdict_against_a_plain_one(spark, folder):
    at = os.environ.get("TEST_LARGER_SF_DIR", "/root/testdata/sf0.01")
    docs = spark.read.parquet(f"{at if os.path.isdir(at) else folder}/documents.parquet").where("source is not null").select("doc_id", "text", "lang", "source")
    judged = rules.documents_judged(docs).toPandas().set_index("doc_id")
    stats = rules.with_statistics(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", *[c.alias(k) for k, c in rules._vector("").items()]).toPandas().set_index("doc_id")
    stats = stats[~judged.loc[stats.index].base_failed]
    vectors = stats.drop_duplicates()
    parts = list(rules.PARTS)
    m0, c0 = plain_mcd(vectors[parts].to_numpy())
    worst = 0.0
    for _, group in vectors.groupby(["lang", "source"]):
        m, c = plain_mcd(group[parts].to_numpy())
        by = rules.SHRINK / (len(group) + rules.SHRINK)
        m, c = m + by * (m0 - m), c + max(by, rules.ALWAYS) * (c0 - c)
        rows = stats[(stats.lang == group.lang.iloc[0]) & (stats.source == group.source.iloc[0])]
        want = d2(rows[parts].to_numpy(), m, c)
        got = judged.loc[rows.index]
        worst = max(worst, np.abs(got.distance.to_numpy() / want - 1).max())
        far = want > rules.chi_square(1e-7)
        sure = np.abs(want / rules.chi_square(1e-7) - 1) > 0.02
        assert (got.kept.to_numpy() != far)[sure].all()
    assert worst < 0.02


def test_the_scatter_comes_from_the_data(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    x = rules.with_statistics(docs).where("n_words >= 20").select(*[c.alias(k) for k, c in rules._vector("").items()]).toPandas().to_numpy()
    _, c = plain_mcd(x)
    assert (rules.LEAST**2 < 0.1 * np.diag(c)).all()


def frame(spark, x):
    return spark.createDataFrame([("g", *map(float, y)) for y in x], "g string, x0 double, x1 double, x2 double, x3 double")


@pytest.mark.parametrize("share", [0.15, 0.3, 0.4, 0.45])
def test_junk_of_nearly_half_a_group_is_rejected(spark, share):
    rng = np.random.default_rng(3)
    n = int(2000 * share)
    clean = rng.multivariate_normal([1.6, -3.5, 0.96, 0.3], np.diag([0.02, 0.1, 0.01, 0.02]) ** 2, 2000 - n)
    junk = np.column_stack([rng.normal(1.5, 0.2, n), rng.normal(-1.5, 0.5, n), rng.normal(0.9, 0.05, n), rng.uniform(0, 0.5, n)])
    e = rules.estimates(frame(spark, np.concatenate([clean, junk])), ["g"]).first()["e"]
    m, c = np.array(e["m"]), np.array(e["c"]).reshape(D, D)
    assert np.abs((m - clean.mean(axis=0)) / clean.std(axis=0)).max() < 0.2 and (np.abs(np.sqrt(np.diag(c)) / clean.std(axis=0) - 1) < 0.2).all()
    v = np.array(e["v"]).reshape(D, D)
    assert np.allclose(v.T @ v, np.linalg.inv(c), rtol=1e-6)
    cut = rules.chi_square(1e-7)
    assert (d2(junk, m, c) > cut).mean() > 0.98 and (d2(clean, m, c) <= cut).all()


def test_correlated_parts_are_judged_together(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (1500, 1))
    clean = np.concatenate([base, base, rng.normal(0, 1, (1500, 2))], axis=1) * 0.1 + rng.normal(0, 0.01, (1500, 4))
    e = rules.estimates(frame(spark, clean), ["g"]).first()["e"]
    m, c = np.array(e["m"]), np.array(e["c"]).reshape(D, D)
    odd = np.array([[0.15, -0.15, 0, 0]])  # each part is usual, the pair is not
    assert d2(odd, m, c)[0] > rules.chi_square(1e-7) and (d2(clean, m, c) <= rules.chi_square(1e-7)).all()


def test_small_groups_and_groups_of_copies(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "vita", "ron", "del", "x", "")]
    text = lambda n: " ".join(rng.choice(words) + ("," if rng.random() < 0.1 else "") for _ in range(n))
    one = text(120)
    rows = [(i, text(int(rng.integers(40, 300))), "en", "big") for i in range(300)] + [(1000 + i, one, "en", "copies") for i in range(60)] + [(2000 + i, text(100), "en", "copies") for i in range(20)]
    rows += [(3000, text(90), "xx", "single"), (3001, "### $$$ &&& ||| " * 3 + text(30).replace("a", "#"), "yy", "single"), (3002, None, None, None), (3003, "", "zz", "single")]
    got = {r.doc_id: r for r in rules.documents_judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in [*range(300), *range(1000, 1060), *range(2000, 2020), 3000])
    assert not got[3001].kept and not got[3001].base_failed and got[3002].base_failed and got[3003].base_failed

    assert abs(rules.chi_square(0.05) - 9.488) < 0.01 and abs(rules.consistency(0.75) - 1.487) < 0.001
