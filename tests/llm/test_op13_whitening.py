import math

import numpy as np
import pytest
from fixtures import EXTRA, with_extra
from polyglint.llm import whitening as W
from polyglint.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
VECS = "vec_id long, embedding array<float>, label int"


def counted(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) and abs(c) < 2.0 ** 43 for c in v)


def plain(vectors, k=8):
    """Integers, exact deviations, eigenvalues and projections of all vectors of one length."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    dev = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    z = np.array(dev, float) / n
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1], q[:, ::-1]
    return [sum(v * v for v in r) for r in dev], e, z @ q[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300))


def agrees(rows, vectors, ids):
    dev, e, w = plain(vectors)
    k = int((e > 1e-12 * e[0]).sum().clip(max=8))
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(rows) == k * len(ids)
    signs = [np.sign(sum(by[i, c + 1].whitened * w[j, c] for j, i in enumerate(ids))) for c in range(k)]
    for j, i in enumerate(ids):
        for c in range(k):
            r = by[i, c + 1]
            assert (r.n, r.deviation) == (len(ids), dev[j])
            assert abs(r.whitened * signs[c] - w[j, c]) < 1e-8
            assert abs(r.explained - e[c] / e.sum()) < 1e-10
            assert r.identity_error < 1e-8


def test_query_matches_plain_eigenvectors(spark):
    got = QUERIES["op13_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    agrees(got.collect(), [r.embedding for r in given], [r.vec_id for r in given])


def test_awkward_vectors(spark):
    rnd = np.random.default_rng(1)
    data = [(i, [float(c) for c in rnd.normal(size=6) * [3, 2, 1, 1, .5, .1]], 0) for i in range(60)]
    data += [(100 + i, data[0][1], 1) for i in range(40)]                       # a vector that a third of all rows hold
    bad = [(200, None, 0), (201, [], 0), (202, [1.0, None, 0, 0, 0, 0], 0), (203, [float("nan")] * 6, 0),
           (204, [float("inf"), 0, 0, 0, 0, 0], 0), (205, [1e20, 0, 0, 0, 0, 0], 0)]
    bad = [(i, v if v is None else [None if c is None else float(c) for c in v], t) for i, v, t in bad]
    assert not any(counted(v) for _, v, _ in bad)
    df = with_extra(spark.createDataFrame(data + bad, VECS).repartition(5))
    got = W.components(df).collect()
    floats = [[float(np.float32(c)) for c in v] for _, v, _ in data]
    agrees(got, floats, [i for i, _, _ in data])
    kept = W.whiten(df)
    assert set(EXTRA) <= set(kept.columns) and kept.count() == len(data)
    assert kept.where("vec_id = 100").first()["score"] == "clash"


def test_lengths_apart_null_and_repeated_ids(spark):
    rnd = np.random.default_rng(2)
    short = [(i, [float(c) for c in rnd.normal(size=3)], 0) for i in range(20)]
    long = [(100 + i, [float(c) for c in rnd.normal(size=10)], 0) for i in range(30)]
    rows = W.components(spark.createDataFrame(short + long, VECS)).collect()
    assert {r.component for r in rows if r.vec_id < 100} == {1, 2, 3} and {r.n for r in rows if r.vec_id < 100} == {20}
    assert {r.component for r in rows if r.vec_id >= 100} == set(range(1, 9))
    again = W.whiten(spark.createDataFrame([(None, v, t) for _, v, t in short] + short, VECS))
    assert again.count() == 40 and again.where("vec_id is null").count() == 20 and again.first()["n"] == 40


def test_no_variance_and_empty(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, VECS)
    assert W.components(one).count() == 0
    assert [(r.n, r.deviation, r.whitened) for r in W.whiten(one).collect()] == [(3, 0, [])] * 3
    empty = spark.createDataFrame([], VECS)
    assert W.components(empty).count() == 0 and W.whiten(empty).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e6])
def test_rank_one_updates_keep_the_spectrum(scale):
    rnd = np.random.default_rng(3)
    d = 24
    z = rnd.normal(size=(200, d)) * np.logspace(0, -6, d) * scale
    z[50:90] = z[50]                           # repeats deflate
    z[:, 5] = 0                                # a direction without weight
    s, m = W.Spectrum.zero(d), np.zeros((d, d))
    for k, v in enumerate(z):
        s.add(v)
        m += np.outer(v, v)
        if k % 40 == 0 or k == len(z) - 1:
            top = np.linalg.eigvalsh(m)[-1]
            assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12
            assert np.abs((s.vectors * s.values) @ s.vectors.T - m).max() < 1e-12 * top
            assert np.abs(s.values - np.linalg.eigvalsh(m)).max() < 1e-12 * top


def test_secular_roots_lie_between_the_poles():
    rnd = np.random.default_rng(4)
    for _ in range(50):
        d = np.sort(rnd.normal(size=12))
        w2 = 10.0 ** rnd.uniform(-12, 2, size=12)
        pole, mu = W.secular_roots(d, w2)
        roots = d[pole] + mu
        assert (roots > d).all() and (roots[:-1] < d[1:]).all()
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(w2), np.sqrt(w2))), atol=1e-10 * (1 + w2.sum()))


def test_spectra_of_partitions_combine():
    rnd = np.random.default_rng(5)
    a, b = rnd.normal(size=(30, 7)), rnd.normal(size=(50, 7))
    spectra = []
    for z in (a, b):
        s = W.Spectrum.zero(7)
        for v in z:
            s.add(v)
        spectra.append((s.values, s.vectors.ravel()))
    values, _ = W._combined(spectra)
    assert np.allclose(values, np.linalg.eigvalsh(a.T @ a + b.T @ b), rtol=1e-12)


def test_tree_of_more_partitions_than_one_task_combines(spark):
    rnd = np.random.default_rng(6)
    data = [(i, [float(c) for c in rnd.normal(size=5)], 0) for i in range(400)]
    models, parts = W.fit(spark.createDataFrame(data, VECS).repartition(40))
    dev, e, _ = plain([[float(np.float32(c)) for c in v] for _, v, _ in data])
    assert parts > W.FAN and np.allclose(models[5].values, e[:5], rtol=1e-10)


def test_deviations_beyond_64_bits_are_exact_or_null():
    s = W.Sums(1 << 40, (5, -7))
    x = np.array([[1 << 40, 3], [1, 2]])
    dev = s.deviations(x)
    assert dev.tolist() == [[(1 << 80) - 5, 3 * (1 << 40) + 7], [(1 << 40) - 5, (1 << 41) + 7]]
    assert W.squares(dev)[0] is None
    assert W.squares(np.array([[3, 4]])) == [25]
