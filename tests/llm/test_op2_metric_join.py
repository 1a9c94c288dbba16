import numpy as np
import pytest
from fixtures import SF, components, same
from polyglint.llm import metric_join
from polyglint.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, limit=0.95):
    """Links, components and survivors by comparing everything with everything."""
    ok = [v is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
          for i, v, *_ in data]
    n = len(data)
    links, count = [], [0] * n
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and len(data[a][1]) == len(data[b][1]):
                x, y = (np.array(data[k][1], np.float32).astype(np.float64) for k in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= limit:
                    links.append((a, b))
                    count[a] += 1
                    count[b] += 1
    first = {}
    for k, (i, *_) in enumerate(data):
        if ok[k]:
            links.append((k, first.setdefault(i, k)))
    comp = components(n, links)
    out = []
    for k, (i, *_) in enumerate(data):
        own = [data[j][0] for j in range(n) if comp[j] == comp[k] and ok[j]] if ok[k] else [i]
        c = min(own) if i is not None else None
        out.append((i, count[k], c, i is None or i == c))
    return out


def cloud(seed=3):
    rnd = np.random.default_rng(seed)
    data, centre = [], rnd.normal(size=(6, 12))
    for i in range(260):
        spread = [0.02, 0.08, 0.12, 0.3, 0.05, 1.0][i % 6]
        v = centre[i % 6] + spread * rnd.normal(size=12) * np.linalg.norm(centre[i % 6]) / 3
        data.append((i, [float(np.float32(x)) for x in v], 0))
    data += [(1000 + i, data[0][1], 1) for i in range(40)]                     # copies
    data += [(2000, None, 0), (2001, [0.0] * 12, 0), (2002, [float("nan")] + [1.0] * 11, 0), (2003, [], 0),
             (2004, [None] + [1.0] * 11, 0), (2005, [float("inf")] * 12, 0), (None, data[0][1], 0),
             (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (2008, [-x for x in data[0][1]], 0),
             (2009, [3 * x for x in data[1][1]], 0), (2010, data[3][1], 0), (2010, data[4][1], 0)]
    return data


@pytest.mark.parametrize("cell", [4, 50, 4096])
def test_matches_brute_force(spark, cell):
    data = cloud()
    got = metric_join.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4), homes_per_cell=cell)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    same(got.collect(), brute(data))


def test_limit_is_exact(spark):
    """Pairs at and just below the limit, whichever way products are summed."""
    data = [(0, [1.0, 0.0], 0), (1, [0.6, 0.8], 0), (2, [0.8, 0.6], 0), (3, [4.0, 3.0], 0)]
    got = {r.vec_id: r.n_links for r in metric_join.near_duplicates(
        spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), min_cosine=0.8).collect()}
    assert got[3] == 3 and got[0] >= 1


def test_query_and_empty(spark):
    rows = QUERIES["op2_embedding_near_dedup"](spark, SF).collect()
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    same(rows, brute([(r.vec_id, r.embedding) for r in df.collect()]))
    assert metric_join.near_duplicates(df.limit(0)).count() == 0


def test_dense_group_is_not_compared(spark):
    rnd = np.random.default_rng(5)
    c = rnd.normal(size=16)
    data = [(i, [float(np.float32(x)) for x in c + 0.001 * rnd.normal(size=16)], 0) for i in range(400)]
    got = metric_join.near_duplicates(spark.createDataFrame(data, SCHEMA), homes_per_cell=40).collect()
    assert all(r.n_links == 399 and r.component_id == 0 for r in got)


def test_an_id_with_two_vectors_seen_nowhere_else(spark):
    """Counts are of vectors, also where one id is the least of two of them."""
    x, y, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.01, 0.0]
    df = spark.createDataFrame([(1, x), (1, y), (3, near)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in metric_join.near_duplicates(df).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (3, 1, 1)]
    # and two vectors of one id that are linked with each other
    df = spark.createDataFrame([(5, x), (5, near), (2, y), (9, y), (9, near)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in metric_join.near_duplicates(df).collect())
    assert got == [(2, 1, 2), (5, 2, 2), (5, 2, 2), (9, 1, 2), (9, 2, 2)]


def test_vectors_of_two_cells_meet_once(spark, monkeypatch):
    """Vectors as far from each other as random ones can't be kept apart; of two in
    different cells one visits the other, and the link counts for both."""
    rnd = np.random.default_rng(7)
    data = [(i, [float(np.float32(x)) for x in rnd.normal(size=32)], 0) for i in range(600)]
    data += [(1000 + i, [float(np.float32(x * (1 + 0.1 * rnd.normal()))) for x in data[i][1]], 0) for i in range(0, 600, 3)]
    sent, plain = [], metric_join.map_arrow

    def seen(df, fn, schema, keeps=None):
        out = plain(df, fn, schema, keeps)
        if "piece" in out.columns:
            sent.append(out)
        return out

    monkeypatch.setattr(metric_join, "map_arrow", seen)
    got = metric_join.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4), homes_per_cell=40).collect()
    same(got, brute(data))
    assert sum(r.n_links for r in got) > 200
    cells = -(-len(data) // 40)
    assert sent[0].count() < 0.6 * len(data) * cells
