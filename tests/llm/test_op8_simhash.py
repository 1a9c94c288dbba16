import random

import numpy as np
import pytest
import xxhash
from fixtures import DOCS, SF, components, docs, given, same, with_extra
from polyglint.llm import simhash
from polyglint.llm.components import connected_components
from polyglint.llm.queries import QUERIES


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(data, limit=3):
    fps = [slow_fingerprint(t) for _, t in data]
    links, seen = [], {}
    for a in range(len(data)):
        if data[a][0] is None:
            continue
        links += [(a, b) for b in range(a) if data[b][0] is not None and (fps[a] ^ fps[b]).bit_count() <= limit]
        links.append((a, seen.setdefault(data[a][0], a)))
    comp = components(len(data), links)
    least = {}
    for (i, _), c in zip(data, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [(i, f"{f:016x}", least.get(c) if i is not None else None) for (i, _), f, c in zip(data, fps, comp)]


def test_matches_brute_force(spark):
    df = docs(spark)
    same(simhash.near_duplicates(with_extra(df)).collect(), brute([(r.doc_id, r.text) for r in df.collect()]))
    same(QUERIES["op8_simhash_near_dedup"](spark, SF).collect(), brute([(r.doc_id, r.text) for r in given(spark).collect()]))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def clouds(seed, n, flips):
    """Fingerprints around a few centres, a chain, and random ones."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(3)]
    out = set(centres) | {rnd.getrandbits(64) for _ in range(50)}
    for _ in range(n):
        x = rnd.choice(centres)
        for _ in range(rnd.randint(0, flips)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    x = 0
    for k in range(0, 63, 3):
        out.add(x)
        x |= 7 << k
    return sorted(out)


@pytest.mark.parametrize("node_rows", [8, 1024])
@pytest.mark.parametrize("n,flips", [(300, 6), (1500, 10)])
def test_index_join_loses_no_link(spark, n, flips, node_rows):
    fps = clouds(n, n, flips)
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    want = components(len(fps), zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
    reps = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "rep long, fp long")
    links = simhash.hamming_links(reps, node_rows=node_rows).collect()
    assert all(near[r.u, r.v] or want[r.u] == want[r.v] for r in links)
    assert components(len(fps), [(r.u, r.v) for r in links]) == want


def test_gray_order_neighbours():
    codes = np.array([i ^ i >> 1 for i in range(200)], np.uint64)
    assert (simhash.gray_rank(codes) == np.arange(200)).all()


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, 600 + i) for i in range(100)]
    want = components(800, links)
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {i: c for i, c in enumerate(want) if want.count(c) > 1}
    assert connected_components(df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    data = [(4, "a b c d e f g", "en", "x", 1), (2, "a b c d e f g", "en", "y", 2), (9, "other words stand here now", "en", "x", 3),
            (9, "other words stand here now", "en", "x", 3), (None, "nameless", "en", "x", 4), (None, "nameless", "en", "x", 4),
            (9, "yet another text under one id", "en", "x", 5), (None, "a b c d e f g", "en", "x", 6), (7, None, "en", "x", 7), (8, "", "en", "x", 8)]
    kept = simhash.keep_one(with_extra(spark.createDataFrame(data, DOCS)))
    assert kept.columns == with_extra(spark.createDataFrame(data, DOCS)).columns
    same([tuple(r)[:2] for r in kept.collect()], [(2, "a b c d e f g"), (9, "other words stand here now"), (None, "nameless"), (9, "yet another text under one id"), (7, None)])
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0
