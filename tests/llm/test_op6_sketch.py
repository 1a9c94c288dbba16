import hashlib

import numpy as np
import pytest
from fixtures import DOCS, SF, docs, given, same, with_extra
from polyglint.llm import sketch
from polyglint.llm.queries import QUERIES


BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def plain_hash(shingle):
    """Polynomial over the bytes plus their number, then two rounds of mixing."""
    h = sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(shingle)) + len(shingle)
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h &= MASK
        h = (h ^ (h >> 33)) * by
    h &= MASK
    return h ^ (h >> 33)


def plain_sketch(text):
    """(hashes below an eighth, all hashes or None, filter or None) of a text, with sets."""
    words = text.encode().lower().split()
    n = min(5, len(words))
    every = {plain_hash(b" ".join(words[i:i + n])) for i in range(len(words) - n + 1)} if words else set()
    low = {h for h in every if h < 1 << 61}
    if len(every) <= 64 or not low:
        return low, every, None
    size = 8
    while size < 8 * len(every):
        size *= 2
    places = {(h + k * (h >> 32 | 1)) % size for h in every for k in range(5)}
    return low, None, (size, places)


def plain_likeness(a, b):
    count = lambda s: len(s[0]) * 8 if s[1] is None else len(s[1])
    if not count(a) and not count(b):
        return 1.0
    a, b = (a, b) if count(a) <= count(b) else (b, a)
    if a[1] is None:
        return len(a[0] & b[0]) / len(a[0])
    if not a[1]:
        return 0.0
    if b[1] is not None:
        return len(a[1] & b[1]) / len(a[1])
    size, places = b[2]
    inside = [h for h in a[1] if (h in b[0] if h < 1 << 61 else all((h + k * (h >> 32 | 1)) % size in places for k in range(5)))]
    return len(inside) / len(a[1])


def plain_text(s):
    hashes = lambda x: "".join(f"{h:016x}" for h in sorted(x))
    if s[1] is not None:
        return hashes(s[0]) + "+" + hashes(s[1] - s[0]) if s[1] else ""
    size, places = s[2]
    return hashes(s[0]) + "/" + "".join(f"{sum((8 * i + k in places) << (7 - k) for k in range(8)):02x}" for i in range(size // 8))


def brute(data):
    """The corpus order, its edits and their sketches, one row after the other."""
    data = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for k, (i, t) in enumerate(data):
        t, nxt = t or "", data[(k + 1) % len(data)][1] or ""
        half = len(t) // 2
        new = t[:len(t) - half] + nxt[:half]
        a, b, c = (plain_sketch(x) for x in (t, new, nxt))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), plain_text(a), plain_text(b),
                    plain_likeness(a, b), plain_likeness(a, c)))
    return out


def test_matches_brute_force(spark):
    df = docs(spark)
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    same(sketch.fingerprint(with_extra(df)).collect(), want)
    same(QUERIES["op6_fingerprint"](spark, SF).collect(), brute([(r.doc_id, r.text) for r in given(spark).collect()]))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_tables(spark, n):
    data = [(5 - i, f"text number {i} of a few words", "en", "a", 0) for i in range(n)]
    same(sketch.fingerprint(spark.createDataFrame(data, DOCS)).collect(), brute([r[:2] for r in data]))


def test_shingles_are_of_the_same_words():
    a = sketch.shingle_hashes("A b c d e f")
    assert len(a) == 2 and (a == sketch.shingle_hashes(" a  B\nc d\te f")).all()
    assert a[1] == sketch.shingle_hashes("b c d e f")[0] and a[0] != a[1]
    assert len(sketch.shingle_hashes("")) == 0 and len(sketch.shingle_hashes("one two")) == 1
    many = sketch.shingle_hashes(" ".join(f"w{i}" for i in range(50_000)))
    assert len(np.unique(many)) == len(many) and abs((many < 1 << 61).mean() - 1 / 8) < 0.01


def test_sketches_merge_and_estimate_containment():
    words = [f"w{i}" for i in range(20_000)]
    whole, part = sketch.sketch(" ".join(words)), sketch.sketch(" ".join(words[5000:7000]))
    assert sketch.containment(part, whole) == 1.0 and sketch.containment(whole, part) == pytest.approx(0.1, abs=0.03)
    halves = sketch.merge(sketch.sketch(" ".join(words[:10_004])), sketch.sketch(" ".join(words[10_000:])))
    assert (halves.low == whole.low).all()
    for n in (5, 30, 3000):
        some = sketch.sketch(" ".join(words[9_000:9_000 + n]))
        assert sketch.containment(some, halves) == 1.0
        back = sketch.from_text(sketch.to_text(some))
        assert sketch.to_text(back) == sketch.to_text(some) and sketch.containment(back, whole) == 1.0
    tiny = [sketch.sketch(" ".join(words[k:k + 12])) for k in (0, 100, 200)]
    merged = sketch.merge(sketch.merge(tiny[0], tiny[1]), tiny[2])
    assert merged.rest is not None and all(sketch.containment(t, merged) == 1.0 for t in tiny)
    both = sketch.merge(merged, whole)
    assert (both.low == whole.low).all() and all(sketch.containment(t, both) == 1.0 for t in tiny)


@pytest.mark.parametrize("long", [50, 500, 5000])
def test_a_short_text_inside_a_long_one_is_found_whole(long):
    """And one of other words hardly ever."""
    import random
    rnd = random.Random(long)
    found = strange = n = 0
    for _ in range(40):
        words = [f"w{rnd.randrange(100_000)}" for _ in range(long)]
        whole = sketch.sketch(" ".join(words))
        for short in (5, 7, 20):
            at = rnd.randrange(long - short + 1)
            found += sketch.likeness(sketch.sketch(" ".join(words[at:at + short])), whole) == 1.0
            strange += sketch.likeness(sketch.sketch(" ".join(f"v{rnd.randrange(100_000)}" for _ in range(short))), whole)
            n += 1
    assert found == n and strange / n < 0.03
