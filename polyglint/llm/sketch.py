"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's sketch holds every shingle hash below a fixed fraction of the hash
range, however long the text is.  Sketches of parts merge into the sketch of
the whole, and the share of one sketch that another holds estimates how much
of the one text the other contains, also between very unequal lengths.

Of a short text too few hashes are below the fraction to tell anything.  Its
sketch therefore holds all its hashes, and that of a long text, beside the
retained ones, a Bloom filter of all of them, against which a short text is held.
A short text inside a long one is thus always found whole; what isn't in it is
taken for a part with the filter's chance of at most about two in a hundred.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_ranges, map_arrow

WORDS = 5                  # words of a shingle; a shorter text is one shingle
FRACTION = 1 / 8           # of the hash range that is retained
SHORT = 64                 # different shingles up to which a text is short
BITS_A_HASH = 8            # of the filter of a long text, at least
PROBES = 5                 # bits of a hash in it

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64, for n bytes."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = 1 << max(16, n.bit_length())
        _POWERS[:] = []
        for b in (_BASE, _INVERSE):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """A 64-bit hash of every run of ``words`` words, in ASCII lower case."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    line = np.frombuffer(b" ".join(w), np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _powers(len(line) + 1)
    total = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(line * up[:len(line)], out=total[1:])
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(w))
    s, e = starts[:len(w) - k + 1], ends[k - 1:]
    h = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


@dataclass(frozen=True)
class Sketch:
    """``low``: the sorted distinct hashes below the fraction.  ``rest``: all other
    hashes of a short text, None of a long one.  ``bloom``: the filter of all
    hashes of a long text, as bytes of a power-of-two number."""

    low: np.ndarray
    rest: np.ndarray | None
    bloom: np.ndarray | None = None

    @property
    def everything(self) -> np.ndarray:
        """All hashes of a short text."""
        return np.concatenate([self.low, self.rest])


def _bits(h: np.ndarray, size: int) -> np.ndarray:
    """The bit places of hashes in a filter of ``size`` bits: one row a probe."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & np.uint64(size - 1)


def _bloom(h: np.ndarray, size: int) -> np.ndarray:
    bits = np.zeros(size, np.uint8)
    bits[_bits(h, size).ravel()] = 1
    return np.packbits(bits)


def _in_bloom(h: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    at = _bits(h, 8 * len(bloom))
    return (bloom[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _limit(fraction: float) -> np.uint64:
    return np.uint64(int(fraction * 2.0 ** 64))


def sketch(text: str, words: int = WORDS, fraction: float = FRACTION, short: int = SHORT) -> Sketch:
    """The sketch of a text; without hashes where it has no words.  A text of at
    most ``short`` different shingles is short."""
    return _sketch(np.unique(shingle_hashes(text, words)), fraction, short)


def _sketch(h: np.ndarray, fraction: float, short: int) -> Sketch:
    low = h[h < _limit(fraction)]
    # a long text none of whose hashes is low would have no estimate
    if len(h) <= short or not len(low):
        return Sketch(low, h[len(low):])
    return Sketch(low, None, _bloom(h, BITS_A_HASH << (len(h) - 1).bit_length()))


def merge(a: Sketch, b: Sketch, fraction: float = FRACTION, short: int = SHORT) -> Sketch:
    """The sketch of all shingles of two texts, from their sketches.  The retained
    hashes are just those of the whole; its filter may be smaller than one made
    at once, never missing anything."""
    if a.rest is not None and b.rest is not None:
        return _sketch(np.union1d(a.everything, b.everything), fraction, short)
    size = max(8 * len(x.bloom) for x in (a, b) if x.bloom is not None)
    # the places of a smaller filter are those of a larger one, modulo its size
    blooms = [_bloom(x.everything, size) if x.bloom is None else np.tile(x.bloom, size // (8 * len(x.bloom))) for x in (a, b)]
    return Sketch(np.union1d(a.low, b.low), None, blooms[0] | blooms[1])


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the shingles of a that b has too; of a short a, counted."""
    if a.rest is None:
        return len(np.intersect1d(a.low, b.low, assume_unique=True)) / len(a.low)
    mine = a.everything
    if not len(mine):
        return 0.0
    if b.rest is not None:
        return len(np.intersect1d(mine, b.everything, assume_unique=True)) / len(mine)
    # what is below the fraction is known for certain
    held = len(np.intersect1d(a.low, b.low, assume_unique=True)) + int(_in_bloom(a.rest, b.bloom).sum())
    return held / len(mine)


def n_shingles(sk: Sketch, fraction: float = FRACTION) -> float:
    """Different shingles of a text, estimated of a long one."""
    return len(sk.low) / fraction if sk.rest is None else len(sk.low) + len(sk.rest)


def likeness(a: Sketch, b: Sketch, fraction: float = FRACTION) -> float:
    """Containment of the text of fewer shingles in the other; 1 for two texts
    without words."""
    n, m = n_shingles(a, fraction), n_shingles(b, fraction)
    if not n and not m:
        return 1.0
    return containment(a, b) if n <= m else containment(b, a)


def to_text(sk: Sketch) -> str:
    """Hexadecimal: the retained hashes, then "+" and the others of a short text
    or "/" and the filter of a long one; empty for no words."""
    if not n_shingles(sk):
        return ""
    hashes = lambda h: h.astype(">u8").tobytes().hex()
    return hashes(sk.low) + ("/" + sk.bloom.tobytes().hex() if sk.rest is None else "+" + hashes(sk.rest))


def from_text(s: str) -> Sketch:
    hashes = lambda x: np.frombuffer(bytes.fromhex(x), ">u8").astype(np.uint64)
    if "/" in s:
        low, bloom = s.split("/")
        return Sketch(hashes(low), None, np.frombuffer(bytes.fromhex(bloom), np.uint8))
    low, _, rest = s.partition("+")
    return Sketch(hashes(low), hashes(rest))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt into ranges of ascending id, each range with the row that
    follows its last one (marked ``guest``; after the last range, the first
    row).  Rows without an id come first; rows of one id follow each other in
    the order of their texts.  Texts are shuffled once."""
    rows = id_ranges(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                 F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id", "range")
    # one row for each range; there are a few for each shuffle partition
    firsts = sorted((r["range"], r["least"], r["nameless"]) for r in rows.groupBy("range").agg(
        F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nameless")).collect())
    before = [(r, None if nameless else least, firsts[k - 1][0]) for k, (r, least, nameless) in enumerate(firsts)]
    spark = docs.sparkSession
    heads = F.broadcast(spark.createDataFrame(before, "range int, head long, guest_of int"))
    seats = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(
        F.struct(F.col("range"), F.lit(False).alias("guest")),
        F.struct(F.col("guest_of").alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(
            F.struct(F.col("range"), F.lit(False).alias("guest"))))
    dealt = rows.join(heads, "range").select("doc_id", "text", F.explode(seats).alias("seat")).select(
        "seat.range", "seat.guest", "doc_id", "text")
    return dealt.repartition(F.col("range")).sortWithinPartitions(
        "range", "guest", F.col("doc_id").asc_nulls_first(), "text")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the next one's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                fraction: float = FRACTION, batch: int = 512) -> DataFrame:
    """One row per input row: the fingerprint of its whole text and of its
    edited text, and their likeness to it and to the next document's.

    Null and empty texts have an empty fingerprint; two empty ones are alike.
    A table of one row has itself as the next.  Repeated rows have equal
    fingerprints; very long texts have longer ones (about 16 hexadecimal digits
    for 8 shingles retained, and 2 to 4 a shingle of the filter).  Other columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None            # the last row: its range, id, text and sketch
        rows: list[tuple] = []
        for b in it:
            for r, guest, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(),
                                        b.column(3)):
                if held is not None and held[0] == r:
                    t = t.as_py()
                    sk = sketch(t, words, fraction)
                    _, own, text, mine = held
                    new = edited(text, t)
                    changed = mine if new == text else sketch(new, words, fraction)
                    rows.append((own, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                                 to_text(mine), to_text(changed), likeness(mine, changed, fraction), likeness(mine, sk, fraction)))
                    held = None if guest else (r, key, t, sk)
                elif not guest:
                    t = t.as_py()
                    held = (r, key, t, sketch(t, words, fraction))
                if len(rows) >= batch:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return map_arrow(with_next(docs, id_col, text_col), run,
                     "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                     "edited_fingerprint string, near_edited double, near_next double")
