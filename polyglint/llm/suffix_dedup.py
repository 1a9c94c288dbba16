"""Repeated passages removed, by prefix-free parsing of the corpus.

Every byte that a string of ``WINDOW`` bytes covers goes if that string also
starts earlier in the corpus: in a document before, or before it in the same one.

Parsing.  A rolling hash of ``GRAM`` bytes gives every window its trigger: the
gram in it with the least hash, the first of these.  The stretch of windows with
one trigger is a phrase; consecutive phrases overlap by ``WINDOW - 1`` bytes, so
that each window lies in one phrase, and equal windows have equal triggers at
equal places.  The dictionary holds each phrase once, with its first place in the
corpus; the parse is the list of all places.  A phrase that occurs again repeats
all its windows, whatever stands around it.

Suffixes.  Two different phrases can share windows only if they share their
trigger.  For each trigger with several phrases, the suffixes of its phrases
(those of at least a window) are sorted by their content; equal windows are
neighbours in this suffix array, and all but the first in corpus order repeat.
A trigger with very many phrases isn't sorted in one place: its windows are dealt
out by a hash of their content instead.

Each task first settles what repeats inside its own block of phrases, so that a
passage of a third of all documents sends one phrase for each block.  Texts move
twice, compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, written

WINDOW = 100               # bytes of a string that must not repeat
GRAM = 32                  # bytes of a trigger; a power of two
PIECE = 1 << 19            # bytes parsed together; positions in a piece have 20 bits
BLOCK = 1 << 20            # phrases that a task settles by itself at a time
PHRASES_PER_TRIGGER = 256  # of a trigger whose suffixes are sorted in one place
NO_ID = -(1 << 63)

_LOW = np.uint64((1 << 20) - 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """The hash of the gram that starts at each byte."""
    h = b.astype(np.uint64) + np.uint64(1)
    base, width = 0x100000001B3, 1
    while width < GRAM:        # polynomial hash of twice the width from two of the width
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base & (1 << 64) - 1, 2 * width
    return _mixed(h)


def parse(b: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The phrases of a piece of at most 2 ** 20 bytes: trigger hash, content
    hash, start, bytes.  ``whole``: the windows that lie inside one document."""
    n = len(b) - WINDOW + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    h = _gram_hashes(b)
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)   # of equal hashes the first
    span, width = WINDOW - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width:][:n])
    trigger = (least & _LOW).astype(np.int64)
    if whole is not None:
        trigger[~whole] = -1
    start = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
    size = np.diff(np.append(start, n)) + WINDOW - 1
    real = trigger[start] >= 0
    start, size = start[real], size[real]
    # three stretches of two grams cover a phrase
    two = _mixed(h[:-GRAM] * _A ^ (h[GRAM:] * _B) ^ (h[GRAM:] >> np.uint64(29)))
    content = _mixed(two[start] * _A ^ two[start + (size - 2 * GRAM) // 2] * _B ^ two[start + size - 2 * GRAM] * _C
                     ^ size.astype(np.uint64))
    return h[trigger[start]], content, start, size


def _pieces(rows: Iterator[tuple[int, int, bytes]], piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases of documents (id, tie, bytes): trigger, content, id, place.

    A place is tie, start and bytes in one number, which sorts as they do."""
    held: list[np.ndarray] = []
    ids, ties, offs, size = [], [], [], 0

    def flush():
        nonlocal held, ids, ties, offs, size
        if not held:
            return None
        lens = np.array([len(x) for x in held])
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        doc = np.repeat(np.arange(len(held)), lens)
        b = np.concatenate(held)
        whole = doc[:len(b) - WINDOW + 1] == doc[WINDOW - 1:] if len(b) >= WINDOW else None
        t, c, s, n = parse(b, whole)
        d = doc[s]
        out = (t.view(np.int64), c.view(np.int64), np.array(ids, np.int64)[d],
               place(np.array(ties, np.int64)[d], s - first[d] + np.array(offs, np.int64)[d], n))
        held, ids, ties, offs, size = [], [], [], [], 0
        return out

    for i, tie, raw in rows:
        b = np.frombuffer(raw, np.uint8)
        for off in range(0, max(1, len(b) - WINDOW + 1), piece):
            part = b[off:off + piece + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            if size and size + len(part) > piece + 2 * WINDOW:
                yield flush()
            held.append(part)
            ids.append(i)
            ties.append(tie)
            offs.append(off)
            size += len(part)
    if (out := flush()) is not None:
        yield out


def place(tie, start, size):
    return (tie << 40) | (start << 8) | size


def _tie(p):
    return p >> 40


def _start(p):
    return (p >> 8) & 0xFFFFFFFF


def _size(p):
    return p & 0xFF


def _joined(ids: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of the same document that touch or overlap become one."""
    order = np.lexsort((start, tie, ids))
    ids, tie, start, end = ids[order], tie[order], start[order], end[order]
    if not len(ids):
        return ids, tie, start, end
    doc = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tie[1:] != tie[:-1])])
    # the furthest end so far inside each document
    shift = np.cumsum(doc).astype(np.int64) << 33
    far = np.maximum.accumulate(end + shift)
    new = doc.copy()
    new[1:] |= start[1:] + shift[1:] > far[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(ids)) - 1
    return ids[at], tie[at], start[at], far[last] - shift[last]


_ROW = "trigger long, content long, doc long, place long"
_NAMES = ["trigger", "content", "doc", "place"]


def _rows(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _NAMES)


def _settled(t, c, d, p) -> tuple[pa.RecordBatch, ...]:
    """First places inside a block, and the stretches that repeat there: rows
    of no size whose content is the end of the stretch."""
    order = np.lexsort((p, d, c, t))
    t, c, d, p = t[order], c[order], d[order], p[order]
    again = np.concatenate([[False], (t[1:] == t[:-1]) & (c[1:] == c[:-1])])
    same = np.concatenate([[False], again[1:] & (d[1:] == d[:-1]) & (p[1:] == p[:-1])])   # a row that occurs twice
    # a place is a repetition if the first one of its phrase is another place
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(t))))
    again &= ~((d == d[head]) & (p == p[head]))
    out = [_rows(*(x[~again & ~same] for x in (t, c, d, p)))]
    rd, rp = d[again], p[again]
    rd, tie, s, e = _joined(rd, _tie(rp), _start(rp), _start(rp) + _size(rp))
    if len(rd):
        out.append(_rows(_mixed(rd.view(np.uint64) ^ (s.view(np.uint64) * _A)).view(np.int64), e, rd, place(tie, s, 0)))
    return tuple(out)


def _blocks(parts: Iterator[tuple[np.ndarray, ...]], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for x in parts:
        held.append(x)
        size += len(x[0])
        if size >= block:
            yield from _settled(*(np.concatenate(c) for c in zip(*held)))
            held, size = [], 0
    if held:
        yield from _settled(*(np.concatenate(c) for c in zip(*held)))


def _resolve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by trigger, content, document and place -> stretches that
    repeat (no trigger) and, of triggers with several phrases, first places."""
    last = None                # trigger, content, document and place of the current phrase's first place
    shown = False              # whether that trigger is known to have several phrases
    for batch in it:
        t, c, d, p = (batch.column(i).to_numpy() for i in range(4))
        known = _size(p) == 0
        out_t, out_d, out_s, out_e = [None] * int(known.sum()), [d[known]], [p[known]], [c[known]]
        t, c, d, p = (x[~known] for x in (t, c, d, p))
        if len(t):
            if last is not None:
                t, c, d, p = (np.concatenate([[v], x]) for v, x in zip(last, (t, c, d, p)))
            new_t = np.concatenate([[True], t[1:] != t[:-1]])
            new_c = new_t | np.concatenate([[True], c[1:] != c[:-1]])
            head = np.maximum.accumulate(np.where(new_c, np.arange(len(t)), 0))
            again = ~new_c & ~((d == d[head]) & (p == p[head]))
            out_t += [None] * int(again.sum())
            out_d.append(d[again])
            out_s.append(p[again])
            out_e.append(_start(p[again]) + _size(p[again]))
            # first places of triggers with several phrases
            group = np.cumsum(new_t) - 1
            several = np.bincount(group, new_c)[group] > 1
            first = new_c & several
            if last is not None:
                if shown:      # the trigger carried over: what follows it is one more phrase
                    first |= new_c & (group == 0)
                    first[0] = False
            out_t += t[first].tolist()
            out_d.append(d[first])
            out_s.append(p[first])
            out_e.append(_start(p[first]) + _size(p[first]))
            h = head[-1]
            shown = bool(several[-1]) or (shown and last is not None and group[-1] == 0)
            last = (t[h], c[h], d[h], p[h])
        if out_t:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_t, pa.int64()), *(pa.array(np.concatenate(x), pa.int64()) for x in (out_d, out_s, out_e))],
                ["trigger", "doc", "place", "end"])


def _sorted_suffixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases sorted by trigger, document and place, with their bytes ->
    stretches of windows that an earlier phrase has."""
    held: list[tuple] = []

    def flush():
        if not held:
            return None
        _, d, p, raw = zip(*held)
        lens = np.array([len(x) for x in raw])
        b = np.frombuffer(b"".join(raw), np.uint8)
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        # suffixes of at least a window, in corpus order
        of = np.repeat(np.arange(len(raw)), lens - WINDOW + 1)
        within = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(lens - WINDOW + 1)[:-1]]), lens - WINDOW + 1)
        windows = np.lib.stride_tricks.sliding_window_view(b, WINDOW)[first[of] + within]
        order = np.argsort(np.ascontiguousarray(windows).view(np.dtype((np.void, WINDOW))).ravel(), kind="stable")
        ranked = windows[order]
        equal = np.concatenate([[False], (ranked[1:] == ranked[:-1]).all(axis=1)])
        d, p = np.array(d, np.int64), np.array(p, np.int64)
        start = _start(p)[of] + within
        head = order[np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))]
        # stable order: the head of equal windows is the first in corpus order
        other = (d[of[order]] != d[of[head]]) | (_tie(p)[of[order]] != _tie(p)[of[head]]) | (start[order] != start[head])
        rep = order[equal & other]
        rd, tie, s, e = _joined(d[of[rep]], _tie(p)[of[rep]], start[rep], start[rep] + WINDOW)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rd, place(tie, s, 0), e)],
                                          ["doc", "place", "end"])

    for batch in it:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and held[-1][0] != row[0]:
                yield flush()
            held.append(row)
    if held:
        yield flush()


def _expand(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                phrases_per_trigger: int = PHRASES_PER_TRIGGER, piece: int = PIECE, block: int = BLOCK,
                keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with
    kept (binary: the bytes that remain) if asked for.

    Null and empty texts have no bytes; nothing of a text under ``WINDOW`` bytes
    repeats.  Rows without an id come first; rows that repeat an id come in the
    order of 23 bits of a hash of their texts; of rows alike in both, one is the
    first.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(text).bitwiseAND((1 << 23) - 1).alias("tie"), text.alias("text"))

    def phrases(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, t, s.as_py().encode("utf-8", "surrogatepass")) for b in it
                for i, t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
        yield from _blocks(_pieces(rows, piece), block)

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(
                [squeeze(s.as_py().encode("utf-8", "surrogatepass")) for s in b.column(2)], pa.binary())],
                ["doc", "tie", "z"])

    texts = map_arrow(base, packed, "doc long, tie long, z binary")
    parse_rows = map_arrow(base, phrases, _ROW)
    found = written(map_arrow(parse_rows.repartition("trigger").sortWithinPartitions(*_NAMES), _resolve,
                              "trigger long, doc long, place long, end long"), "phrases")

    # phrases that share their trigger with others, with their bytes
    shared = found.where("trigger is not null")
    many = (shared.groupBy("trigger").count().where(F.col("count") > phrases_per_trigger)
            .select("trigger", F.lit(True).alias("many")))
    wanted = (shared.join(many, "trigger", "left")
              .groupBy("doc", F.shiftright("place", 40).alias("tie"))
              .agg(F.collect_list(F.struct("trigger", "place", F.coalesce("many", F.lit(False)).alias("many"))).alias("phrases")))

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases with bytes; of triggers with many phrases, windows by themselves."""
        for b in it:
            alone: list[tuple[np.ndarray, ...]] = []
            rows: list[tuple] = []
            for d, tie, z, ph in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                raw = _expand(z)
                for x in ph.as_py():
                    s, n = _start(x["place"]), _size(x["place"])
                    if not x["many"]:
                        rows.append((x["trigger"], None, d, x["place"], raw[s:s + n]))
                        continue
                    h = _gram_hashes(np.frombuffer(raw[s:s + n], np.uint8))
                    k = n - WINDOW + 1
                    # grams that cover a window
                    a, m, c, e = (h[at:][:k] for at in (0, GRAM, 2 * GRAM, WINDOW - GRAM))
                    one = _mixed(a * _A ^ c * _B ^ e * _C ^ _mixed(m))
                    two = _mixed(a * _C ^ m * _B ^ e * _A ^ _mixed(c + _A))
                    alone.append((one.view(np.int64), two.view(np.int64), np.full(k, d),
                                  place(tie, s + np.arange(k), WINDOW)))
            if alone:
                for out in _settled(*(np.concatenate(c) for c in zip(*alone))):
                    rows += [(*r, None) for r in zip(*(out.column(i).to_pylist() for i in range(4)))]
            for s in range(0, len(rows), 1 << 14):
                t, c, d, p, raw = zip(*rows[s:s + (1 << 14)])
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (t, c, d, p)), pa.array(raw, pa.binary())],
                                                 [*_NAMES, "raw"])

    bytes_of = written(map_arrow(texts.join(wanted, ["doc", "tie"]).select("doc", "tie", "z", "phrases"), fetch,
                                 _ROW + ", raw binary"), "phrase-bytes")
    by_suffix = map_arrow(bytes_of.where("raw is not null").select("trigger", "doc", "place", "raw")
                          .repartition("trigger").sortWithinPartitions("trigger", "doc", "place"),
                          _sorted_suffixes, "doc long, place long, end long")
    by_window = map_arrow(bytes_of.where("raw is null").select(*_NAMES).repartition("trigger")
                          .sortWithinPartitions(*_NAMES), _resolve, "trigger long, doc long, place long, end long")
    stretches = (found.where("trigger is null").select("doc", "place", "end").unionByName(by_suffix)
                 .unionByName(by_window.where("trigger is null").select("doc", "place", "end")))
    gone = stretches.groupBy("doc", F.shiftright("place", 40).alias("tie")).agg(F.collect_list(F.struct(
        F.shiftright("place", 8).bitwiseAND(0xFFFFFFFF).alias("s"), F.col("end").alias("e"))).alias("gone"))

    def remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for d, copy, z, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(),
                                         b.column(3)):
                raw = _expand(z)
                if copy > 1:
                    s, e = ([0], [len(raw)]) if len(raw) >= WINDOW else ([], [])
                elif spans.is_valid:
                    x = np.array([(v["s"], v["e"]) for v in spans.as_py()], np.int64).reshape(-1, 2)
                    zero = np.zeros(len(x), np.int64)
                    _, _, s, e = _joined(zero, zero, x[:, 0], x[:, 1])
                else:
                    s, e = [], []
                kept, at = [], 0
                for a, z in zip(s, e):
                    kept.append(raw[at:a])
                    at = z
                kept.append(raw[at:])
                left = b"".join(kept)
                for c, v in zip(cols, (None if d == NO_ID else d, len(raw), len(raw) - len(left), len(s),
                                       hashlib.sha256(left).hexdigest(), left)):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)][:5 + keep_text],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:5 + keep_text])

    copy = F.row_number().over(Window.partitionBy("doc", "tie").orderBy("doc"))
    return map_arrow(texts.withColumn("copy", copy).join(gone, ["doc", "tie"], "left").select("doc", "copy", "z", "gone"), remove,
                     "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                     + ", kept binary" * keep_text)
