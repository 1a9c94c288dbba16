"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are linked when few bits differ.  The upper nodes of the index
are shared masked patterns: each fingerprint is filed under ``max_bits + 1``
masks that split its bits, so two linked fingerprints agree on at least one of
them.  A node that stays large is split once more by masks over its remaining
bits.  Below, each node's fingerprints are sorted by Gray rank, so that
neighbours share most bits; runs of them form groups with the bits that all
members share as a masked pattern.  Pairs of groups are compared from the top,
and a pair goes as soon as the shared bits that differ exceed the limit.

What leaves a node is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import batches_of, fresh, map_arrow, written
from .components import connected_components
from .forest import Forest

SEED = 42
FANOUT = 16          # fingerprints or groups in a group of the next level
FRONTIER = 1 << 17   # pairs of groups looked at together
SMALL_NODE = 48      # nodes up to this size are compared without upper levels


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 of every run of ``words`` words of the text in ASCII lower case."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(w) - words + 1)


def fingerprints(texts: list[str], words: int = 3, chunk: int = 1 << 15) -> np.ndarray:
    """The fingerprint of each text: a bit is set where over half of its
    shingle hashes have it; a text without words has zero."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    for i, t in enumerate(texts):
        h = shingle_hashes(t, words)
        if not len(h):
            continue
        ones = np.zeros(64, np.int64)
        for s in range(0, len(h), chunk):
            part = h[s:s + chunk].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[i] = weights[ones * 2 > len(h)].sum(dtype=np.uint64)
    return out


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in Gray order (inverse Gray code)."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, from single fingerprints upwards: the bits shared by all
    members of each group, and a mask that tells which bits these are."""
    low = high = fp
    out = [(fp, np.full(len(fp), ~np.uint64(0)))]
    while len(low) > FANOUT:
        at = np.arange(0, len(low), FANOUT)
        low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
        out.append((low, ~(low ^ high)))
    return out


def node_links(fp: np.ndarray, max_bits: int, forest: Forest, base: int = 0) -> None:
    """Add the links among the fingerprints of one node, given in Gray order."""
    levels = _levels(fp)
    top = len(levels) - 1
    n = len(levels[top][0])
    a, b = np.triu_indices(n)
    stack = [(top, a, b)]
    while stack:
        lv, a, b = stack.pop()
        if len(a) > FRONTIER:
            stack.append((lv, a[FRONTIER:], b[FRONTIER:]))
            a, b = a[:FRONTIER], b[:FRONTIER]
        pat, mask = levels[lv]
        apart = np.bitwise_count((pat[a] ^ pat[b]) & mask[a] & mask[b])
        keep = apart <= max_bits
        if lv:
            a, b, apart = a[keep], b[keep], apart[keep]
            size = FANOUT ** lv
            # all members are linked however the free bits fall: no need to go down
            sure = apart + np.bitwise_count(~(mask[a] & mask[b])) <= max_bits
            for x, y in zip(a[sure].tolist(), b[sure].tolist()):
                m = np.concatenate([np.arange(x * size, min((x + 1) * size, len(fp))),
                                    np.arange(y * size, min((y + 1) * size, len(fp)))]) + base
                forest.add(np.full(len(m), m[0]), m)
            a, b = a[~sure], b[~sure]
            roots = forest.roots()[base:base + len(fp)]
            at = np.arange(0, len(fp), size)
            lo, hi = np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)
            known = (lo[a] == hi[b]) & (hi[a] == lo[b])
            a, b = a[~known], b[~known]
            below = len(levels[lv - 1][0])
            for s in range(0, len(a), max(1, FRONTIER // FANOUT ** 2)):
                x, y = a[s:s + FRONTIER // FANOUT ** 2], b[s:s + FRONTIER // FANOUT ** 2]
                ca = (x[:, None] * FANOUT + np.arange(FANOUT))[:, :, None]
                cb = (y[:, None] * FANOUT + np.arange(FANOUT))[:, None, :]
                ca, cb = np.broadcast_arrays(ca, cb)
                ok = (ca < below) & (cb < below) & ((ca < cb) | ((ca == cb) & (lv > 1)))
                stack.append((lv - 1, ca[ok], cb[ok]))
        else:
            keep &= a != b
            forest.add(a[keep] + base, b[keep] + base)


def _small_nodes(fp: np.ndarray, node: np.ndarray, sizes: np.ndarray, max_bits: int, forest: Forest) -> None:
    """Links inside all nodes of at most ``SMALL_NODE`` fingerprints, side by side."""
    left = sizes[node] - 1 - (np.arange(len(fp)) - np.concatenate([[0], np.cumsum(sizes)[:-1]])[node])
    small = sizes[node] <= SMALL_NODE
    for step in range(1, SMALL_NODE):
        i = np.flatnonzero(small & (left >= step))
        if not len(i):
            break
        near = np.bitwise_count(fp[i] ^ fp[i + step]) <= max_bits
        forest.add(i[near], i[near] + step)


def _forest_of(keys: np.ndarray, fp: np.ndarray, ids: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((gray_rank(fp), keys))
    keys, fp, ids = keys[order], fp[order], ids[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(start, len(keys)))
    forest = Forest(len(fp))
    _small_nodes(fp, np.repeat(np.arange(len(start)), sizes), sizes, max_bits, forest)
    for k in np.flatnonzero(sizes > SMALL_NODE):
        s = start[k]
        node_links(fp[s:s + sizes[k]], max_bits, forest, base=s)
    e = np.array(forest.edges, np.int64).reshape(-1, 2)
    return ids[e[:, 0]], ids[e[:, 1]]


def _index_join(max_bits: int, rows: int = 1 << 18):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(last: bool):
            nonlocal held
            if not held:
                return None
            keys, fp, ids = (np.concatenate([h[i] for h in held]) for i in range(3))
            cut = len(keys) if last else np.searchsorted(keys, keys[-1])
            held = [] if last else [(keys[cut:], fp[cut:], ids[cut:])]
            u, v = _forest_of(keys[:cut], fp[:cut], ids[:cut], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in it:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            held[-1] = (held[-1][0], held[-1][1].view(np.uint64), held[-1][2])
            if sum(len(h[0]) for h in held) >= rows:
                yield flush(False)
        if (out := flush(True)) is not None:
            yield out

    return run


def simhash_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp long) of every row; no shuffle."""

    def run(it):
        for batch, texts in batches_of(it, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(texts, words).view(np.int64))],
                                             ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                     run, "doc_id long, fp long")


def hamming_links(reps: DataFrame, max_bits: int = 3, node_rows: int = 1024) -> DataFrame:
    """``reps`` (rep long, fp long; one row per fingerprint) -> (u, v): links
    that connect what pairs with at most ``max_bits`` differing bits connect.

    A node of the index with over ``node_rows`` fingerprints is split by masks
    over the bits that it does not share; nothing is left out."""
    n = max_bits + 1
    if 64 % n or (64 - 64 // n) % n:
        raise ValueError("max_bits + 1 must divide 64 and the bits left beside one mask")
    w = 64 // n
    sub = (64 - w) // n
    turned = lambda b: F.shiftrightunsigned("fp", b * w).bitwiseOR(F.shiftleft("fp", 64 - b * w)) if b else F.col("fp")
    filed = reps.select("rep", "fp", F.explode(F.array(*[
        F.struct(F.lit(b).alias("mask"), turned(b).alias("bits")) for b in range(n)])).alias("x")).select(
        "rep", "fp", "x.mask", F.col("x.bits").bitwiseAND((1 << w) - 1).alias("value"),
        F.shiftrightunsigned("x.bits", w).alias("rest"))
    large = (filed.groupBy("mask", "value").count().where(F.col("count") > node_rows)
             .select("mask", "value", F.lit(True).alias("large")))
    filed = filed.join(large, ["mask", "value"], "left")
    # node numbers: mask, its value, then (only in a split node) the second mask and its value
    key = (F.col("mask") * (1 << w) + F.col("value")).cast("long") * ((n + 1) << sub)
    split = F.array(*[F.lit((s + 1) << sub) + F.shiftrightunsigned("rest", s * sub).bitwiseAND((1 << sub) - 1)
                      for s in range(n)])
    nodes = filed.select(key.alias("node"), "fp", "rep", F.explode(
        F.when(F.col("large"), split).otherwise(F.array(F.lit(0).cast("long")))).alias("part"))
    nodes = nodes.select((F.col("node") + F.col("part")).alias("node"), "fp", "rep")
    return map_arrow(nodes.repartition("node").sortWithinPartitions("node"),
                     _index_join(max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 3, max_bits: int = 3, node_rows: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Null and empty texts, and texts of white space alone, have fingerprint
    zero and link like any other.  Rows that repeat an id are one document
    with several fingerprints.  A row without an id has a fingerprint, links
    with nothing and has a null component.  Other columns are ignored.
    """
    fps = written(simhash_table(docs, id_col, text_col, words), "simhash")
    reps = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # rows of one id: each further fingerprint of it hangs on its first one by the id itself
    own = fps.where("doc_id is not null").join(reps, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = hamming_links(reps, max_bits, node_rows).unionByName(own.where("u <> v"))
    comp = connected_components(links)
    out = fps.join(comp, fps.doc_id == comp.node, "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3, max_bits: int = 3,
             node_rows: int = 1024) -> DataFrame:
    """The rows of ``docs`` with one of each group of near copies: that with the
    smallest id (one without an id only where no row of the group has any), of
    rows that repeat it one by a hash of the text.

    Groups are of texts: rows that share an id but are no near copies of each
    other all stay, and rows without an id group like any other.  Rows whose
    text has no words are near copies of one another.  All columns are kept,
    whatever their names; an empty table gives an empty result.  Texts are
    written once with their fingerprints and moved once, by a number of the row;
    groups are settled on rows without texts."""
    fp, = fresh(docs, "fp")
    names = docs.columns

    def run(it):
        for batch, texts in batches_of(it, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints(texts, words).view(np.int64))], [*names, fp])

    number, = fresh(docs, "number")
    marked = written(map_arrow(docs, run, StructType([*docs.schema.fields, StructField(fp, LongType())])).withColumn(
        number, F.monotonically_increasing_id()), "marked")
    slim = marked.select(F.col(fp).alias("fp"), F.col(number).alias("number"), F.struct(
        F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"),
        F.col(number).alias("number")).alias("place"))
    reps = slim.select(F.col("fp").alias("rep"), "fp").distinct()
    groups = connected_components(hamming_links(reps, max_bits, node_rows))
    first = (slim.join(groups, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("group"))
             .agg(F.min("place").alias("first")).select(F.col("first.number").alias(number)))
    return marked.join(first, number, "left_semi").select(*names)
