"""Near-duplicate embeddings: an exact metric range join.

Vectors are compared by cosine, which on unit vectors is a distance
d = sqrt(2 - 2 cos); a link is a pair with d <= r.  Pivots, drawn from the
vectors, partition them: a vector's home is the cell of its nearest pivot.

* A vector x visits the cell of pivot p where a link could lie: if y is at home
  there and d(x, y) <= r, then d(x, p) <= d(x, home) + 2 r and
  d(x, p) <= r + the cell's radius (triangle inequality), and x is at most r
  from the plane halfway between the two pivots.  Each cell joins the vectors
  at home in it with those that visit it, apart from all others.  As that holds
  for both ends of a link, of two vectors outside of cores only one visits the
  other, by the numbers of their cells, and the link counts for both.
* The core of a cell are the vectors within r / 4 of its pivot.  A vector within
  3/4 r of the pivot is linked with the whole core, one beyond 5/4 r with none of
  it; only those between are compared with it.  A dense group that holds a third
  of all vectors is thus counted, not compared.
* Equal vectors are one vector that counts as often as it occurs.

Cells with many vectors at home are cut into pieces that their visitors all see.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, written
from .components import connected_components
from .forest import Forest

HOMES_PER_CELL = 4096
MAX_PIVOTS = 4096          # bounds what is broadcast: so many vectors, for each dimension
BATCH = 1024               # vectors compared with a piece at a time
SENT_BYTES = 8 << 20       # of vectors sent to pieces at a time
AT_HOME, ALONE, MUTUAL = 0, 1, 2   # what a vector is in a piece; a visitor's links count for it alone, or for both sides
SLACK = 1e-6               # bounds are widened by this, far above rounding errors
TIE = 1e-10                # cosines this near the limit are computed exactly


def units(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision of vectors stored as 32-bit or 64-bit floats."""
    x = np.empty((len(raw), dim))
    sizes = np.array([len(v) for v in raw])
    for kind, size in (("<f4", 4 * dim), ("<f8", 8 * dim)):
        at = np.flatnonzero(sizes == size)
        x[at] = np.frombuffer(b"".join([raw[i] for i in at]), kind).reshape(-1, dim)
    # scaled first, so that no square overflows or vanishes
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def linked(a: np.ndarray, b: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows of a and of b that are linked.

    Products in single precision leave out what is clearly apart; the cosine of
    the rest is taken in double precision, next to the limit exactly."""
    slack = 1e-5 + 2e-7 * a.shape[1]
    rough = a.astype(np.float32) @ b.astype(np.float32).T
    i, j = np.divmod(np.flatnonzero(rough >= np.float32(min_cosine - slack)), max(1, len(b)))
    value = np.empty(len(i))
    for s in range(0, len(i), 1 << 16):
        k = slice(s, s + (1 << 16))
        value[k] = np.einsum("ij,ij->i", a[i[k]], b[j[k]])
    keep = value >= min_cosine
    for k in np.flatnonzero(np.abs(value - min_cosine) <= TIE):
        keep[k] = exact_cosine(a[i[k]], b[j[k]]) >= min_cosine
    return i[keep], j[keep]


def _packed(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, vec binary): a vector's components as 32-bit floats where
    that loses nothing, else as 64-bit ones; null where it links with nothing."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            dims, vecs = [], []
            for v in b.column(1):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and v.values.null_count == 0 else np.empty(0)
                ok = len(x) and np.isfinite(x).all() and x.any()
                with np.errstate(over="ignore"):
                    small = x.astype("<f4")
                same = small if ok and (small == x).all() else x.astype("<f8")
                dims.append(len(x) if ok else None)
                vecs.append((same + same.dtype.type(0)).tobytes() if ok else None)   # no negative zeros
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())],
                                             ["vec_id", "dim", "vec"])

    return map_arrow(rows, run, "vec_id long, dim int, vec binary")


def _by_dim(batch: pa.RecordBatch, dims: list[int]) -> Iterator[tuple]:
    d = np.array(dims)
    for dim in np.unique(d):
        yield int(dim), np.flatnonzero(d == dim)


def near_duplicates(vectors: DataFrame, min_cosine: float = 0.95, id_col: str = "vec_id",
                    vector_col: str = "embedding", homes_per_cell: int = HOMES_PER_CELL,
                    max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, as do those without an id and those of different
    dimension with each other.  Rows that repeat an id count as vectors of
    their own and share a component.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    r = math.sqrt(2 - 2 * min_cosine)
    given = written(_packed(vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                                           F.col(vector_col).cast("array<double>").alias("v"))), "vectors")
    reps = (given.where("vec is not null and vec_id is not null").groupBy("dim", "vec")
            .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    # a vector is known by a number of its own: one id may stand for several vectors
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "vector-reps")

    # pivots: of each dimension as many as cells are wanted, by a hash of the vector
    rank = F.xxhash64("vec")
    pivots: dict[int, np.ndarray] = {}
    for row in reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(256).collect():
        k = min(max_pivots, -(-row["count"] // homes_per_cell))
        own = reps.where(F.col("dim") == row["dim"]).orderBy(rank, "vec").limit(k).select("vec").collect()
        pivots[row["dim"]] = units([bytes(p["vec"]) for p in own], row["dim"])
    first: dict[int, int] = {}
    for d in sorted(pivots):
        first[d] = sum(len(pivots[x]) for x in first)
    shared = spark.sparkContext.broadcast((pivots, first))

    def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))

    def homes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv, start = shared.value
        for b in it:
            vec = b.column(1).to_pylist()
            home, far = np.zeros(len(vec), np.int32), np.zeros(len(vec))
            for dim, at in _by_dim(b, b.column(0).to_pylist()):
                if dim not in piv:       # a rare dimension has a cell without a pivot
                    home[at], far[at] = -dim, 2.0
                    continue
                d = distances(units([vec[i] for i in at], dim), piv[dim])
                home[at], far[at] = start[dim] + d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(far)],
                                             ["dim", "vec", "rep", "copies", "home", "far"])

    placed = written(map_arrow(reps.select("dim", "vec", "rep", "copies"), homes,
                               "dim int, vec binary, rep long, copies long, home int, far double"), "vector-homes")
    core_far = r / 4 - SLACK
    core = F.col("far") <= core_far
    # one row a pivot
    cells = {c["home"]: c for c in placed.groupBy("home").agg(
        F.max("far").alias("radius"), F.sum(F.when(core, F.col("copies")).otherwise(0)).alias("core_copies"),
        F.sum(F.when(core, 1).otherwise(0)).alias("core_rows"), F.min(F.when(core, F.col("rep"))).alias("core_rep"),
        F.sum(F.when(core, 0).otherwise(1)).alias("rest_rows")).collect()}
    n_cells = sum(len(p) for p in pivots.values())
    get = lambda name, none: np.array([cells[c][name] if c in cells and cells[c][name] is not None else none
                                       for c in range(n_cells)])
    rare = {h: -(-c["rest_rows"] // homes_per_cell) for h, c in cells.items() if h < 0}
    info = spark.sparkContext.broadcast({
        "radius": get("radius", -9.0), "core_copies": get("core_copies", 0), "core_rep": get("core_rep", -1),
        "has_core": get("core_rows", 0) > 0, "rare": rare,
        "core_pieces": -(-get("core_rows", 0) // homes_per_cell), "rest_pieces": -(-get("rest_rows", 0) // homes_per_cell)})

    def seen(b: pa.RecordBatch) -> Iterator[tuple]:
        """For the vectors of each dimension that has pivots: their rows, the
        dimension's first cell, each one's home, whether it is in a core, and
        which cells' cores it is known to be linked with or may be linked with,
        and which cells' rests it may be linked with."""
        piv, start = shared.value
        of = info.value
        vec, far = b.column(1).to_pylist(), b.column(5).to_numpy()
        home = b.column(4).to_numpy()
        for dim, at in _by_dim(b, b.column(0).to_pylist()):
            if dim not in piv:
                yield dim, at, None, home[at], None, None, None, None
                continue
            p, s = piv[dim], start[dim]
            d = distances(units([vec[i] for i in at], dim), p)
            own = home[at] - s
            own_far = far[at][:, None]
            apart = distances(p[own], p)                           # pivots from each one's home
            plane = (d * d - own_far * own_far) <= 2 * apart * (r + SLACK) + SLACK
            near = (d <= own_far + 2 * r + SLACK) & (d <= r + of["radius"][s:s + len(p)] + SLACK) & plane
            near[np.arange(len(at)), own] = True
            with_core = near & of["has_core"][s:s + len(p)]
            known = with_core & (d <= 0.75 * r - SLACK)
            yield (dim, at, s, own, far[at] <= core_far, known, with_core & ~known & (d <= 1.25 * r + SLACK),
                   near & (of["rest_pieces"][s:s + len(p)] > 0))

    def certain(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links with whole cores: a count for each vector, and one link to each core."""
        of = info.value
        for b in it:
            rep, copies = b.column(2).to_numpy(), b.column(3).to_numpy()
            us, ns, vs = [], [], []
            for _, at, s, own, in_core, known, _, _ in seen(b):
                if s is None:
                    continue
                n = known @ of["core_copies"][s:s + known.shape[1]] - np.where(in_core, copies[at], 0)
                us.append(rep[at[n > 0]])
                ns += n[n > 0].tolist()
                vs += [None] * int((n > 0).sum())
                i, c = np.nonzero(known)
                us.append(rep[at[i]])
                ns += [None] * len(i)
                vs += of["core_rep"][s + c].tolist()
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(ns, pa.int64()),
                                                  pa.array(vs, pa.int64())], ["u", "n", "v"])

    def visits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces that each vector is at home in or compared with."""
        of = info.value
        for b in slices(it):
            vec, rep, copies = b.column(1), b.column(2).to_numpy(), b.column(3).to_numpy()

            def sent(dim, i, cell, pieces, mine, kind, first=0):
                """Vectors i to so many pieces of their cells, from ``first`` on; at home
                in the one numbered ``mine`` of these (-1: in none)."""
                n = np.asarray(pieces, np.int64)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, cell, mine, kind, first = (np.repeat(x, n) for x in (i, cell, mine, kind, np.broadcast_to(first, n.shape)))
                kind, k = np.where(k == mine, AT_HOME, kind), first + k
                step = max(1, min(1 << 15, SENT_BYTES // (8 * dim)))
                for lo in range(0, len(i), step):
                    s = slice(lo, lo + step)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[s], pa.int32()), pa.array(k[s], pa.int32()), pa.array(kind[s], pa.int8()),
                         pa.array(rep[i[s]], pa.int64()), pa.array(copies[i[s]], pa.int64()), vec.take(pa.array(i[s])),
                         pa.array(np.full(len(i[s]), dim), pa.int32())],
                        ["cell", "piece", "kind", "rep", "copies", "vec", "dim"])

            for dim, at, s, own, in_core, _, unsure, rest in seen(b):
                if s is None:
                    pieces = np.array([of["rare"][h] for h in own.tolist()], np.int64)
                    yield from sent(dim, at, 2 * own + 1, pieces, rep[at] % pieces, np.full(len(at), ALONE))
                    continue
                i, c = np.nonzero(unsure)
                yield from sent(dim, at[i], 2 * (s + c), of["core_pieces"][s + c], np.full(len(i), -1), np.full(len(i), ALONE))
                # of two vectors outside of cores, in different cells, one visits the other
                other = np.arange(rest.shape[1]) != own[:, None]
                turn = (own[:, None] < np.arange(rest.shape[1])) ^ ((own[:, None] + np.arange(rest.shape[1])) % 2 == 1)
                i, c = np.nonzero(rest & (in_core[:, None] | ~other | turn))
                pieces = of["rest_pieces"][s + c]
                yield from sent(dim, at[i], 2 * (s + c) + 1, pieces,
                                np.where(other[i, c] | in_core[i], -1, rep[at[i]] % pieces),
                                np.where(other[i, c] & ~in_core[i], MUTUAL, ALONE))
                # at home in one piece of the core, for those that are unsure of it
                i = np.flatnonzero(in_core)
                yield from sent(dim, at[i], 2 * (s + own[i]), np.ones(len(i), np.int64), np.zeros(len(i)), np.full(len(i), ALONE),
                                rep[at[i]] % of["core_pieces"][s + own[i]])

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces come one after the other, those at home first."""
        state: dict = {"key": None, "own": []}

        def result(ids, counts, u, v):
            n = len(ids) + len(u)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids, u]), pa.int64()),
                     pa.array([*counts.tolist(), *[None] * len(u)], pa.int64()),
                     pa.array([*[None] * len(ids), *v.tolist()], pa.int64())], ["u", "n", "v"])

        def compare(rep, copies, x, mutual):
            """Count the links of some vectors with those at home in the piece, and
            where that is said the links of these with them."""
            h = state["homes"]
            forest = Forest(len(h["rep"]) + len(rep))
            i, j = linked(x, h["x"], min_cosine)
            apart = rep[i] != h["rep"][j]
            i, j = i[apart], j[apart]
            counts = np.bincount(i, h["copies"][j], len(rep)).astype(np.int64)
            h["counts"] += np.bincount(j, np.where(mutual[i], copies[i], 0), len(h["rep"])).astype(np.int64)
            forest.add(j, len(h["rep"]) + i)
            e = np.array(forest.edges, np.int64).reshape(-1, 2)
            both = np.concatenate([h["rep"], rep])
            yield from result(rep[counts > 0], counts[counts > 0], both[e[:, 0]], both[e[:, 1]])

        def flush():
            """What waits in the piece is compared."""
            if state["wait"]:
                rep, copies, mutual = (np.concatenate([w[k] for w in state["wait"]]) for k in range(3))
                vec = [v for w in state["wait"] for v in w[3]]
                state["wait"], state["waiting"] = [], 0
                yield from compare(rep, copies, units(vec, state["dim"]), mutual)

        def settle():
            """All vectors at home are known: their matrix.  Those of a rest are
            compared with each other."""
            rep, copies = (np.concatenate([o[k] for o in state["own"]]) for k in range(2))
            x = units([v for o in state["own"] for v in o[2]], state["dim"])
            state["homes"] = {"rep": rep, "copies": copies, "x": x, "counts": np.zeros(len(rep), np.int64)}
            if state["key"][0] % 2:
                for lo in range(0, len(rep), BATCH):
                    k = slice(lo, lo + BATCH)
                    yield from compare(rep[k], copies[k], x[k], np.zeros(len(rep[k]), bool))

        def done():
            """The piece is at its end."""
            if state["own"]:
                if state["homes"] is None:
                    yield from settle()
                yield from flush()
                h = state["homes"]
                some = h["counts"] > 0
                yield from result(h["rep"][some], h["counts"][some], np.empty(0, np.int64), np.empty(0, np.int64))

        for b in it:
            cell, piece, kind, rep, copies = (b.column(i).to_numpy() for i in range(5))
            vec, dim = b.column(5), b.column(6)
            ends = np.flatnonzero((cell[1:] != cell[:-1]) | (piece[1:] != piece[:-1])) + 1
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(cell)]):
                if hi == lo:
                    continue
                if (cell[lo], piece[lo]) != state["key"]:
                    yield from done()
                    state = {"key": (cell[lo], piece[lo]), "own": [], "homes": None, "wait": [], "waiting": 0, "dim": dim[lo].as_py()}
                home = lo + int(np.searchsorted(kind[lo:hi], AT_HOME, side="right"))
                if home > lo:
                    state["own"].append((rep[lo:home].copy(), copies[lo:home].copy(), vec.slice(lo, home - lo).to_pylist()))
                if home == hi or not state["own"]:
                    continue
                if state["homes"] is None:
                    yield from settle()
                for at in range(home, hi, BATCH):
                    to = min(hi, at + BATCH)
                    state["wait"].append((rep[at:to].copy(), copies[at:to].copy(), kind[at:to] == MUTUAL, vec.slice(at, to - at).to_pylist()))
                    state["waiting"] += to - at
                    if state["waiting"] >= BATCH:
                        yield from flush()
        yield from done()

    sent = map_arrow(placed, visits,
                     "cell int, piece int, kind tinyint, rep long, copies long, vec binary, dim int")
    found = written(map_arrow(sent.repartition("cell", "piece").sortWithinPartitions(
        "cell", "piece", "kind"), join, "u long, n long, v long").unionByName(
            map_arrow(placed, certain, "u long, n long, v long")), "vector-links")
    links = found.where("v is not null and u <> v").select("u", "v")
    counts = found.where("n is not null").groupBy("u").agg(F.sum("n").alias("n"))

    # vectors of one id share a component
    several = given.where("vec is not null and vec_id is not null").groupBy("vec_id").agg(
        F.min(F.xxhash64("dim", "vec")).alias("a"), F.max(F.xxhash64("dim", "vec")).alias("b")).where("a <> b").select("vec_id")
    shared = given.where("vec is not null").join(several, "vec_id").join(reps, ["dim", "vec"]).select("vec_id", "rep").distinct()
    star = shared.groupBy("vec_id").agg(F.min("rep").alias("v"))
    links = links.unionByName(shared.join(star, "vec_id").where("rep <> v").select(F.col("rep").alias("u"), "v"))
    comp = connected_components(links)

    # every row: the vector it equals, that vector's links, and the other copies
    known = (reps.join(counts, reps.rep == counts.u, "left").join(comp, F.col("rep") == comp.node, "left")
             .select("dim", "vec", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component")))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    rows = (given.where("vec is not null and vec_id is not null").join(known.join(least, "component"), ["dim", "vec"])
            .select("vec_id", "n_links", "component_id"))
    alone = given.where("vec is null or vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
