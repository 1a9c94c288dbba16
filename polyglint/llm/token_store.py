"""Token ids as files of bit-plane shuffled blocks.

Documents are dealt into ranges of ascending id; each range is encoded by one
task, in order, into parts of whole documents.  A part's ids are cut into
blocks of a fixed size; a block's ids are transposed into byte planes (or bit
planes), each compressed with zstandard, so that the planes that hardly change
nearly vanish.  A part is one record of a Parquet file:

  range, part        place in the corpus order
  first, n_ids       ids of the range before the part, ids of the part
  doc_ids, lengths   its documents and how many ids each has
  index              block by block: n_ids, and the end of each plane in data
  data               the compressed planes, one after the other
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import id_ranges, map_arrow, shared_path

END_ID = 0
BLOCK_IDS = 1 << 16
PART_IDS = 1 << 20
LEVEL = 1

SCHEMA = ("range int, part int, first long, n_ids long, doc_ids array<long>, lengths array<long>, "
          "index array<struct<n_ids:int,ends:array<long>>>, data binary")
_INDEX = pa.list_(pa.struct([("n_ids", pa.int32()), ("ends", pa.list_(pa.int64()))]))


def to_planes(ids: np.ndarray, bits: bool = False) -> np.ndarray:
    """The planes of a block: row k holds byte (or bit) k of every id; bit
    planes are packed eight ids to a byte."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return np.ascontiguousarray(octets.T)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    rows = np.array([np.frombuffer(p, np.uint8) for p in planes]).reshape(len(planes), -1)
    if len(planes) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
        return np.ascontiguousarray(rows).reshape(-1).view("<u4")
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = LEVEL) -> tuple[list[dict], bytes]:
    """Index and data of a part's ids."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    index, data, end = [], [], 0
    for s in range(0, len(ids), block_ids):
        block = ids[s:s + block_ids]
        ends = []
        for plane in to_planes(block, bits):
            data.append(squeeze(plane.tobytes()))
            end += len(data[-1])
            ends.append(end)
        index.append({"n_ids": len(block), "ends": ends})
    return index, b"".join(data)


def unpack(index: list[dict], data: bytes) -> np.ndarray:
    """All ids of a part."""
    expand = zstandard.ZstdDecompressor().decompress
    out, start = [], 0
    for block in index:
        planes = []
        for end in block["ends"]:
            planes.append(expand(data[start:end]))
            start = end
        out.append(from_planes(planes, block["n_ids"]))
    return np.concatenate(out) if out else np.empty(0, "<u4")


def write(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, block_ids: int = BLOCK_IDS, part_ids: int = PART_IDS, bits: bool = False) -> None:
    """Encode every text and write the ids under ``path`` in ascending id order.

    Each document ends with ``end_id``; a null or empty text has that id alone.
    Rows without an id come first; rows that repeat one stand together, in the
    order of their texts.  Other columns are ignored.  Texts are shuffled once.
    """
    vocabulary = vocabulary or bpe.vocabulary()
    ordered = id_ranges(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                    F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id", "range")
    ordered = (ordered.repartition(F.col("range"))
               .sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.unit_encoder(vocabulary).encode
        end = int(end_id).to_bytes(4, "little")
        now, part, first = None, 0, 0
        held: list[bytes] = []
        ids: list = []

        def record():
            nonlocal part, first
            flat = np.frombuffer(b"".join(held), "<u4")
            index, data = pack(flat, block_ids, bits)
            out = pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([part], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([len(flat)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([[len(x) // 4 for x in held]], pa.list_(pa.int64())),
                 pa.array([index], _INDEX), pa.array([data], pa.binary())],
                ["range", "part", "first", "n_ids", "doc_ids", "lengths", "index", "data"])
            part, first = part + 1, first + len(flat)
            held.clear()
            ids.clear()
            return out

        size = 0
        for batch in it:
            at, key, text = batch.schema.get_field_index("range"), batch.column(0).to_pylist(), batch.column(1)
            for r, k, t in zip(batch.column(at).to_pylist(), key, text):
                if held and (r != now or size >= 4 * part_ids):
                    yield record()
                    size = 0
                if r != now:
                    now, part, first = r, 0, 0
                held.append(encode(t.as_py()) + end)
                ids.append(k)
                size += len(held[-1])
        if held:
            yield record()

    map_arrow(ordered, run, SCHEMA, keeps="bpe-units").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) from the files: start counts
    the ids of all documents before."""
    return _read(spark, path, lambda ids: pa.array(ids, pa.list_(pa.int32())), "ids array<int>",
                 lambda own: own.astype(np.int32))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    return _read(spark, path, lambda x: pa.array(x, pa.int64()), "ids_crc32 long", lambda own: zlib.crc32(own.tobytes()))


def _read(spark: SparkSession, path: str, column, kind: str, made) -> DataFrame:
    parts = spark.read.schema(SCHEMA).parquet(path)
    # one count for each range; there are a few for each shuffle partition
    sizes = parts.groupBy("range").agg(F.sum("n_ids").alias("n")).orderBy("range").collect()
    before, rows = 0, []
    for r in sizes:
        rows.append((r["range"], before))
        before += r["n"]
    offsets = spark.createDataFrame(rows, "range int, before long")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                ids = unpack(row["index"], row["data"])
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                starts = ends - np.array(row["lengths"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["range"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(row["first"] + starts, pa.int64()), pa.array(row["lengths"], pa.int64()),
                     column([made(ids[s:e]) for s, e in zip(starts, ends)])],
                    ["range", "doc_id", "start", "n_tokens", kind.split()[0]])

    docs = map_arrow(parts.select("range", "first", "doc_ids", "lengths", "index", "data"), run,
                     f"range int, doc_id long, start long, n_tokens long, {kind}")
    return docs.join(F.broadcast(offsets), "range").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", kind.split()[0])


def stored(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` into the shared folder and read each document back."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    write(docs, path, **options)
    return digests(spark, path)
