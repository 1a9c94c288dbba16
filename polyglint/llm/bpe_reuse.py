"""BPE encoding by content-defined chunks that documents share.

A rolling hash over the code points of a text cuts it into chunks: copied
passages are cut alike wherever they stand.  Each chunk is encoded once (and
kept, so that the next document that holds it takes the ids over).  A chunk's
ids are certain only between its first and its last safe cut, a blank or line
end after other than white space; what lies around a join is encoded again,
from the last certain id on the left to the first one on the right.  Where a
chunk has no safe cut the stretch grows over it into the next chunks, in the
end over the whole text, until both sides agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import batches_of, kept, map_arrow, slices

WINDOW = 16                # code points that the rolling hash sees
CHUNK_BITS = 9             # a chunk has about 2 ** CHUNK_BITS code points
KEPT_CODE_POINTS = 1 << 22 # text of the chunks that a worker keeps, at most twice
KEPT_UNITS = 200_000       # units that it keeps beside them, at most twice

KEEPS = "bpe-chunks"

_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def cuts(text: str, bits: int = CHUNK_BITS) -> list[int]:
    """Where chunks end: after each window whose rolling hash has ``bits`` zeros."""
    if len(text) <= WINDOW:
        return [len(text)] if text else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    base, width = 0x01000193, 1
    while width < WINDOW:      # a window of twice the width is two windows side by side
        h = h[:-width] * np.uint32(base) + h[width:]
        base, width = base * base & 0xFFFFFFFF, 2 * width
    at = np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits) == 0) + WINDOW
    out = at.tolist()
    if not out or out[-1] != len(text):
        out.append(len(text))
    return out


class ChunkEncoder:
    """Encodes whole texts chunk by chunk and keeps what chunks come to."""

    def __init__(self, path: str, kept: int = KEPT_CODE_POINTS, bits: int = CHUNK_BITS):
        self.units = bpe.UnitEncoder(path, KEPT_UNITS)
        self.kept, self.bits, self.size = kept, bits, 0
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def chunk(self, text: str) -> tuple:
        """(text before the first safe cut, ids up to the last one, text behind
        it); (text, None, "") for a chunk without a safe cut."""
        got = self.new.get(text)
        if got is None:
            got = self.old.get(text) or self._encoded(text)
            if self.size >= self.kept:
                self.old, self.new, self.size = self.new, {}, 0
            self.new[text] = got
            self.size += len(text)
        return got

    def _encoded(self, text: str) -> tuple:
        m = _SAFE.search(text)
        if m is None:
            return text, None, ""
        first = last = m.start()
        end = len(text)
        while True:
            end = max(text.rfind(" ", first, end), text.rfind("\n", first, end))
            if end <= first:
                break
            if not text[end - 1].isspace():
                last = end
                break
        return text[:first], self.units.encode(text[first:last]), text[last:]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        open_text = ""         # behind the last certain id
        at = 0
        for end in cuts(text, self.bits):
            head, ids, tail = self.chunk(text[at:end])
            at = end
            if ids is None:
                open_text += head
            else:
                out.append(self.units.encode(open_text + head))
                out.append(ids)
                open_text = tail
        out.append(self.units.encode(open_text))
        return b"".join(out)


def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder in each worker process."""
    return kept(KEEPS, path, lambda: ChunkEncoder(path))


def encode(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (array<int>) of each whole text, n_tokens and
    ids_sha256, of the ids as little-endian unsigned 32-bit integers; a null or
    empty text has none.  Every row is kept, and every other column.  No
    shuffle."""
    vocabulary = vocabulary or bpe.vocabulary()
    made = ["ids", "n_tokens", "ids_sha256"]
    names = [c for c in docs.columns if c.lower() not in made]
    docs = docs.select(*names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(vocabulary).encode
        for batch, texts in batches_of(it, text_col):
            ids = [enc(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _lists(ids), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())], [*names, *made])

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
    schema = StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType())).add("n_tokens", LongType())
    return map_arrow(docs, run, schema.add("ids_sha256", StringType()), KEEPS)


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``encoded`` with a decoded string made from its ids, special tokens included."""
    vocabulary = vocabulary or bpe.vocabulary()
    names = [c for c in encoded.columns if c.lower() != "decoded"]
    encoded = encoded.select(*names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = chunk_encoder(vocabulary).units.decode
        for batch in slices(it):
            ids = batch.column(batch.schema.get_field_index("ids"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([dec(x.values.tolist() if x.is_valid else []) for x in ids], pa.string())],
                [*names, "decoded"])

    from pyspark.sql.types import StringType, StructType
    return map_arrow(encoded, run, StructType([*encoded.schema.fields]).add("decoded", StringType()), KEEPS)


def digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, in one pass."""
    vocabulary = vocabulary or bpe.vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = chunk_encoder(vocabulary).encode, chunk_encoder(vocabulary).units.decode
        for batch, texts in batches_of(it, "text"):
            n, ids_sha, text_sha = [], [], []
            for t in texts:
                ids = enc(t)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(dec(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", KEEPS)
