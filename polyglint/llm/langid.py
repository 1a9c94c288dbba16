"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points; n-grams of one to three letters are hashed into a
fixed number of buckets with numpy, whole batches at a time.  Fitting sums
bucket counts per language; prediction gathers the broadcast log-probability
rows of a batch's n-grams (a sparse batch in coordinate form) and adds them up
per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, fresh, map_arrow

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 15                  # buckets of an n-gram order: 2 ** BITS
PIECE = 1 << 18            # code points scored together
SMOOTHING = 0.5
MAX_LANGUAGES = 1024       # the model grows by 0.8 MB a label: with more, fitting is refused
FIT_DOCS_PER_LANGUAGE = 4000   # bound of the sample that the model is fitted on

_LETTER: list = []


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    if not _LETTER:
        table = np.full(0x110000, 32, np.uint32)
        points = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.uint32)
        table[points] = points
        _LETTER.append(table)
    return _LETTER[0]


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points (a letter or a space), the number of the text of each, and
    whether an n-gram may start there.  Texts stand between spaces; a text
    longer than a piece runs over several, each with the first code points of
    the next one, which its last n-grams reach into."""
    table, parts, of, starts, size = _letters(), [], [], [], 0
    more = max(ORDERS) - 1
    for i, t in enumerate(texts):
        c = table[np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
        for s in range(0, len(c), PIECE):
            part = c[s:s + PIECE + more]
            parts.append(part)
            of.append(np.full(len(part), i, np.int32))
            starts.append(np.arange(len(part)) < PIECE)
            size += len(part)
            if size >= PIECE:
                yield np.concatenate(parts), np.concatenate(of), np.concatenate(starts)
                parts, of, starts, size = [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(of), np.concatenate(starts)


def _buckets(c: np.ndarray, of: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of each order, with the text of each n-gram.
    N-grams across two texts, and those without a letter, are left out."""
    h = np.zeros(len(c), np.uint64)
    letter = np.zeros(len(c), bool)
    for k, n in enumerate(ORDERS):
        m = len(c) - n + 1
        if m <= 0:
            return
        h = (h[:m] * np.uint64(0x100000001B3)) ^ c[n - 1:].astype(np.uint64)
        letter = letter[:m] | (c[n - 1:] != 32)
        ok = letter & starts[:m] & (of[:m] == of[n - 1:])
        mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        yield (mixed[ok].astype(np.int64) + (k << BITS)), of[:m][ok]


@dataclass(frozen=True)
class Model:
    """Languages in order, and log-probabilities by bucket and language."""

    languages: list[str]
    prior: np.ndarray
    log_prob: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-posterior (not normalised) of each text and language; n-grams found."""
        total = np.tile(self.prior, (len(texts), 1))
        seen = np.zeros(len(texts), np.int64)
        for piece in _pieces(texts):
            for bucket, text in _buckets(*piece):
                if not len(bucket):
                    continue
                at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                total[text[at]] += np.add.reduceat(self.log_prob[bucket], at, axis=0)
                seen[text[at]] += np.diff(np.append(at, len(text)))
        return total, seen

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its posterior probability."""
        total, seen = self.scores(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return ([self.languages[b] if s else UNKNOWN for b, s in zip(best, seen)],
                np.where(seen > 0, np.clip(share, 0, 1), 0.0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, docs_per_language: int = FIT_DOCS_PER_LANGUAGE,
        max_languages: int = MAX_LANGUAGES) -> Model:
    """Fit on (doc_id, text, lang): of each language the ``docs_per_language``
    or so documents whose hashed id is least, or all where there are fewer.

    Every label is learned, with its share of all labelled documents as its
    prior; a table of over ``max_languages`` labels is refused.  Null labels and
    texts are skipped.  Counts are summed by Spark; the driver gets one
    fixed-size vector per language.
    """
    spark = labelled.sparkSession
    known = labelled.where("lang is not null and text is not null")
    known_langs = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(known_langs) > max_languages:
        raise ValueError(f"over {max_languages} languages are labelled")
    width = len(ORDERS) << BITS
    if not known_langs:
        return Model([], np.zeros(0), np.zeros((width, 0)))
    sizes = spark.createDataFrame([(lang, docs_per_language / n) for lang, n in sorted(known_langs.items())],
                                  "lang string, share double")
    # a hashed id is uniform in [0, 1): below the share are about docs_per_language rows
    place = F.coalesce(F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND((1 << 40) - 1) / float(1 << 40), F.lit(0.0))
    sample = known.join(F.broadcast(sizes), "lang").where(place < F.col("share")).select("text", "lang")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch, texts in batches_of(it, "text"):
            langs = batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                vec = sums.setdefault(lang, np.zeros(width, np.int64))
                rows[lang] = rows.get(lang, 0) + len(own)
                for piece in _pieces(own):
                    for bucket, _ in _buckets(*piece):
                        vec += np.bincount(bucket, minlength=width)
        for lang, vec in sums.items():
            yield pa.RecordBatch.from_pydict({
                "lang": [lang], "docs": [rows[lang]], "counts": [vec.astype("<i8").tobytes()]})

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in it:
            for r in batch.to_pylist():
                s = sums.setdefault(r["lang"], [0, np.zeros(width, np.int64)])
                s[0] += r["docs"]
                s[1] = s[1] + np.frombuffer(r["counts"], "<i8")
        for lang, (n, vec) in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "docs": [n], "counts": [vec.tobytes()]})

    schema = "lang string, docs long, counts binary"
    parts = map_arrow(sample, count, schema)
    found = {r["lang"]: np.frombuffer(r["counts"], "<i8") for r in map_arrow(parts.repartition("lang"), add, schema).collect()}
    # a label none of whose documents was drawn (few, all with a high hash) has its prior alone
    langs = sorted(known_langs)
    counts = np.array([found.get(lang, np.zeros(width)) for lang in langs], np.float64) + SMOOTHING
    docs = np.array([known_langs[lang] for lang in langs], np.float64)
    by_order = counts.reshape(len(langs), len(ORDERS), -1)
    log_prob = np.log(by_order / by_order.sum(axis=2, keepdims=True)).reshape(len(langs), width)
    return Model(langs, np.log(docs / docs.sum()), np.ascontiguousarray(log_prob.T))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """``docs`` with lang_pred and score; all other columns are kept, those of
    these two names are replaced.

    A null, empty or letterless text, and every text when nothing could be
    learned, is ``und`` with score 0.  No shuffle; the model is a broadcast of
    bounded size.
    """
    names = [c for c in docs.columns if c.lower() not in (lang_col.lower(), score_col.lower())]
    docs = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(it, text_col):
            langs, score = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                [*names, lang_col, score_col])

    from pyspark.sql.types import DoubleType, StringType, StructType
    schema = StructType([*docs.schema.fields]).add(lang_col, StringType()).add(score_col, DoubleType())
    return map_arrow(docs, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row: learned from the
    documents that are not held out, applied to all."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows whose language is found: all but those of ``und``."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    lang, score = fresh(docs, "lang_pred", "score")
    return predict(docs, model, lang_col=lang, score_col=score).where(F.col(lang) != UNKNOWN).select(*docs.columns)
