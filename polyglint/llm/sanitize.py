"""Personal data: fixed patterns, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers; their
values are the protected entities.  Corpus co-occurrence then tells how much a
term in the text of an entity reveals of it: the pointwise mutual information of
the two, as a share of the information that the entity itself carries,

    PMI(c; t) / IC(c) = log2(n_ct * N / (n_c * n_t)) / log2(N / n_c),

where N counts the distinct texts, n_c those with the entity, n_t those with
the term and n_ct those with both, wherever they stand.  The share is 1 for a
term that occurs in no text without the entity.  Terms over a threshold are
generalised to their class, those over a higher one are removed, at all their
places in the texts with the entity.

Most values stand in one text only, so the same shares are taken for what they
have in common with others (``classes``): a term that gives away the class of a
value goes from the texts with such a value.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, fresh, map_arrow, slices, text_key, written

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("removed", "generalised")
MIN_TERM = 3             # letters or digits of a term, at least
MIN_SUPPORT = 3          # distinct texts that must hold entity and term together
GENERALISE_AT = 0.7
REMOVE_AT = 0.9
PREFIXES = {"ip": (1, 2, 3), "card": (6,), "phone": (4, 7)}    # parts of an address, digits of a number
COPY_BUCKETS = 1 << 18   # of hashes of texts, to tell which may have copies
TERM_BUCKETS = 1 << 20   # the same for texts that may have disclosing terms

# The patterns of the contract.  The e-mail pattern is applied
# around each "@", and numbers start where no digit stands before them, which
# finds the same matches in time proportional to the text.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W_]+")
_NAME = re.compile("[a-z]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        local = text[free:at]
        start = free + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Code point spans (end exclusive) of each kind."""
    out = {"email": list(_emails(text)) if "@" in text else [], "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def _said(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def entity(kind: str, value: str) -> str:
    """An entity by its kind and value, however it is written."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def classes(kind: str, value: str) -> set[str]:
    """What a value shares with others: its kind, the domain and the name parts
    of an e-mail address, the prefixes of an address or number.  No class has
    the colon of an entity."""
    if kind == "email":
        local, _, domain = value.lower().rpartition("@")
        return {kind, f"{kind}@{domain}", *(f"{kind}~{w}" for w in _NAME.findall(local) if len(w) >= MIN_TERM)}
    if kind == "ip":
        parts = [str(int(x)) for x in value.split(".")]
        return {kind, *(f"{kind}/{'.'.join(parts[:k])}" for k in PREFIXES[kind])}
    return {kind, *(f"{kind}/{_NOT_DIGIT.sub('', value)[:k]}" for k in PREFIXES[kind])}


def terms_of(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words of the whole text; words that overlap
    personal data themselves are not terms."""
    taken = sorted(s for k in KINDS for s in spans[k])
    ends, top = [], 0
    for _, e in taken:
        top = max(top, e)
        ends.append(top)
    starts = [s for s, _ in taken]
    out = []
    for m in _WORD.finditer(text):
        k = bisect_left(starts, m.end())       # spans that start before the word ends
        if m.end() - m.start() >= MIN_TERM and not (k and ends[k - 1] > m.start()):
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def context_terms(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[tuple]:
    """(entity, term, start, end): the terms of a text with each of its entities."""
    held = {entity(k, text[s:e]) for k in KINDS for s, e in spans[k]}
    return sorted((e, *t) for e in held for t in (terms_of(text, spans) if held else ()))


_FOUND = ("text_hash long, text_len int, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
          "base_spans string, entities array<string>, classes array<string>, "
          "terms array<struct<term:string,start:int,end:int>>")
_TERMS = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its text's key, base spans, entities and their classes; where there
    are any, all terms of the text with their places."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(it, "text"):
            found = [base_spans(t) for t in texts]
            said = [_said(s) for s in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array([len(s[k]) for s in found], pa.int64()) for k in KINDS),
                 pa.array([hashlib.sha256(s.encode()).hexdigest() for s in said], pa.string()),
                 pa.array(said, pa.string()),
                 pa.array([sorted({entity(k, t[a:b]) for k in KINDS for a, b in s[k]}) for t, s in zip(texts, found)],
                          pa.list_(pa.string())),
                 pa.array([sorted({c for k in KINDS for a, b in s[k] for c in classes(k, t[a:b])})
                           for t, s in zip(texts, found)], pa.list_(pa.string())),
                 pa.array([[dict(zip(("term", "start", "end"), x)) for x in (terms_of(t, s) if any(s.values()) else ())]
                           for t, s in zip(texts, found)], _TERMS)],
                ["doc_id", "text_hash", "text_len", *(f"n_{k}" for k in KINDS), "base_sha256", "base_spans",
                 "entities", "classes", "terms"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(F.col(text_col)),
                                 F.col(text_col).alias("text")), run, "doc_id long, " + _FOUND)


def _share(n: float, n_ct: Column, n_c: Column, n_t: Column) -> Column:
    """What a term reveals of an entity, as a share of the entity's information."""
    return F.log2(n_ct * n / (n_c * n_t)) / F.log2(n / n_c)


def term_counts(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_t): in how many distinct texts each word stands.

    Words are counted where their texts are; only of texts that may have copies
    (by a bucket of the hash, so that a bounded table tells) are the distinct
    words shuffled first, to count one copy."""
    key = ["text_hash", "text_len"]
    bucket = F.pmod("text_hash", F.lit(COPY_BUCKETS)).alias("bucket")
    copied = F.broadcast(written(found.groupBy(*key).count().where("count > 1").select(bucket).distinct(), "pii-copies"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(it, "text"):
            words = [" ".join(sorted({w.lower() for w in _WORD.findall(t) if len(w) >= MIN_TERM})) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.string())], [*key, "words"])

    def words(how: str) -> DataFrame:
        rows = docs.select(*text_key(F.col(text_col)), F.col(text_col).alias("text"))
        return map_arrow(rows.select("*", bucket).join(copied, "bucket", how).select(*key, "text"), run,
                         "text_hash long, text_len int, words string")

    texts = words("left_anti").unionByName(words("left_semi").dropDuplicates(key))
    return (texts.select(F.explode(F.split("words", " ")).alias("term")).groupBy("term")
            .agg(F.count(F.lit(1)).alias("n_t")))


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str = "text", min_support: int = MIN_SUPPORT,
                     generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """(entity, term, share, action): what terms reveal of the entities in their
    texts, and of the classes of these.

    ``found`` is ``find_base`` of ``docs``.  All counts are of distinct texts,
    so that copies of one text do not stand for a habit of the corpus."""
    key = ["text_hash", "text_len"]
    texts = found.where(F.size("entities") > 0).dropDuplicates(key)
    n = found.select(*key).distinct().agg(F.count(F.lit(1)).cast("double").alias("n")).first()["n"]
    held = texts.select(*key, F.explode(F.concat("entities", "classes")).alias("entity"))
    # a class of more than half of the texts carries less than one bit: nothing to give away
    bits = F.when(F.contains("entity", F.lit(":")), F.col("n_c") < n).otherwise(F.col("n_c") * 2 <= n)
    n_c = written(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
                  .where((F.col("n_c") >= min_support) & bits), "pii-entities")
    most = n_c.agg(F.max("n_c").alias("m")).first()["m"] or 0
    # n_ct is at most n_c, so no term in more texts than this can reach the share
    at_most = lambda n_c: F.pow(F.lit(n), 1 - generalise_at) * F.pow(n_c, generalise_at) * (1 + 1e-9)
    n_t = term_counts(found, docs, text_col).where((F.col("n_t") >= min_support) & (F.col("n_t") <= at_most(F.lit(most))))
    near = (texts.select(*key, F.explode(F.array_distinct(F.transform("terms", lambda x: x["term"]))).alias("term"))
            .join(n_t, "term"))
    share = _share(n, F.col("n_ct"), F.col("n_c"), F.col("n_t"))
    pairs = (near.join(held.join(n_c, "entity"), key).where(F.col("n_t") <= at_most(F.col("n_c")))
             .groupBy("entity", "term", "n_c", "n_t").agg(F.count(F.lit(1)).alias("n_ct"))
             .where(F.col("n_ct") >= min_support))
    return written(pairs.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise_at)
                   .withColumn("action", F.when(F.col("share") >= remove_at, "removed").otherwise("generalised")),
                   "pii-pairs")


def term_spans(found: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(text_hash, text_len, term_spans string): by text, all places of the terms
    that disclose one of its entities or their classes."""
    key = ["text_hash", "text_len"]
    texts = found.where(F.size("entities") > 0).dropDuplicates(key)
    places = (texts.select(*key, F.explode("terms").alias("x")).select(*key, "x.*")
              .join(disclosing.select("term").distinct(), "term", "left_semi"))
    held = (texts.select(*key, F.explode(F.concat("entities", "classes")).alias("entity"))
            .join(disclosing.select("entity").distinct(), "entity", "left_semi"))
    hits = (places.join(held, key).join(disclosing.select("entity", "term", "action"), ["entity", "term"])
            # a term that discloses two entities is removed if it must be for one of them
            .groupBy(*key, "start", "end").agg(F.max("action").alias("action")))
    one = F.struct(F.when(F.col("action") == "removed", 0).otherwise(1).alias("rank"), "start", "end", "action")
    return hits.groupBy(*key).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(one)),
        lambda x: F.concat_ws(":", x["action"], x["start"], x["end"])), ",").alias("term_spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per input row: counts and spans of personal data in its whole text.

    spans lists the base spans, then those of disclosing terms (``removed``,
    ``generalised``).  Null and empty texts have none; rows that repeat a text
    have the same spans; other columns are ignored.
    """
    found = written(find_base(docs, id_col, text_col), "pii")
    extra = term_spans(found, disclosing_terms(found, docs, text_col, **limits))
    key = ["text_hash", "text_len"]
    return found.join(extra, key, "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256",
        F.concat_ws(",", F.when(F.col("base_spans") != "", F.col("base_spans")), "term_spans").alias("spans"),
        F.coalesce(F.size(F.split("term_spans", ",")), F.lit(0)).cast("long").alias("n_terms"))


def _masked(text: str, terms: str | None) -> str:
    """The text with personal data and disclosing terms replaced."""
    cuts = [(s, e, f"[{k.upper()}]") for k, spans in base_spans(text).items() for s, e in spans]
    for x in terms.split(",") if terms else ():
        action, s, e = x.split(":")
        s, e = int(s), int(e)
        kind = "NUMBER" if text[s:e].isdigit() else "NAME" if text[s:s + 1].isupper() else "WORD"
        cuts.append((s, e, f"[{kind}]" if action == "generalised" else ""))
    out, at = [], 0
    for s, e, tag in sorted(cuts):
        if s >= at:                     # of overlapping spans the first one names the place
            out += [text[at:s], tag]
        at = max(at, e)
    return "".join(out) + text[at:] if cuts else text


def sanitise(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **limits) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in its texts.

    Every row and column is kept; a null text stays null.  ``length_col``,
    where there is one, is set to the code points of the new text where that
    differs.
    """
    texts = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))
    found = written(find_base(texts), "pii")
    names = docs.columns
    hashed, length, spans = fresh(docs, "text_hash", "text_len", "term_spans")
    extra = written(term_spans(found, disclosing_terms(found, texts, **limits)), "pii-terms").toDF(hashed, length, spans)
    keyed = docs.withColumns(dict(zip((hashed, length), text_key(F.col(text_col)))))
    # only texts that may have such terms move to meet them; a bounded table of buckets tells
    at_bucket, = fresh(docs, "bucket")
    bucket = F.pmod(hashed, F.lit(TERM_BUCKETS)).alias(at_bucket)
    some = F.broadcast(written(extra.select(bucket).distinct(), "pii-buckets"))
    dealt = keyed.select("*", bucket)
    joined = dealt.join(some, at_bucket, "left_anti").select(*names, F.lit(None).cast("string").alias(spans)).unionByName(
        dealt.join(some, at_bucket, "left_semi").join(extra, [hashed, length], "left").select(*names, spans))
    at = names.index(text_col)
    has_length = length_col in names and dict(docs.dtypes)[length_col] == "bigint"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            old = batch.column(at).to_pylist()
            terms = batch.column(len(names)).to_pylist()
            new = [t if t is None else _masked(t, x) for t, x in zip(old, terms)]
            cols = list(batch.columns[:len(names)])
            cols[at] = pa.array(new, pa.string())
            if has_length:
                k = names.index(length_col)
                cols[k] = pa.array([n if a == b or b is None else len(b)
                                    for n, a, b in zip(cols[k].to_pylist(), old, new)], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(joined, run, docs.schema)
