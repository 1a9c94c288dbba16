"""Mechanical checks for review notes that have no automated rule upstream:
full-width punctuation, mixed forms of address, mixed sentence-ending
registers, and glossary terminology.

All per-row checks work on the row as it is (document or segment): no
explode, no shuffle.  Terminology is an *equi*-join: every source text is
cut into the substrings whose lengths occur in the glossary, and those are
joined to the glossary terms, so no theta or cross join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import text as X
from ..plans.strategy import checked_broadcast, key_filter
from .checks import finding, target_only

CJK_OR_KANA_HANGUL = "[一-鿿ぁ-ゟ゠-ヿ가-힣]"


# --------------------------------------------------------------------------
# full-width punctuation in a Latin-script target
# --------------------------------------------------------------------------

def fullwidth_punct_findings(segments: DataFrame) -> DataFrame:
    """翻译规范 / P2 for target segments in Latin script (no CJK, kana or
    hangul) that contain full-width punctuation; the description lists the
    distinct marks found, sorted."""
    s = target_only(segments).filter(F.col("text").rlike(C.FULLWIDTH_PUNCT_CLASS)
                                     & ~F.col("text").rlike(CJK_OR_KANA_HANGUL))
    marks = F.array_join(F.array_sort(F.array_distinct(
        F.regexp_extract_all("text", F.lit(C.FULLWIDTH_PUNCT_CLASS), 0))), "")
    desc = F.concat(F.lit("Full-width punctuation in target: "), X.quote(marks))
    return finding(s, detector="fullwidth_punct", dimension=C.DIM_STYLE, severity="P2",
                   location="location", description=desc, seq="seq")


# --------------------------------------------------------------------------
# formal and informal address in one document
# --------------------------------------------------------------------------

_NOT_WORD = r"[^\p{L}\p{N}_]"


def _word(form: str, case_sensitive: bool) -> str:
    flags = "" if case_sensitive else "(?iu)"
    return f"{flags}(^|{_NOT_WORD}){form}({_NOT_WORD}|$)"


def register_patterns():
    """(lang, formal, informal, formal regex, informal regex).  German
    ``Sie`` is matched with its capital only (lower-case sie is she/they)."""
    out = []
    for lang, formal, informal in C.REGISTER_FORMS:
        out.append((lang, formal, informal,
                    _word(formal, case_sensitive=(formal == "Sie")),
                    _word(informal, case_sensitive=False)))
    return out


def register_mix_findings(docs: DataFrame, id_col: str = "doc_id",
                          text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """翻译规范 / P2 per document and language that uses both the formal and
    the informal form of address (Sie/du, vous/tu, usted/tú).  Where the
    documents have a language column, only that language's forms count ("du"
    is French too, "tu" Spanish); a document without a language is checked for
    all."""
    text = F.col(text_col)

    def applies(lang):
        if lang_col is None or lang_col not in docs.columns:
            return F.lit(True)
        return F.coalesce(F.lower(F.col(lang_col)) == lang, F.lit(True))

    hits = F.array(*[
        F.when(applies(lang) & text.rlike(fp) & text.rlike(ip),
               F.struct(F.lit(i).cast("bigint").alias("k"), F.lit(lang).alias("lang"),
                        F.lit(formal).alias("formal"), F.lit(informal).alias("informal")))
        for i, (lang, formal, informal, fp, ip) in enumerate(register_patterns())])
    m = docs.select(F.col(id_col).alias("doc_id"), F.explode(hits).alias("h")) \
        .filter(F.col("h").isNotNull()).select("doc_id", "h.*")
    desc = F.concat(F.lit("Mixed formal and informal address ("), F.col("lang"), F.lit("): "),
                    X.quote("formal"), F.lit(" and "), X.quote("informal"))
    return finding(m, detector="register_mix", dimension=C.DIM_STYLE, severity="P2",
                   location=F.lit("Document"), description=desc, seq=F.lit(0), sub="k")


# --------------------------------------------------------------------------
# Japanese / Korean sentence-ending register
# --------------------------------------------------------------------------

def _ends_with_any(forms) -> str:
    return "(" + "|".join(forms) + ")$"


def sentence_endings(text: Column) -> Column:
    """Last (up to) four characters of every sentence (text before a
    sentence-ending mark).  The text is cut at the marks, which looks at each
    character once; what follows the last mark is no sentence."""
    closed = X.let(F.split(text, C.SENTENCE_END_CLASS, -1), lambda runs: F.slice(runs, 1, F.size(runs) - 1))
    return F.filter(F.transform(closed, lambda run: F.substring(run, -4, 4)), lambda e: e != "")


def ending_counts(text: Column) -> Column:
    """The counts of one text as a struct; its endings are found once for all."""
    polite = lambda e: e.rlike(_ends_with_any(C.JA_POLITE_ENDINGS))
    plain = lambda e: e.rlike(_ends_with_any(C.JA_PLAIN_ENDINGS))
    formal = lambda e: e.rlike(_ends_with_any(C.KO_FORMAL_ENDINGS))
    kpol = lambda e: e.rlike(_ends_with_any(C.KO_POLITE_ENDINGS))

    def counts(ends):
        n = lambda pred: F.size(F.filter(ends, pred)).cast("bigint")
        return F.struct(n(polite).alias("ja_polite"), n(lambda e: plain(e) & ~polite(e)).alias("ja_plain"),
                        n(formal).alias("ko_formal"), n(kpol).alias("ko_polite"))

    return X.let(sentence_endings(text), counts)


def register_mix_jako(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of Japanese polite/plain and Korean formal/polite
    sentence endings (computed inside the row)."""
    # inline: the counts of a row are one value, which no later projection works out again
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(ending_counts(F.col(text_col)))))


def register_mix_jako_findings(docs: DataFrame, id_col: str = "doc_id",
                               text_col: str = "text") -> DataFrame:
    """翻译规范 / P2 for documents mixing です・ます with plain endings, or
    합쇼체 with 해요체 endings."""
    c = register_mix_jako(docs, id_col, text_col)
    ja = F.when((F.col("ja_polite") > 0) & (F.col("ja_plain") > 0), F.struct(
        F.lit(0).cast("bigint").alias("k"),
        F.concat(F.lit("Mixed polite and plain sentence endings (ja): "),
                 F.col("ja_polite").cast("string"), F.lit(" polite, "),
                 F.col("ja_plain").cast("string"), F.lit(" plain")).alias("d")))
    ko = F.when((F.col("ko_formal") > 0) & (F.col("ko_polite") > 0), F.struct(
        F.lit(1).cast("bigint").alias("k"),
        F.concat(F.lit("Mixed formal and polite sentence endings (ko): "),
                 F.col("ko_formal").cast("string"), F.lit(" formal, "),
                 F.col("ko_polite").cast("string"), F.lit(" polite")).alias("d")))
    m = c.select("doc_id", F.explode(F.array(ja, ko)).alias("h")).filter(F.col("h").isNotNull())
    return finding(m.select("doc_id", "h.*"), detector="register_mix_jako",
                   dimension=C.DIM_STYLE, severity="P2", location=F.lit("Document"),
                   description=F.col("d"), seq=F.lit(0), sub="k")


# --------------------------------------------------------------------------
# terminology
# --------------------------------------------------------------------------

GRAM = 3          # characters that a term is filed under


def _grams(text: Column, size: Column) -> Column:
    """The different runs of ``size`` characters of a text; none of a shorter one."""
    n = F.length(text)
    places = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, size)))


def filed_terms(glossary: DataFrame) -> DataFrame:
    """(gram, term, approved): each term under the one of its grams that the fewest
    terms have, a term shorter than a gram under itself."""
    g = glossary.select("term", "approved").filter(F.length("term") > 0).distinct()
    size = F.least(F.length("term"), F.lit(GRAM))
    grams = g.select("term").distinct().select("term", F.explode(_grams(F.col("term"), size)).alias("gram"))
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(held, "gram").groupBy("term").agg(F.min(F.struct("n", "gram")).alias("r")).select("term", "r.gram")
    return g.join(rarest, "term").select("gram", "term", "approved")


def term_hits(texts: DataFrame, glossary: DataFrame, text_col: str = "source") -> DataFrame:
    """(text, term, approved) for every glossary term contained in a text.

    Each distinct text is cut into its grams; an equi-join finds the terms filed
    under them, and the term itself is then looked for.  A text meets a term once,
    under the term's one gram, and only terms whose rarest gram it has.  The filed
    glossary is broadcast only behind a row-count check; texts are deduplicated
    first, so a boilerplate text repeated millions of times is cut once.
    """
    filed = checked_broadcast(filed_terms(glossary).persist())
    distinct = texts.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
    grams = F.concat(*[_grams(F.col("text"), F.lit(k)) for k in range(1, GRAM + 1)])
    return distinct.select("text", F.explode(grams).alias("gram")).join(filed, "gram").where(
        F.col("text").contains(F.col("term"))).select("text", "term", "approved")


PART_ROWS = 100_000        # pairs of one source that stay together


def _joined_misses(pairs: DataFrame, glossary: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """As ``_inline_misses``, by joins.  Pairs whose source has no term are left out
    before the shuffle.  The pairs of a source on over ``part_rows`` of them are
    dealt over as many parts as that takes, to each of which its few terms go;
    such sources are at most one for every ``part_rows`` pairs, which bounds their
    broadcast."""
    hits = term_hits(pairs, glossary, "source").withColumnRenamed("text", "source")
    held = key_filter(pairs, hits, ["source"])
    hot = F.broadcast(held.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_parts")).where("_parts > 1"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = hits.join(hot, "source", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    salted = held.join(hot, "source", "left").withColumn(
        "_part", F.pmod(F.xxhash64("pair_seq", "workbook_id"), parts).cast("int")).drop("_parts")
    return salted.join(dealt, ["source", "_part"]).drop("_part").where(~F.col("target").contains(F.col("approved")))


INLINE_TERMS = 2_000


def _inline_misses(pairs: DataFrame, terms: list) -> DataFrame:
    """(pair, term, approved) of the terms in a source whose rendering isn't in
    the target, looked for inside the row."""
    known = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(a).alias("approved")) for t, a in terms]) if terms \
        else F.array().cast("array<struct<term:string,approved:string>>")
    missed = F.filter(known, lambda g: F.col("source").contains(g["term"]) & ~F.col("target").contains(g["approved"]))
    return pairs.select("*", F.inline(missed))


def terminology_findings(pairs: DataFrame, glossary: DataFrame, inline_terms: int = INLINE_TERMS) -> DataFrame:
    """术语错误 / P2 for every pair whose source contains a glossary term and
    whose target does not contain the approved rendering (case-sensitive).
    Pairs without a target are left to the omission check.

    A glossary of at most ``inline_terms`` entries is tested inside the row,
    without any join; of a larger one the terms are found in the distinct
    sources by their rarest grams and joined back to the pairs.  Both give the
    same rows."""
    p = pairs.filter(F.col("target").isNotNull())
    terms = glossary.select("term", "approved").filter(F.length("term") > 0).distinct().limit(inline_terms + 1).collect()
    if len(terms) <= inline_terms:
        bad = _inline_misses(p.filter(F.col("source").isNotNull()), sorted(map(tuple, terms)))
    else:
        bad = _joined_misses(p, glossary)
    desc = F.concat(F.lit("Term "), X.quote("term"), F.lit(" should be rendered as "),
                    X.quote("approved"), F.lit(", target: "),
                    X.quote(X.truncate_text("target", C.CUT_PAIR)))
    return finding(bad, detector="terminology", dimension=C.DIM_TERMINOLOGY, severity="P2",
                   doc_id="workbook_id", location=X.loc_cell("sheet", "coordinate"),
                   description=desc, seq="pair_seq",
                   sub=F.position(F.col("term"), F.col("source")))
