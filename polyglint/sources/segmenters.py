"""Segmenters: documents / pages / decoded office tables -> located segments.

Every segmenter is a narrow transformation (explode + projection + filter):
no shuffle, no window, so each one also runs unchanged on a streaming
DataFrame.  Output columns: ``doc_id, seq, location, text`` plus the
format-specific ordinals.  ``seq`` is the document order of the segment: a
BIGINT, or a DECIMAL(38,0) where it is made of several ordinals without a bound
(tables, slides, pages); both merge into one order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import text as X

NEWLINES = r"\r\n|\r|\n"          # universal-newline line split of a text file


def _bigint(c) -> Column:
    return X.col_(c).cast("bigint")


# --------------------------------------------------------------------------
# plain text (.txt / .csv / unknown suffix)
# --------------------------------------------------------------------------

def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  pattern: str = NEWLINES) -> DataFrame:
    """One row per physical line: ``doc_id, line_no (1-based), raw, line``.
    Blank and short lines are kept so that numbering counts them."""
    return (docs
            .select(F.col(id_col).alias("doc_id"),
                    F.posexplode(F.split(F.col(text_col), pattern, -1)).alias("pos", "raw"))
            .select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "raw",
                    X.py_strip("raw").alias("line")))


SEGMENTS = "array<struct<seq:bigint,location:string,text:string,tag:string>>"


def _inlined(docs: DataFrame, id_col: str, segments: Column, *extra: str) -> DataFrame:
    """One row per segment of an in-row segment array."""
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(segments)).select(
        "doc_id", "seq", "location", "text", *extra)


def line_segments(text, min_len: int = 1) -> Column:
    """The segments of a plain text, as an array inside the row."""
    lines = F.transform(F.split(X.col_(text), NEWLINES, -1), X.py_strip)
    located = F.transform(lines, lambda x, i: F.struct(
        (i + 1).cast("bigint").alias("seq"), X.loc_line(i + 1).alias("location"), x.alias("text"),
        F.lit(None).cast("string").alias("tag")))
    return F.filter(located, lambda s: F.length(s["text"]) > min_len)


def segment_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_len: int = 1) -> DataFrame:
    """Text-file segmentation: strip each line, keep those longer than
    ``min_len`` code points, location ``Line N`` (N counts every line)."""
    return _inlined(docs, id_col, line_segments(text_col, min_len)).withColumn("line_no", F.col("seq"))


# --------------------------------------------------------------------------
# markdown
# --------------------------------------------------------------------------

FENCE = "```"


def fences_before(fences: Column, pos: Column) -> Column:
    """Number of fence positions (a sorted array) below ``pos``: a lower-bound
    binary search as an ``aggregate`` over (lo, hi) with as many steps as the
    number of fences needs, so that a document with n lines and f fences costs
    O(n log f)."""

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        below = F.element_at(fences, mid + 1) < pos
        return F.when(lo >= hi, acc).when(
            below, F.struct((mid + 1).alias("lo"), hi.alias("hi"))).otherwise(
            F.struct(lo.alias("lo"), mid.alias("hi")))

    return F.when(F.size(fences) == 0, F.lit(0)).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.ceil(F.log2(F.size(fences) + 1)).cast("int")),
        F.struct(F.lit(0).alias("lo"), F.size(fences).alias("hi")), step)["lo"])


def marked_lines(text) -> Column:
    """Array of (line_no, line, is_fence, in_code): every line whose stripped
    form starts with three backticks toggles a fence.  Parity is decided here,
    inside the row, before anything is exploded."""

    def with_fences(lines):
        marks = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith(FENCE), i)),
                         lambda i: i.isNotNull())
        return X.let(marks, lambda fences: F.transform(lines, lambda x, i: F.struct(
            (i + 1).cast("bigint").alias("line_no"), x.alias("line"),
            x.startswith(FENCE).alias("is_fence"),
            (fences_before(fences, i) % 2 == 1).alias("in_code"))))

    return X.let(F.transform(F.split(X.col_(text), NEWLINES, -1), X.py_strip), with_fences)


def markdown_segments(text) -> Column:
    """The segments of a markdown text, as an array inside the row."""
    kept = F.filter(marked_lines(text), lambda s: ~s["is_fence"] & ~s["in_code"]
                    & ~s["line"].startswith("#") & (F.length(s["line"]) > 1))
    return F.transform(kept, lambda s: F.struct(
        s["line_no"].alias("seq"), X.loc_line(s["line_no"]).alias("location"), s["line"].alias("text"),
        F.lit(None).cast("string").alias("tag")))


def segment_markdown(docs: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Markdown segmentation: fence lines, lines inside fences (an unclosed
    fence swallows the rest of the document), heading lines (``#``) and lines
    of one character or less are dropped."""
    return _inlined(docs, id_col, markdown_segments(text_col)).withColumn("line_no", F.col("seq"))


def fence_parity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line with ``is_fence`` and ``in_code`` (an odd number of fence
    lines before it)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(marked_lines(text_col))).select(
        "doc_id", "line_no", "is_fence", "in_code")


# --------------------------------------------------------------------------
# HTML
# --------------------------------------------------------------------------

MARK_PIECE = "\x01"   # starts a piece of text at every block tag
MARK_TAG = "\x02"     # ends the tag at the start of a piece
EMPTY_TAG = "<>"      # stands in for a removed node, so text nodes stay apart
# a tag begins with a letter, "/", "!" or "?" behind "<"; any other "<" is text
TAG = r"<(?:[A-Za-z/!?][^>]*)?>"
END_OF_PAGE = 1 << 30


def _skip_pattern() -> str:
    parts = [rf"<{t}(\s[^>]*)?>.*?</{t}\s*>" for t in C.HTML_SKIP_TAGS]
    return "(?is)" + "|".join(parts + ["<!--.*?-->"])


def _block_pattern() -> str:
    return r"(?i)<(/?)(" + "|".join(C.HTML_BLOCK_TAGS) + r")(\s[^>]*)?/?>"


def _inline_tag_pattern() -> str:
    # a tag plus the whitespace around it: text nodes are stripped one by one
    return rf"{C.STRIP_CLASS}*{TAG}{C.STRIP_CLASS}*"


def _references() -> Column:
    """Named character references as a literal map, from the standard list;
    those that would read as markup are decoded apart from these."""
    from html.entities import name2codepoint
    names = {n: chr(c) for n, c in name2codepoint.items() if n not in ("lt", "gt", "amp")} | {"apos": "'"}
    # one literal, which the optimiser reads once
    return F.from_json(F.lit(json.dumps(names, sort_keys=True)), "map<string,string>")


def decode_references(c) -> Column:
    """Named and numeric character references as characters, all but those of
    ``<``, ``>`` and ``&``; a code that is no character becomes U+FFFD."""
    c = X.col_(c)
    found = r"^(#[0-9]{1,18}|#[xX][0-9a-fA-F]{1,15}|[A-Za-z][A-Za-z0-9]*);"

    def one(part):
        name = F.regexp_extract(part, found, 1)
        digits = F.regexp_replace(name, "^#[xX]?", "")
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).try_cast("bigint")
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        shown = (F.when(name == "", F.lit(None)).when(~name.startswith("#"), F.try_element_at(_references(), name))
                 .when(~code.isin(60, 62, 38), char))
        return F.when(shown.isNull(), F.concat(F.lit("&"), part)).otherwise(
            F.concat(shown, F.substr(part, F.length(name) + 2, F.lit(1 << 30))))

    def decoded(parts):
        return F.concat(F.element_at(parts, 1), F.array_join(
            F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))

    return F.when(c.contains("&"), X.let(F.split(c, "&", -1), decoded)).otherwise(c)


def html_text(inner) -> Column:
    """Text of an HTML fragment as the concatenation of its stripped text
    nodes: references decoded first (a no-break space is white space at a
    node's edge), then every tag removed with the white space next to it, the
    references of ``<``, ``>`` and ``&`` last."""
    t = F.regexp_replace(decode_references(inner), _inline_tag_pattern(), "")
    t = X.py_strip(t)
    for char, refs in C.HTML_MARKUP_REFERENCES:
        for ref in refs:
            t = F.replace(t, F.lit(ref), F.lit(char))
    return t


def html_pieces(html) -> Column:
    """Array of ``tag \\x02 text``, one piece from each block tag to the next;
    a closing tag is written ``/tag``.  The first piece has no tag."""
    h = F.regexp_replace(X.col_(html), _skip_pattern(), EMPTY_TAG)
    h = F.regexp_replace(h, _block_pattern(), MARK_PIECE + "$1$2" + MARK_TAG)
    return F.split(h, MARK_PIECE, -1)


# The fold below copies what it has gathered at every step, so it gathers the
# elements of so many marks at a time.
MARKS_A_CHUNK = 64
_NO_INTS = "array<int>"
_DONE = "array<struct<i:int,code:int,j:int>>"
_PARAGRAPH = C.HTML_BLOCK_TAGS.index("p") + 1
_HEADINGS = [C.HTML_BLOCK_TAGS.index(t) + 1 for t in C.HTML_TEXT_TAGS if t[0] == "h"]
_TEXT_CODES = len(C.HTML_TEXT_TAGS)          # text elements have the lowest codes
OPENS, CLOSES, LEAF = 0, 1, 2                # a leaf opens and is closed by the next block tag


def _codes(tags: list[str]) -> list[int]:
    return [C.HTML_BLOCK_TAGS.index(t) + 1 for t in tags]


def _ended_by(mark: Column, codes: Column) -> Column:
    """How many of the open elements (innermost first) end at a mark."""

    def nearest(tags):
        places = [F.coalesce(F.nullif(F.array_position(codes, c), F.lit(0)), F.lit(END_OF_PAGE)) for c in _codes(tags)]
        return F.least(*places) if len(places) > 1 else places[0]

    top = F.try_element_at(codes, F.lit(1))
    implied = F.when(top == _PARAGRAPH, 1).when(mark["code"].isin(_HEADINGS) & top.isin(_HEADINGS), 1).otherwise(0)

    def inside(fence):
        return lambda n: F.when((n < END_OF_PAGE) & (n < nearest(fence)), F.greatest(n, implied)).otherwise(implied)

    opens = F.when(mark["kind"] == CLOSES, F.array_position(codes, mark["code"]))
    for starts, ended, fence in C.HTML_IMPLIED_ENDS:
        opens = opens.when(mark["code"].isin(_codes(starts)), X.let(nearest(ended), inside(fence)))
    return opens.otherwise(implied).cast("int")


def _marks(pieces: Column) -> Column:
    """Array of (i, code, kind) of the block tags of a page: tag i starts piece i.

    Of an element that the next block tag closes there is one mark, and of such
    elements of one kind in a row only the first: what its beginning ends is
    ended when the others begin.  (A heading may end one more heading.)"""
    names = F.array(*[F.lit(t) for t in C.HTML_BLOCK_TAGS])

    def mark(piece, i):
        tag = F.lower(F.substring_index(piece, MARK_TAG, 1))
        return F.struct((i + 1).cast("int").alias("i"),
                        F.array_position(names, F.ltrim(tag, F.lit("/"))).cast("int").alias("code"),
                        F.when(tag.startswith("/"), CLOSES).otherwise(OPENS).alias("kind"))

    def leaves(tags):
        def kind(x, k):
            after = F.try_element_at(tags, k + 2)
            return F.struct(x["i"].alias("i"), x["code"].alias("code"), F.when(
                (x["kind"] == OPENS) & (after["kind"] == CLOSES) & (after["code"] == x["code"]), LEAF).otherwise(x["kind"]).alias("kind"))
        return F.transform(tags, kind)

    # the first piece has no tag
    return X.let(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), mark), leaves)


def _steps(marks: Column) -> Column:
    """The marks that the stack of open elements has to see."""
    def needed(x, k):
        before = F.try_element_at(marks, F.when(k > 0, k).otherwise(F.size(marks) + 1))
        twice = F.try_element_at(marks, F.when(k > 1, k - 1).otherwise(F.size(marks) + 1))
        closed = (x["kind"] == CLOSES) & F.coalesce(before["kind"] == LEAF, F.lit(False))
        again = ((x["kind"] == LEAF) & ~x["code"].isin(_HEADINGS)
                 & F.coalesce((twice["kind"] == LEAF) & (twice["code"] == x["code"]), F.lit(False)))
        return ~closed & ~again

    return F.filter(marks, needed)


def html_elements(pieces: Column) -> Column:
    """Array of (i, tag, j): the text elements among ``pieces``, each from its
    opening tag (piece i) to the piece j that ends it.

    Elements that the next block tag closes are told by the two tags alone.  A
    fold over the other tags keeps the stack of open block elements: a closing
    tag ends its element and what is open inside; one without its element is
    ignored.  A paragraph ends where a block begins, a heading where another
    one does, and items, cells and rows as ``HTML_IMPLIED_ENDS`` says.  Marks go
    by in chunks, so that the time is in proportion to their number (and to the
    depth of nesting).
    """
    names = F.array(*[F.lit(t) for t in C.HTML_BLOCK_TAGS])
    place = lambda i, code, j: F.struct(i.alias("i"), code.alias("code"), j.alias("j"))

    def step(acc, x):
        codes, starts = acc["codes"], acc["starts"]

        def moved(gone):     # so many elements end here
            depth = F.size(codes)
            left = lambda a: F.when(gone == 0, a).otherwise(F.slice(a, gone + 1, depth - gone))
            after = lambda a, v: F.when(x["kind"] == OPENS, F.concat(F.array(v), left(a))).otherwise(left(a))
            ended = F.filter(F.transform(F.slice(starts, 1, gone), lambda i, k: place(i, F.element_at(codes, k + 1), x["i"])),
                             lambda e: e["code"] <= _TEXT_CODES)
            return F.struct(after(codes, x["code"]).alias("codes"), after(starts, x["i"]).alias("starts"),
                            F.when(gone == 0, acc["done"]).otherwise(F.concat(acc["done"], ended)).alias("done"))

        return X.let(_ended_by(x, codes), moved)

    def state(codes, starts, done):
        return F.struct(codes.alias("codes"), starts.alias("starts"), done.alias("done"))

    none = F.array().cast(_NO_INTS)

    def folded(marks):
        def through(acc, k):
            part = F.slice(marks, k * MARKS_A_CHUNK + 1, MARKS_A_CHUNK)
            return X.let(F.aggregate(part, state(acc["codes"], acc["starts"], F.array().cast(_DONE)), step),
                         lambda r: state(r["codes"], r["starts"], F.concat(acc["done"], F.array(r["done"]))))

        def rest(acc):       # elements that nothing ends reach to the end of the page
            open_ = F.transform(acc["starts"], lambda i, k: place(i, F.element_at(acc["codes"], k + 1), F.lit(END_OF_PAGE)))
            return F.concat(F.flatten(acc["done"]), F.filter(open_, lambda e: e["code"] <= _TEXT_CODES))

        chunks = F.when(F.size(marks) > 0, F.sequence(F.lit(0), F.floor((F.size(marks) - 1) / MARKS_A_CHUNK).cast("int"))).otherwise(none)
        return F.aggregate(chunks, state(none, none, F.array().cast(f"array<{_DONE}>")), through, rest)

    def elements(marks):
        leaves = F.filter(marks, lambda m: (m["kind"] == LEAF) & (m["code"] <= _TEXT_CODES))
        return F.concat(F.transform(leaves, lambda m: place(m["i"], m["code"], m["i"] + 1)), X.let(_steps(marks), folded))

    return F.transform(F.array_sort(X.let(_marks(pieces), elements)), lambda e: F.struct(
        e["i"].alias("i"), F.element_at(names, e["code"]).alias("tag"), e["j"].alias("j")))


def html_segments(html) -> Column:
    """The segments of an HTML page, as an array inside the row."""

    def with_texts(pieces):
        texts = F.transform(pieces, lambda p: html_text(F.substring_index(p, MARK_TAG, -1)))
        return X.let(F.struct(texts.alias("texts"), html_elements(pieces).alias("elements")), located)

    def located(page):
        found = F.transform(page["elements"], lambda e: F.struct(
            e["i"].cast("bigint").alias("seq"), e["tag"].alias("tag"),
            F.array_join(F.slice(page["texts"], e["i"] + 1, e["j"] - e["i"]), "").alias("text")))
        kept = F.filter(found, lambda s: F.length(s["text"]) > 1)
        return F.transform(kept, lambda s: F.struct(
            s["seq"].alias("seq"), X.loc_html(s["tag"], s["text"]).alias("location"), s["text"].alias("text"),
            s["tag"].alias("tag")))

    return X.let(html_pieces(html), with_texts)


def segment_html(pages: DataFrame, id_col: str = "page_id",
                 html_col: str = "html") -> DataFrame:
    """HTML segmentation without a DOM.

    script/style/nav/footer/code/pre subtrees and comments are removed; each
    h1-h6/p/li/td/th element yields the text of its whole subtree, so that
    nested elements yield theirs too; text of one character or less is
    dropped.  Location: ``<tag> "text"``, the text cut at 40 code points plus
    ``...``.
    """
    return _inlined(pages, id_col, html_segments(html_col), "tag")


# --------------------------------------------------------------------------
# workbook cells (decoded table: workbook_id, sheet, sheet_idx, row_no, col_no,
# value [, value_type])
# --------------------------------------------------------------------------

def packed(*parts: tuple) -> Column:
    """Order key of (value, bits) parts in one BIGINT, the first part highest, for
    values that the format keeps below their bits.  One beyond them sorts as the
    largest: a bad ordinal costs its own order, not the run."""
    assert sum(bits for _, bits in parts) <= 63
    out = None
    for value, bits in parts:
        v = F.least(F.greatest(_bigint(value), F.lit(0)), F.lit((1 << bits) - 1))
        out = v if out is None else out * F.lit(1 << bits) + v
    return out


ORDINAL = 1 << 31


def place_key(*parts) -> Column:
    """Order key of up to four ordinals (any 31-bit number) and one bit in one
    DECIMAL(38,0), the first part highest: pages, tables, rows and columns of any
    number.  A part (value, 2) is the bit."""
    out = None
    for part in parts:
        value, base = part if isinstance(part, tuple) else (part, ORDINAL)
        v = F.least(F.greatest(_bigint(value), F.lit(0)), F.lit(base - 1)).cast("decimal(38,0)")
        out = v if out is None else (out * F.lit(base).cast("decimal(10,0)") + v).cast("decimal(38,0)")
    return out


# Cell order keys: sheets 2^18, columns 2^15 (the sheet format ends at column 2^14), rows 2^30.
SHEET_SHIFT = 45
PAIR_COL_SHIFT = 30
CELL_ROW_SHIFT = 15


def cell_seq(sheet_idx, row_no, col_no) -> Column:
    """Row-major order of a cell inside its workbook."""
    return packed((sheet_idx, 18), (row_no, 30), (col_no, 15))


def pair_seq(sheet_idx, col_no, row_no) -> Column:
    """Column-major order of a cell inside its workbook (comparison order)."""
    return packed((sheet_idx, 18), (col_no, 15), (row_no, 30))


def admit_cells(cells: DataFrame, admit: str = "nonnull") -> DataFrame:
    """Cell admission, one of:

    * ``truthy``  — non-blank, and not a zero number or a false boolean;
    * ``nonnull`` — non-NULL and non-blank after strip;
    * ``string``  — string-typed (``value_type = 'str'``) and non-blank.
    Without a ``value_type`` column every value counts as a string.
    """
    v = F.col("value")
    ok = v.isNotNull() & (X.py_strip(v) != "")
    has_type = "value_type" in cells.columns
    if admit == "truthy" and has_type:
        vt = F.col("value_type")
        zero = vt.isin("int", "float") & (v.try_cast("double") == 0)
        false_ = (vt == "bool") & (F.lower(v) == "false")
        ok = ok & ~F.coalesce(zero | false_, F.lit(False))
    elif admit == "string" and has_type:
        ok = ok & (F.col("value_type") == "str")
    elif admit not in ("truthy", "nonnull", "string"):
        raise ValueError(f"unknown admission {admit!r}")
    return cells.filter(ok)


def segment_cells(cells: DataFrame, admit: str = "truthy") -> DataFrame:
    """Workbook cells as segments, row-major, location ``Sheet!A1``."""
    adm = admit_cells(cells, admit)
    return adm.select(
        F.col("workbook_id").alias("doc_id"),
        cell_seq("sheet_idx", "row_no", "col_no").alias("seq"),
        X.loc_cell("sheet", X.a1_coordinate("col_no", "row_no")).alias("location"),
        X.py_strip("value").alias("text"),
        "sheet", "sheet_idx", "row_no", "col_no")


def cell_map(cells: DataFrame) -> DataFrame:
    """Compare-side cell admission: non-NULL, non-blank, stripped value."""
    return admit_cells(cells, "nonnull").withColumn("value", X.py_strip("value"))


def scan_cells(cells: DataFrame) -> DataFrame:
    """Scan-side cells: string values only, with language, CJK flag and
    code-point count."""
    adm = admit_cells(cells, "string").withColumn("value", X.py_strip("value"))
    return adm.select(
        "workbook_id", "sheet", "sheet_idx", "row_no", "col_no",
        X.a1_coordinate("col_no", "row_no").alias("coordinate"),
        cell_seq("sheet_idx", "row_no", "col_no").alias("cell_seq"),
        "value",
        X.detect_language("value").alias("lang"),
        X.has_cjk("value").alias("has_cjk"),
        X.char_count("value").alias("char_count"))


# --------------------------------------------------------------------------
# decoded Word / PowerPoint / PDF tables
# --------------------------------------------------------------------------

def _nonblank_text(df: DataFrame, min_len: int = 0) -> DataFrame:
    return nonblank_filter(df, min_len)


def nonblank_filter(df: DataFrame, min_len: int = 0, text_col: str = "text") -> DataFrame:
    """Keep rows whose stripped text is longer than ``min_len`` code points
    (0: non-blank); the text column is replaced by its stripped form."""
    t = X.py_strip(text_col)
    return df.withColumn(text_col, t).filter(F.col(text_col).isNotNull()
                                             & (F.length(text_col) > min_len))


def segment_paragraphs(paras: DataFrame) -> DataFrame:
    """(doc_id, para_no, style, text) -> ``Paragraph N [Style]`` segments;
    the style tag is left out for Normal or missing styles."""
    p = _nonblank_text(paras)
    return p.select("doc_id", _bigint("para_no").alias("seq"),
                    X.loc_paragraph("para_no", "style").alias("location"), "text")


def segment_doc_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, col_no, text) -> ``Table T, Row R, Col C``.
    Tables come after all paragraphs in document order."""
    c = _nonblank_text(cells)
    seq = place_key((F.lit(1), 2), "table_no", "row_no", "col_no")
    return c.select("doc_id", seq.alias("seq"),
                    X.loc_table("table_no", "row_no", "col_no").alias("location"), "text")


def _slide_seq(slide_no, shape_no, kind: int, a, b) -> Column:
    return place_key(slide_no, shape_no, (F.lit(kind), 2), a, b)


def segment_slides(paras: DataFrame) -> DataFrame:
    """(doc_id, slide_no, shape_no, para_no, text) -> ``Slide S, Paragraph P``.
    Paragraph numbers restart per shape, so locations need not be unique."""
    p = _nonblank_text(paras)
    return p.select("doc_id", _slide_seq("slide_no", "shape_no", 0, "para_no", F.lit(0))
                    .alias("seq"),
                    X.loc_slide_paragraph("slide_no", "para_no").alias("location"),
                    "text", "shape_no")


def segment_slide_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, slide_no, shape_no, row_no, col_no, text) ->
    ``Slide S, Table Row R, Col C``."""
    c = _nonblank_text(cells)
    return c.select("doc_id", _slide_seq("slide_no", "shape_no", 1, "row_no", "col_no")
                    .alias("seq"),
                    X.loc_slide_table("slide_no", "row_no", "col_no").alias("location"),
                    "text", "shape_no")


def segment_page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) -> one segment per line of the page text
    (split on newline only), stripped, longer than one code point,
    ``Page P, Line L``."""
    lines = pages.select("doc_id", "page_no",
                         F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    lines = lines.withColumn("text", X.py_strip("raw")).filter(F.length("text") > 1)
    return lines.select("doc_id",
                        place_key("page_no", (F.lit(0), 2), F.col("pos"), F.lit(0), F.lit(0)).alias("seq"),
                        X.loc_page_line("page_no", F.col("pos") + 1).alias("location"),
                        "text")


def segment_page_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_no, row_no, col_no, text) ->
    ``Page P, Table Row R, Col C`` (the table text also appears as lines)."""
    c = _nonblank_text(cells)
    seq = place_key("page_no", (F.lit(1), 2), "table_no", "row_no", "col_no")
    return c.select("doc_id", seq.alias("seq"),
                    X.loc_page_table("page_no", "row_no", "col_no").alias("location"),
                    "text")


# --------------------------------------------------------------------------
# routing by file suffix
# --------------------------------------------------------------------------

def route_format(docs: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``suffix`` (lower case, with dot), ``format`` (suffix without the
    dot) and ``parser`` (unknown suffixes read as plain text)."""
    suffix = X.file_suffix(path_col)
    return (docs.withColumn("suffix", suffix)
            .withColumn("format", F.substring(F.col("suffix"), 2, 1 << 20))
            .withColumn("parser", X.parser_for_suffix("suffix")))


def segment_routed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   path_col: str = "path") -> DataFrame:
    """Segment a mixed corpus by suffix: txt/csv/unknown as lines, md as
    markdown, html/htm as HTML; one pass, one array per document.  Binary
    formats (xlsx/docx/pptx/pdf) come as decoded tables instead
    (``segment_cells``, ``segment_paragraphs`` ...): they yield no segment here
    and ``unsegmented`` lists them."""
    return route_format(docs, path_col).select(
        F.col(id_col).alias("doc_id"), "format", "parser", F.inline(routed_segments(text_col))).select(
        "doc_id", "format", "parser", "seq", "location", "text")


def routed_segments(text) -> Column:
    """The segments of a routed document (column ``parser``), as an array inside
    the row; null where they come as decoded tables."""
    text = X.col_(text)
    return (F.when(F.col("parser") == "md", markdown_segments(text))
            .when(F.col("parser") == "html", html_segments(text))
            .when(F.col("parser") == "txt", line_segments(text)))


def unsegmented(docs: DataFrame, id_col: str = "doc_id", path_col: str = "path") -> DataFrame:
    """(doc_id, format, parser) of the documents that ``segment_routed`` leaves
    to the decoded-table segmenters."""
    return route_format(docs, path_col).where(~F.col("parser").isin("txt", "md", "html")).select(
        F.col(id_col).alias("doc_id"), "format", "parser")
