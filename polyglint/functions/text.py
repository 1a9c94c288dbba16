"""Scalar column functions.

All of these build JVM-side expressions (regexes, higher-order array
functions, CASE chains), so they stay inside whole-stage codegen.  No Python
code runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C

def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often
    ``body`` uses it (an expression that stands in several places of a lambda
    would be evaluated at each of them)."""
    return F.element_at(F.transform(F.array(value), body), 1)


_SLOT = re.compile(r"\{(\w+)\}")


def render(template: str, **values) -> Column:
    """A message / location template from ``catalog`` as one ``concat``:
    literal parts as literals, ``{name}`` slots from ``values`` (columns or
    column names; numbers are cast to string)."""
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(col_(values[m.group(1)]).cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


# --------------------------------------------------------------------------
# strings
# --------------------------------------------------------------------------

def py_strip(c) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip()`` does
    (Unicode spaces and U+001C..U+001F, but not U+200B / U+FEFF).

    Most values need no strip: only when the first or last character is
    whitespace does the (end-anchored, so full-scan) regex run."""
    c = col_(c)
    edge = (F.substring(c, 1, 1).rlike(C.STRIP_CLASS)
            | F.substring(c, -1, 1).rlike(C.STRIP_CLASS))
    return F.when(edge, F.regexp_replace(c, rf"\A{C.STRIP_CLASS}+|{C.STRIP_CLASS}+\z", "")) \
        .otherwise(c)


def is_blank(c) -> Column:
    c = col_(c)
    return c.isNull() | (py_strip(c) == "")


def truncate_text(c, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(col_(c), 1, n)


def char_count(c) -> Column:
    return F.length(col_(c)).cast("bigint")


def quote(c) -> Column:
    return F.concat(F.lit("'"), col_(c), F.lit("'"))


# how Python's repr writes the characters that it does not print
_ESCAPES = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t",
            **{chr(c): f"\\x{c:02x}" for c in [*range(9), 11, 12, *range(14, 32), *range(127, 161), 173]},
            **{chr(c): f"\\u{c:04x}" for c in [0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F,
                                               0x2060, 0x3000, 0xFEFF]}}
_ESCAPED = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _ESCAPES) + "]"


def str_repr(c) -> Column:
    """A string as Python's ``repr`` prints it: in double quotes if it holds a
    single quote but no double one, else in single quotes, with backslashes,
    control characters and unprinted spaces escaped."""
    c = col_(c)
    escaped = c
    for ch, shown in _ESCAPES.items():
        escaped = F.replace(escaped, F.lit(ch), F.lit(shown))
    plain = F.when(c.rlike(_ESCAPED), escaped).otherwise(c)
    return F.when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), plain, F.lit('"'))) \
        .otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def list_repr(arr) -> Column:
    """``['a', "l'b"]`` — list shown the way a Python list of strings prints."""
    return F.concat(F.lit("["), F.array_join(F.transform(col_(arr), str_repr), ", "), F.lit("]"))


# --------------------------------------------------------------------------
# script / language
# --------------------------------------------------------------------------

def has_cjk(c, script_class: str = C.CJK_CLASS) -> Column:
    """True when the text holds a code point of ``script_class`` (default the
    "Chinese" range U+4E00..U+9FFF, which includes Japanese kanji but not
    extension A, kana or full-width punctuation); NULL -> false."""
    return F.coalesce(col_(c).rlike(script_class), F.lit(False))


def count_matches(c, pattern: str) -> Column:
    """Number of non-overlapping matches."""
    return F.regexp_count(col_(c), F.lit(pattern)).cast("bigint")


def find_terms(c, pattern: str) -> Column:
    """All matches (group 0), in text order."""
    return F.regexp_extract_all(col_(c), F.lit(pattern), 0)


MAX_LANGUAGE_RULES = 1_000


def language_rules(rules) -> list[tuple[str, str]]:
    """Language rules as an ordered list of (code, regex): as it is, or out of a
    table (ord, lang, pattern), which is read once on the driver.  A table of over
    ``MAX_LANGUAGE_RULES`` rows is refused."""
    if not isinstance(rules, DataFrame):
        return list(rules)
    rows = rules.select("ord", "lang", "pattern").orderBy("ord", "lang").limit(MAX_LANGUAGE_RULES + 1).collect()
    if len(rows) > MAX_LANGUAGE_RULES:
        raise ValueError(f"at most {MAX_LANGUAGE_RULES} language rules")
    return [(r["lang"], r["pattern"]) for r in rows]


def language_scores(c, patterns=C.LANG_PATTERNS) -> dict[str, Column]:
    return {lang: count_matches(c, pat) for lang, pat in patterns}


def detect_language(c, patterns=C.LANG_PATTERNS) -> Column:
    """Most likely language code.

    Scores are match counts per class; the highest wins, ties go to the
    earlier class (default order EN, JA, KO, DE, FR, ES); no score at all is
    the first class (EN); blank or NULL text is ``unknown``.  ``patterns`` is
    an ordered list of (code, regex) or a table of them (``language_rules``);
    without any rule, texts are ``unknown``.  Each regex stands once in the expression: the scores become one array of
    (score, rank, code) and its maximum decides.
    """
    c = col_(c)
    scores = language_scores(c, language_rules(patterns))
    if not scores:
        return F.lit(C.LANG_UNKNOWN)
    best = F.array_max(F.array(*[
        F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(lang).alias("lang"))
        for i, (lang, score) in enumerate(scores.items())]))
    return F.when(is_blank(c), F.lit(C.LANG_UNKNOWN)).otherwise(best["lang"])


def lang_name(c) -> Column:
    """Name of a language code (NULL for ``unknown``); ``c`` is used once."""
    names = F.create_map(*[F.lit(x) for pair in C.LANG_NAMES.items() for x in pair])
    return F.try_element_at(names, col_(c))


# --------------------------------------------------------------------------
# spreadsheet coordinates and sheet names
# --------------------------------------------------------------------------

_ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COORD_RE = r"^([A-Z]+)(\d+)"


def parse_coordinate(c) -> Column:
    """``AB12`` -> struct(col_no=28, row_no=12); no match -> (0, 0)."""
    c = col_(c)
    letters = F.regexp_extract(c, _COORD_RE, 1)
    digits = F.regexp_extract(c, _COORD_RE, 2)
    col_no = F.aggregate(F.split(letters, ""), F.lit(0).cast("bigint"),
                         lambda acc, ch: acc * 26 + F.ascii(ch) - 64)
    ok = letters != ""
    return F.struct(
        F.when(ok, col_no).otherwise(F.lit(0).cast("bigint")).alias("col_no"),
        F.when(ok, digits.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("row_no"),
    )


def _letter(n: Column) -> Column:
    return F.substr(F.lit(_ALPHA), ((n - 1) % 26 + 1).cast("int"), F.lit(1))


def column_letters(col_no) -> Column:
    """1 -> A, 27 -> AA, 16384 -> XFD (up to three letters)."""
    n1 = col_(col_no).cast("bigint")
    n2 = F.floor((n1 - 1) / 26).cast("bigint")
    n3 = F.floor((n2 - 1) / 26).cast("bigint")
    return F.concat(F.when(n3 > 0, _letter(n3)).otherwise(F.lit("")),
                    F.when(n2 > 0, _letter(n2)).otherwise(F.lit("")),
                    _letter(n1))


def a1_coordinate(col_no, row_no) -> Column:
    return F.concat(column_letters(col_no), col_(row_no).cast("string"))


def strip_sheet_suffix(c) -> Column:
    """Right-strip the characters ``_ E N J A K O D F R S`` from a sheet name."""
    return F.regexp_replace(col_(c), f"[{C.SHEET_SUFFIX_CHARS}]+\\z", "")


# --------------------------------------------------------------------------
# paths
# --------------------------------------------------------------------------

def file_name(path) -> Column:
    return F.regexp_extract(col_(path), r"([^/]*)$", 1)


def file_suffix(path) -> Column:
    """Lower-cased extension with the dot (``.md``), '' when there is none.
    A leading dot alone (``.bashrc``) is not an extension."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def parser_for_suffix(suffix) -> Column:
    s = col_(suffix)
    expr = None
    for suf, parser in C.SUFFIX_PARSERS.items():
        expr = (F.when(s == suf, F.lit(parser)) if expr is None
                else expr.when(s == suf, F.lit(parser)))
    return expr.otherwise(F.lit(C.DEFAULT_PARSER))


def compare_mode(source_path) -> Column:
    return F.when(file_suffix(source_path).isin(C.EXCEL_SUFFIXES), F.lit("excel")) \
        .otherwise(F.lit("generic"))


# --------------------------------------------------------------------------
# locations
# --------------------------------------------------------------------------

def loc_cell(sheet, coordinate) -> Column:
    return render(C.LOCATIONS["cell"], sheet=sheet, coordinate=coordinate)


def loc_line(line_no) -> Column:
    return render(C.LOCATIONS["line"], line=line_no)


def loc_paragraph(para_no, style) -> Column:
    st = col_(style)
    tag = F.when(st.isNull() | (st == "Normal"), F.lit("")) \
        .otherwise(render(C.LOCATIONS["paragraph_style"], style=st))
    return render(C.LOCATIONS["paragraph"], para=para_no, style=tag)


def loc_table(table_no, row_no, col_no) -> Column:
    return render(C.LOCATIONS["table"], table=table_no, row=row_no, col=col_no)


def loc_slide_paragraph(slide_no, para_no) -> Column:
    return render(C.LOCATIONS["slide_paragraph"], slide=slide_no, para=para_no)


def loc_slide_table(slide_no, row_no, col_no) -> Column:
    return render(C.LOCATIONS["slide_table"], slide=slide_no, row=row_no, col=col_no)


def loc_page_line(page_no, line_no) -> Column:
    return render(C.LOCATIONS["page_line"], page=page_no, line=line_no)


def loc_page_table(page_no, row_no, col_no) -> Column:
    return render(C.LOCATIONS["page_table"], page=page_no, row=row_no, col=col_no)


def loc_html(tag, text) -> Column:
    t = col_(text)
    shown = F.when(F.length(t) > C.CUT_HTML_LOCATION,
                   F.concat(truncate_text(t, C.CUT_HTML_LOCATION), F.lit("...")))\
        .otherwise(t)
    return render(C.LOCATIONS["html"], tag=tag, text=shown)


def loc_sheet(sheet) -> Column:
    return render(C.LOCATIONS["sheet"], sheet=sheet)


# --------------------------------------------------------------------------
# display helpers
# --------------------------------------------------------------------------

def format_ratio(c) -> Column:
    """One decimal, rounded on the exact binary value with ties to even — the
    way Python prints ``f"{x:.1f}"`` (``format_number`` rounds through
    ``DecimalFormat``, which decides on the exact binary value); the
    grouping commas it adds are removed."""
    return F.regexp_replace(F.format_number(col_(c).cast("double"), 1), ",", "")
