"""DuckDB oracle SQL for the registered queries.

Every query is written again, independently, in plain SQL over the bundled
tables (pre-registered views).  Derived inputs are common table
expressions; ``sql(body, *ctes)`` pulls in the CTEs a body needs together
with their dependencies.  Engine notes: RE2 has no look-ahead (the Taiwan
rule removes "Taiwan <space> Strait" first), replacement groups are ``\\1``,
``regexp_replace`` needs ``'g'``, and ``||`` (not ``concat``) keeps NULLs
NULL as Spark's ``concat`` does.
"""

from __future__ import annotations

from .. import catalog as C
from ..sources.segmenters import CELL_ROW_SHIFT, ORDINAL, PAIR_COL_SHIFT, SHEET_SHIFT

S = C.STRIP_CLASS
# The references that the bundled pages use:
# entity -> text; "&amp;" is decoded last so "&amp;lt;" stays "&lt;".
HTML_ENTITIES = [
    ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"),
    ("&amp;", "&"),
]

SHEET_MUL = 1 << SHEET_SHIFT
PAIR_SEQ = f"sheet_idx * {1 << SHEET_SHIFT} + col_no * {1 << PAIR_COL_SHIFT} + row_no"
CELL_SEQ = f"sheet_idx * {1 << SHEET_SHIFT} + row_no * {1 << CELL_ROW_SHIFT} + col_no"
ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NL = r"\r\n|\r|\n"


def place(*parts) -> str:
    """``segmenters.place_key`` as text."""
    out = ""
    for part in parts:
        value, base = part if isinstance(part, tuple) else (part, ORDINAL)
        out = f"({out} * {base} + {value})" if out else f"CAST({value} AS HUGEINT)"
    return f"CAST({out} AS VARCHAR)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{S}+|{S}+\\z', '', 'g')"


def cjk(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{C.CJK_CLASS}'), false)"


def qt(x: str) -> str:
    return f"('''' || {x} || '''')"


def cut(x: str, n: int) -> str:
    return f"substr({x}, 1, {n})"


def letters(c: str) -> str:
    n2 = f"CAST(floor(({c} - 1) / 26) AS BIGINT)"
    n3 = f"CAST(floor(({n2} - 1) / 26) AS BIGINT)"
    let = lambda n: f"substr('{ALPHA}', CAST((({n}) - 1) % 26 + 1 AS INTEGER), 1)"
    return (f"(CASE WHEN {n3} > 0 THEN {let(n3)} ELSE '' END || "
            f"CASE WHEN {n2} > 0 THEN {let(n2)} ELSE '' END || {let(c)})")


def a1(c: str, r: str) -> str:
    return f"({letters(c)} || CAST({r} AS VARCHAR))"


def lang_scores(x: str) -> str:
    return ", ".join(f"CAST(len(regexp_extract_all({x}, '{p}')) AS BIGINT) AS s_{lang.lower()}"
                     for lang, p in C.LANG_PATTERNS)


def lang_case(x: str) -> str:
    g = "greatest(" + ", ".join(f"s_{lang.lower()}" for lang, _ in C.LANG_PATTERNS) + ")"
    whens = " ".join(f"WHEN s_{lang.lower()} = {g} THEN '{lang}'" for lang, _ in C.LANG_PATTERNS)
    return f"CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN 'unknown' {whens} END"


def explode_lines(name: str, src: str, idc: str = "doc_id", text: str = "text",
                  pattern: str = NL, literal: bool = False, extra: str = "") -> str:
    split = (f"string_split({text}, chr(10))" if literal
             else f"regexp_split_to_array({text}, '{pattern}')")
    ex = f", {extra}" if extra else ""
    return (f"{name} AS (SELECT {idc} AS doc_id{ex}, CAST(i AS BIGINT) AS line_no, arr[i] AS raw, "
            f"{strip('arr[i]')} AS line FROM (SELECT {idc}{ex}, arr, unnest(range(1, len(arr) + 1)) AS i "
            f"FROM (SELECT {idc}{ex}, {split} AS arr FROM {src})))")


def seg_lines(name: str, lines: str) -> str:
    return (f"{name} AS (SELECT doc_id, line_no AS seq, 'Line ' || CAST(line_no AS VARCHAR) AS location, "
            f"line AS text, line_no FROM {lines} WHERE length(line) > 1)")


# --------------------------------------------------------------------------
# derived inputs
# --------------------------------------------------------------------------

_FX_SRC = """fx_src AS (
  SELECT 'part' AS workbook_id, CAST(CAST(substr(p_brand, 7) AS INTEGER) - 1 AS BIGINT) AS sheet_idx,
         p_brand AS sheet, CAST(p_partkey + 1 AS BIGINT) AS row_no, CAST(1 AS BIGINT) AS col_no,
         translate(p_name, 'aeiou', '一二三四五') AS value
  FROM part WHERE p_partkey % 19 <> 0
  UNION ALL
  SELECT 'part', CAST(CAST(substr(p_brand, 7) AS INTEGER) - 1 AS BIGINT), p_brand,
         CAST(p_partkey + 1 AS BIGINT), CAST(2 AS BIGINT), CAST(p_size AS VARCHAR)
  FROM part)"""

_TGT_SHEET = "CASE WHEN p_brand = 'Brand#2' THEN p_brand ELSE p_brand || '_EN' END"
_FX_TGT0 = f"""fx_tgt0 AS (
  SELECT 'part' AS workbook_id, {_TGT_SHEET} AS sheet, CAST(substr(p_brand, 7) AS INTEGER) AS ord,
         CAST(p_partkey + 1 AS BIGINT) AS row_no, CAST(1 AS BIGINT) AS col_no,
         CASE WHEN p_partkey % 13 = 0 THEN upper(p_name)
              WHEN p_partkey % 11 = 0 THEN translate(p_name, 'a', '一') ELSE p_name END AS value
  FROM part WHERE p_partkey % 17 <> 0 AND p_brand NOT IN ('Brand#1', 'Brand#9', 'Brand#25')
  UNION ALL
  SELECT 'part', {_TGT_SHEET}, CAST(substr(p_brand, 7) AS INTEGER), CAST(p_partkey + 1 AS BIGINT),
         CAST(2 AS BIGINT),
         CAST(CASE WHEN p_partkey % 23 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR)
  FROM part WHERE p_partkey % 31 <> 0 AND p_brand NOT IN ('Brand#1', 'Brand#9', 'Brand#25'))"""

_FX_TGT = """fx_tgt AS (
  SELECT c.workbook_id, c.sheet, s.sheet_idx, c.row_no, c.col_no, c.value
  FROM fx_tgt0 c JOIN (
    SELECT workbook_id, sheet,
           CAST(dense_rank() OVER (PARTITION BY workbook_id ORDER BY ord) - 1 AS BIGINT) AS sheet_idx
    FROM (SELECT DISTINCT workbook_id, sheet, ord FROM fx_tgt0)) s
  USING (workbook_id, sheet))"""

_SHEETS = """src_sheets AS (SELECT DISTINCT workbook_id, sheet, sheet_idx FROM fx_src),
tgt_sheets AS (SELECT DISTINCT workbook_id, sheet, sheet_idx FROM fx_tgt)"""

_PREFIX = ("(regexp_replace(t.sheet, '[_ENJAKODFRS]+\\z', '') = s.sheet "
           "OR starts_with(t.sheet, s.sheet))")
_SHEET_MAP = f"""cand AS (
  SELECT s.workbook_id, s.sheet, s.sheet_idx, t.sheet AS target_sheet, t.sheet_idx AS target_idx,
         CASE WHEN t.sheet = s.sheet THEN 1 WHEN {_PREFIX} THEN 2 ELSE 3 END AS stage_no
  FROM src_sheets s JOIN tgt_sheets t ON s.workbook_id = t.workbook_id
   AND (t.sheet = s.sheet OR {_PREFIX} OR t.sheet_idx = s.sheet_idx)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, sheet
                                                     ORDER BY stage_no, target_idx) AS rn FROM cand)
         WHERE rn = 1),
sheet_map AS (
  SELECT s.workbook_id, s.sheet, s.sheet_idx, b.target_sheet, b.target_idx,
         CASE b.stage_no WHEN 1 THEN 'exact' WHEN 2 THEN 'prefix' WHEN 3 THEN 'position' END AS stage
  FROM src_sheets s LEFT JOIN best b ON s.workbook_id = b.workbook_id AND s.sheet = b.sheet)"""

_CLASSIFY = f"""CASE WHEN source IS NOT NULL AND target IS NOT NULL AND {cjk('source')} THEN 'translated'
     WHEN source IS NOT NULL AND {cjk('source')} AND target IS NULL THEN 'missing'
     WHEN source IS NULL AND target IS NOT NULL THEN 'addition'
     WHEN source IS NOT NULL AND target IS NOT NULL AND source = target THEN 'unchanged'
     ELSE 'modified' END"""

_PAIRS = f"""src_cm AS (SELECT workbook_id, sheet, row_no, col_no, {strip('value')} AS source FROM fx_src
            WHERE value IS NOT NULL AND {strip('value')} <> ''),
tgt_cm AS (SELECT workbook_id, sheet, row_no, col_no, {strip('value')} AS target FROM fx_tgt
            WHERE value IS NOT NULL AND {strip('value')} <> ''),
mm AS (SELECT workbook_id, sheet, sheet_idx, target_sheet FROM sheet_map WHERE target_sheet IS NOT NULL),
s2 AS (SELECT c.workbook_id, c.sheet, m.sheet_idx, m.target_sheet, c.row_no, c.col_no, c.source
       FROM src_cm c JOIN mm m ON c.workbook_id = m.workbook_id AND c.sheet = m.sheet),
t2 AS (SELECT c.workbook_id, m.sheet, m.sheet_idx, m.target_sheet, c.row_no, c.col_no, c.target
       FROM tgt_cm c JOIN mm m ON c.workbook_id = m.workbook_id AND c.sheet = m.target_sheet),
pairs0 AS (
  SELECT coalesce(s2.workbook_id, t2.workbook_id) AS workbook_id, coalesce(s2.sheet, t2.sheet) AS sheet,
         coalesce(s2.sheet_idx, t2.sheet_idx) AS sheet_idx,
         coalesce(s2.target_sheet, t2.target_sheet) AS target_sheet,
         coalesce(s2.row_no, t2.row_no) AS row_no, coalesce(s2.col_no, t2.col_no) AS col_no,
         s2.source, t2.target
  FROM s2 FULL OUTER JOIN t2 ON s2.workbook_id = t2.workbook_id AND s2.sheet = t2.sheet
   AND s2.sheet_idx = t2.sheet_idx AND s2.target_sheet = t2.target_sheet
   AND s2.row_no = t2.row_no AND s2.col_no = t2.col_no),
pairs AS (
  SELECT workbook_id, sheet, sheet_idx, target_sheet, row_no, col_no, {a1('col_no', 'row_no')} AS coordinate,
         source, target, {PAIR_SEQ} AS pair_seq,
         {_CLASSIFY} AS match
  FROM pairs0)"""


def _fcols(doc_id, detector, dimension, severity, location, description, phase, seq, sub="0"):
    return (f"CAST({doc_id} AS VARCHAR) AS doc_id, '{detector}' AS detector, {dimension} AS dimension, "
            f"{severity} AS severity, {location} AS location, {description} AS description, "
            f"CAST({phase} AS BIGINT) AS phase, CAST({seq} AS BIGINT) AS seq, CAST({sub} AS BIGINT) AS sub")


_OMISSION = f"""f_omission AS (SELECT {_fcols('workbook_id', 'omission', "'漏译'", "'P1'",
                                            "sheet || '!' || coordinate",
                                            "'Source ' || " + qt(cut('source', 50)) + " || ' not translated'",
                                            0, 'pair_seq')}
  FROM pairs WHERE match = 'missing')"""
_ADDITION = f"""f_addition AS (SELECT {_fcols('workbook_id', 'addition', "'增译'", "'P2'",
                                            "sheet || '!' || coordinate",
                                            "'Added ' || " + qt(cut('target', 50)) + " || ' with no source'",
                                            0, 'pair_seq')}
  FROM pairs WHERE match = 'addition' AND length(target) > 3)"""
_MISSING_SHEET = f"""f_missing_sheet AS (SELECT {_fcols('workbook_id', 'missing_sheet', "'漏翻'", "'P1'",
                                                      "'Sheet: ' || sheet",
                                                      "'No matching sheet in target for ' || " + qt('sheet'),
                                                      0, f'sheet_idx * {SHEET_MUL}')}
  FROM sheet_map WHERE target_sheet IS NULL)"""


def list_repr(x: str) -> str:
    return f"(CASE WHEN len({x}) = 0 THEN '[]' ELSE '[''' || array_to_string({x}, ''', ''') || ''']' END)"


_CONSIST = f"""cjkp AS (SELECT * FROM pairs WHERE source IS NOT NULL AND {cjk('source')}),
dtrans AS (SELECT workbook_id, source, target, count(*) AS n, min(pair_seq) AS first_seq
           FROM cjkp GROUP BY workbook_id, source, target),
cstats AS (SELECT workbook_id, source, CAST(sum(n) AS BIGINT) AS occurrences,
                  CAST(count(target) AS BIGINT) AS n_translations,
                  coalesce(list_sort(list(target) FILTER (WHERE target IS NOT NULL)), []::VARCHAR[]) AS translations,
                  min(first_seq) AS first_seq
           FROM dtrans GROUP BY workbook_id, source),
ccoords AS (SELECT workbook_id, source, string_agg(coordinate, ', ' ORDER BY pair_seq) AS coordinates
            FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, source ORDER BY pair_seq) AS rn
                  FROM cjkp) WHERE rn <= 5 GROUP BY workbook_id, source),
f_consistency AS (
  SELECT {_fcols('s.workbook_id', 'consistency', "'一致性'",
                 "CASE WHEN n_translations > 2 THEN 'P1' ELSE 'P2' END", 'c.coordinates',
                 qt(cut('s.source', 30)) + " || ' translated ' || CAST(n_translations AS VARCHAR) || ' ways: ' || "
                 + list_repr('translations'), 1, 'first_seq')}
  FROM cstats s JOIN ccoords c ON s.workbook_id = c.workbook_id AND s.source = c.source
  WHERE n_translations > 1)"""

_BITEXT_FINDINGS = """f_bitext AS (SELECT * FROM f_missing_sheet UNION ALL SELECT * FROM f_omission
                UNION ALL SELECT * FROM f_addition UNION ALL SELECT * FROM f_consistency)"""

_SEG_CELLS_TGT = f"""seg_tgt AS (
  SELECT workbook_id AS doc_id, {CELL_SEQ} AS seq,
         sheet || '!' || {a1('col_no', 'row_no')} AS location, {strip('value')} AS text,
         sheet, sheet_idx, row_no, col_no
  FROM fx_tgt WHERE value IS NOT NULL AND {strip('value')} <> '')"""

_RESIDUAL = f"""f_residual AS (SELECT {_fcols('doc_id', 'residual', "'漏翻'", "'P1'", 'location',
                                            "'Untranslated Chinese: ' || " + qt(cut('text', 60)), 0, 'seq')}
  FROM seg_tgt WHERE {cjk('text')})"""

_SENSITIVE_DOCS = """fx_sensitive AS (
  SELECT doc_id, lang, (CASE doc_id % 10 WHEN 0 THEN 'Taiwan ' WHEN 1 THEN 'the taiwan strait and '
                      WHEN 2 THEN 'hack hacke Hacker cracker ' WHEN 3 THEN 'Security exploit '
                      WHEN 4 THEN 'illegal drug attack ' ELSE '' END) || text AS text
  FROM documents)"""


def _rule_hits(name: str, src: str, pack: str, text: str = "text", keys: str = "doc_id, seq") -> str:
    """Per-rule hit lists of ``src`` (one row per row and rule), then one row
    per hit: ``keys, text, rule_no, rule_id, severity, rule_desc, match_no, term``."""
    parts = []
    for i, (rid, body, sev, desc) in enumerate(C.RULE_PACKS[pack]):
        src_text = text
        pat = body
        if "(?!" in body:  # the taiwan rule: remove the excluded phrase first
            src_text = f"regexp_replace({text}, '(?i)\\bTaiwan\\s+Strait', ' ', 'g')"
            pat = r"\bTaiwan\b"
        parts.append(
            f"SELECT {keys}, {text} AS text, CAST({i} AS BIGINT) AS rule_no, '{rid}' AS rule_id, "
            f"'{sev}' AS severity, '{desc}' AS rule_desc, "
            f"regexp_extract_all({src_text}, '(?i){pat}') AS hits FROM {src}")
    lists = " UNION ALL ".join(parts)
    ex = ""
    for rid, word in C.RULE_EXEMPTIONS.get(pack, {}).items():
        ex += f" AND NOT (rule_id = '{rid}' AND contains(lower(text), '{word}'))"
    return (f"{name}_l AS ({lists}),\n{name} AS (SELECT {keys}, text, rule_no, rule_id, severity, rule_desc, "
            f"CAST(i - 1 AS BIGINT) AS match_no, hits[i] AS term FROM "
            f"(SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {name}_l) WHERE true{ex})")


def _sensitive_findings(name: str, hits: str, cells: bool = False) -> str:
    if cells:
        desc = ("rule_desc || ': ' || " + qt("term") + " || ' in ' || " + qt(cut("text", 60)))
        return (f"{name} AS (SELECT {_fcols('workbook_id', 'sensitive', "'敏感词'", 'severity', "sheet || '!' || coordinate", desc, 0, 'cell_seq', '(rule_no + 1) * 1000000000 + match_no')} FROM {hits})")
    desc = "rule_desc || ': ' || " + qt("term")
    return (f"{name} AS (SELECT {_fcols('doc_id', 'sensitive', "'敏感词'", 'severity', 'location', desc, 0, 'seq', '(rule_no + 1) * 1000000000 + match_no')} FROM {hits})")


_SENS_SEGS = seg_lines("sens_segs", "sens_lines")

CTES: dict[str, tuple[str, list[str]]] = {
    "fx_src": (_FX_SRC, []),
    "fx_tgt0": (_FX_TGT0, []),
    "fx_tgt": (_FX_TGT, ["fx_tgt0"]),
    "sheets": (_SHEETS, ["fx_src", "fx_tgt"]),
    "sheet_map": (_SHEET_MAP, ["sheets"]),
    "pairs": (_PAIRS, ["sheet_map"]),
    "f_omission": (_OMISSION, ["pairs"]),
    "f_addition": (_ADDITION, ["pairs"]),
    "f_missing_sheet": (_MISSING_SHEET, ["sheet_map"]),
    "consistency": (_CONSIST, ["pairs"]),
    "f_bitext": (_BITEXT_FINDINGS, ["f_missing_sheet", "f_omission", "f_addition", "consistency"]),
    "seg_tgt": (_SEG_CELLS_TGT, ["fx_tgt"]),
    "f_residual": (_RESIDUAL, ["seg_tgt"]),
    "doc_lines": (explode_lines("doc_lines", "documents"), []),
    "fx_lines": (seg_lines("fx_lines", "doc_lines"), ["doc_lines"]),
    "fx_sensitive": (_SENSITIVE_DOCS, []),
    "sens_lines": (explode_lines("sens_lines", "fx_sensitive"), ["fx_sensitive"]),
    "sens_segs": (_SENS_SEGS, ["sens_lines"]),
    "sens_hits7": (_rule_hits("sens_hits7", "sens_segs", "extended7",
                              keys="doc_id, seq, location"), ["sens_segs"]),
    "sens_hits5": (_rule_hits("sens_hits5", "sens_segs", "basic5",
                              keys="doc_id, seq, location"), ["sens_segs"]),
    "f_sensitive7": (_sensitive_findings("f_sensitive7", "sens_hits7"), ["sens_hits7"]),
    "f_sensitive5": (_sensitive_findings("f_sensitive5", "sens_hits5"), ["sens_hits5"]),
    "f_report": ("""f_report AS (SELECT *, CAST(0 AS BIGINT) AS stream FROM f_bitext
                UNION ALL SELECT *, CAST(1 AS BIGINT) FROM f_residual
                UNION ALL SELECT *, CAST(2 AS BIGINT) FROM f_sensitive7)""",
                 ["f_bitext", "f_residual", "f_sensitive7"]),
}


def _add(name: str, text: str, deps: list[str] | None = None) -> None:
    CTES[name] = (text, deps or [])


def sql(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(CTES[n][0] for n in order) + "\n" + body


# more derived inputs --------------------------------------------------------

_add("fx_markdown", """fx_markdown AS (
  SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN '# Title' || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || text
    WHEN 1 THEN '```py' || chr(10) || text ELSE text END AS text FROM documents)""")
_add("md_lines", explode_lines("md_lines", "fx_markdown"), ["fx_markdown"])
_add("md_parity", """md_parity AS (
  SELECT doc_id, line_no, line, starts_with(line, '```') AS is_fence,
         coalesce(sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (
           PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM md_lines)""", ["md_lines"])
_add("fx_routed", """fx_routed AS (
  SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS doc_id,
         '/corpus/doc' || CAST(doc_id AS VARCHAR) || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT'
           WHEN 2 THEN '.markdown' WHEN 3 THEN '.csv' ELSE '' END AS path, text
  FROM fx_markdown
  UNION ALL
  SELECT 'page-' || CAST(page_id AS VARCHAR), '/corpus/page' || CAST(page_id AS VARCHAR) || '.HTM', html
  FROM pages)""", ["fx_markdown"])

SUFFIX = "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1))"
PARSER = ("CASE suffix " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SUFFIX_PARSERS.items())
          + f" ELSE '{C.DEFAULT_PARSER}' END")
_add("routed", f"""routed AS (SELECT doc_id, path, suffix, substr(suffix, 2) AS format, {PARSER} AS parser
  FROM (SELECT *, {SUFFIX} AS suffix FROM fx_routed))""", ["fx_routed"])


def _html_patterns():
    skip = "(?is)" + "|".join([f"<{t}(\\s[^>]*)?>.*?</{t}\\s*>" for t in C.HTML_SKIP_TAGS] + ["<!--.*?-->"])
    opn = "(?i)<(" + "|".join(C.HTML_TEXT_TAGS) + ")(\\s[^>]*)?>"
    bnd = "(?i)</?(" + "|".join(C.HTML_BLOCK_TAGS) + ")(\\s[^>]*)?/?>"
    inline = f"{S}*<[^>]*>{S}*"
    return skip, opn, bnd, inline


def decode(x: str) -> str:
    out = x
    for ent, ch in HTML_ENTITIES:
        if ent == "&nbsp;":
            continue
        out = f"replace({out}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return out


def html_text(x: str) -> str:
    _, _, _, inline = _html_patterns()
    return strip(decode(f"regexp_replace(replace({x}, '&nbsp;', chr(160)), '{inline}', '', 'g')"))


def loc_html(tag: str, text: str) -> str:
    return (f"('<' || {tag} || '> \"' || CASE WHEN length({text}) > 40 THEN {cut(text, 40)} || '...' "
            f"ELSE {text} END || '\"')")


def _html_cte(name: str, src: str, idc: str, col: str) -> str:
    skip, opn, bnd, _ = _html_patterns()
    h = (f"regexp_replace(regexp_replace(regexp_replace({col}, '{skip}', '<>', 'g'), '{opn}', "
         f"chr(1) || '\\1' || chr(2), 'g'), '{bnd}', chr(1), 'g')")
    return f"""{name}_p AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, arr[i] AS piece
  FROM (SELECT doc_id, arr, unnest(range(1, len(arr) + 1)) AS i
        FROM (SELECT {idc} AS doc_id, string_split({h}, chr(1)) AS arr FROM {src}))),
{name}_b AS (
  SELECT doc_id, pos, lower(split_part(piece, chr(2), 1)) AS tag,
         {html_text("substr(piece, strpos(piece, chr(2)) + 1)")} AS text
  FROM {name}_p WHERE strpos(piece, chr(2)) > 0),
{name} AS (SELECT doc_id, pos AS seq, {loc_html('tag', 'text')} AS location, text, tag
           FROM {name}_b WHERE length(text) > 1)"""


_add("html_segs", _html_cte("html_segs", "pages", "page_id", "html"))

_add("fx_conv_cells", """fx_conv_cells AS (
  SELECT 'conversations' AS workbook_id, c.role AS sheet, r.sheet_idx, CAST(conv_id + 1 AS BIGINT) AS row_no,
         CAST(turn + 1 AS BIGINT) AS col_no, text AS value
  FROM conversations c JOIN (SELECT role, CAST(dense_rank() OVER (ORDER BY role) - 1 AS BIGINT) AS sheet_idx
                             FROM (SELECT DISTINCT role FROM conversations)) r ON c.role = r.role)""")


def scan_cte(name: str, cells: str) -> str:
    v = strip("value")
    return f"""{name} AS (
  SELECT workbook_id, sheet, sheet_idx, row_no, col_no, coordinate, cell_seq, value,
         {lang_case('value')} AS lang, has_cjk, char_count
  FROM (SELECT workbook_id, sheet, sheet_idx, row_no, col_no, {a1('col_no', 'row_no')} AS coordinate,
               {CELL_SEQ} AS cell_seq, sv AS value,
               {cjk('sv')} AS has_cjk, CAST(length(sv) AS BIGINT) AS char_count, {lang_scores('sv')}
        FROM (SELECT *, {v} AS sv FROM {cells} WHERE value IS NOT NULL AND {v} <> '')) t)"""


_add("conv_scan", scan_cte("conv_scan", "fx_conv_cells"), ["fx_conv_cells"])
_add("tgt_scan", scan_cte("tgt_scan", "fx_tgt"), ["fx_tgt"])
_add("sens_cells", """sens_cells AS (
  SELECT 'doc' || CAST(doc_id AS VARCHAR) AS workbook_id, 'Sheet1' AS sheet,
         CAST(0 AS BIGINT) AS sheet_idx, line_no AS row_no, CAST(1 AS BIGINT) AS col_no, raw AS value
  FROM sens_lines)""", ["sens_lines"])
_add("sens_scan", scan_cte("sens_scan", "sens_cells"), ["sens_cells"])
_add("sens_scan_hits", _rule_hits("sens_scan_hits", "sens_scan", "extended7", text="value",
                                  keys="workbook_id, sheet, coordinate, cell_seq"), ["sens_scan"])

_add("doc_lines_raw_paras", """fx_paragraphs AS (
  SELECT doc_id, line_no AS para_no,
         CASE WHEN line_no = 1 THEN 'Title' WHEN line_no % 5 = 0 THEN 'Heading 2'
              WHEN line_no % 7 = 0 THEN NULL ELSE 'Normal' END AS style, raw AS text
  FROM doc_lines)""", ["doc_lines"])
_add("fx_part_tables", """fx_part_tables AS (
  SELECT CAST(CAST(substr(p_brand, 7) AS INTEGER) AS BIGINT) AS doc_id, CAST(1 AS BIGINT) AS table_no,
         CAST(p_partkey + 1 AS BIGINT) AS row_no, CAST(c AS BIGINT) AS col_no, v AS text
  FROM (SELECT p_brand, p_partkey, 1 AS c, p_name AS v FROM part
        UNION ALL SELECT p_brand, p_partkey, 2, p_type FROM part
        UNION ALL SELECT p_brand, p_partkey, 3, CAST(p_size AS VARCHAR) FROM part))""")
_add("fx_slides", """fx_slides AS (
  SELECT conv_id AS doc_id, CAST(turn + 1 AS BIGINT) AS slide_no, CAST(1 AS BIGINT) AS shape_no,
         CAST(i AS BIGINT) AS para_no, arr[i] AS text
  FROM (SELECT conv_id, turn, arr, unnest(range(1, len(arr) + 1)) AS i
        FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS arr FROM conversations)))""")
_add("fx_slide_tables", """fx_slide_tables AS (
  SELECT conv_id AS doc_id, CAST(1 AS BIGINT) AS slide_no, CAST(2 AS BIGINT) AS shape_no,
         CAST(turn + 1 AS BIGINT) AS row_no, CAST(1 AS BIGINT) AS col_no, role AS text FROM conversations
  UNION ALL
  SELECT conv_id, CAST(1 AS BIGINT), CAST(2 AS BIGINT), CAST(turn + 1 AS BIGINT), CAST(2 AS BIGINT), text
  FROM conversations)""")
_add("fx_page_tables", """fx_page_tables AS (
  SELECT t.doc_id, CAST(p.p_size AS BIGINT) AS page_no, t.table_no, t.row_no, t.col_no, t.text
  FROM fx_part_tables t JOIN part p ON t.row_no = CAST(p.p_partkey + 1 AS BIGINT))""", ["fx_part_tables"])

_add("compare", """roles AS (
  SELECT CAST(floor(doc_id / 2) AS BIGINT) AS pair_id, CASE WHEN doc_id % 2 = 1 THEN 'source' ELSE 'target' END AS role,
         'doc-' || CAST(doc_id AS VARCHAR) AS doc_id FROM documents
  UNION ALL SELECT -1, 'source', 'doc-0' FROM documents WHERE doc_id = 0
  UNION ALL SELECT -1, 'target', 'doc-lost' FROM documents WHERE doc_id = 0),
per_doc AS (
  SELECT 'doc-' || CAST(d.doc_id AS VARCHAR) AS doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'txt' ELSE 'csv' END AS format,
         coalesce(s.n, 0) AS n_seg, CASE WHEN d.doc_id % 2 = 1 THEN 0 ELSE coalesce(f.n, 0) END AS n_find
  FROM fx_sensitive d LEFT JOIN (SELECT doc_id, count(*) AS n FROM sens_segs GROUP BY doc_id) s ON d.doc_id = s.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM sens_hits5 GROUP BY doc_id) f ON d.doc_id = f.doc_id),
sides AS (SELECT r.pair_id, r.role, r.doc_id, p.format, p.n_seg, p.n_find, p.doc_id IS NOT NULL AS ok
          FROM roles r LEFT JOIN per_doc p ON r.doc_id = p.doc_id),
cmp AS (
  SELECT p.pair_id, s.doc_id AS source_doc, t.doc_id AS target_doc, coalesce(s.ok, false) AS source_ok,
         coalesce(t.ok, false) AS target_ok, coalesce(s.format, 'unknown') AS source_format,
         coalesce(t.format, 'unknown') AS target_format, CAST(coalesce(s.n_seg, 0) AS BIGINT) AS source_count,
         CAST(coalesce(t.n_seg, 0) AS BIGINT) AS target_count, CAST(coalesce(t.n_find, 0) AS BIGINT) AS automated_count
  FROM (SELECT DISTINCT pair_id FROM roles) p
  LEFT JOIN (SELECT * FROM sides WHERE role = 'source') s ON p.pair_id = s.pair_id
  LEFT JOIN (SELECT * FROM sides WHERE role = 'target') t ON p.pair_id = t.pair_id)""", ["fx_sensitive", "sens_segs", "sens_hits5"])
_add("cmp_ratio", """cmp_ratio AS (
  SELECT *, CASE WHEN ratio > 1.5 THEN 'larger' WHEN ratio < 0.5 THEN 'smaller' END AS size_flag
  FROM (SELECT *, CASE WHEN source_ok AND target_ok THEN CAST(target_count AS DOUBLE)
                       / CAST(greatest(source_count, 1) AS DOUBLE) END AS ratio FROM cmp))""", ["compare"])

_add("fx_register", """fx_register AS (
  SELECT doc_id, lang, CASE doc_id % 6 WHEN 0 THEN 'Sie ' || text || ' du.'
    WHEN 1 THEN 'Vous ' || text || ' tu.' WHEN 2 THEN 'usted ' || text || ' Tú.'
    WHEN 3 THEN 'Sie ' || text ELSE text END AS text FROM documents)""")
_add("fx_jako", """fx_jako AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, '.', 'です。')
    WHEN 1 THEN replace(text, '.', 'ます。') || 'そうだ。'
    WHEN 2 THEN replace(text, '.', '습니다.')
    ELSE replace(text, '.', '해요.') || '합니다.' END AS text FROM documents)""")
_add("fw_docs", """fw_docs AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, ', ', '，')
                                         ELSE text END AS text FROM documents)""")
_add("fw_lines", explode_lines("fw_lines", "fw_docs"), ["fw_docs"])
_add("fw_segs", seg_lines("fw_segs", "fw_lines"), ["fw_lines"])
_add("fx_glossary", """fx_glossary AS (
  SELECT DISTINCT translate(w, 'aeiou', '一二三四五') AS term, w AS approved
  FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> '')""")
_add("manual", """manual AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'manual' AS detector, '敏感词' AS dimension, 'P0' AS severity,
         'Document ' || CAST(doc_id AS VARCHAR) AS location, 'Reader: toxic content' AS description,
         CAST(0 AS BIGINT) AS phase, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS sub
  FROM labels WHERE toxic = 1
  UNION ALL
  SELECT CAST(doc_id AS VARCHAR), 'manual', '地道性', NULL, 'Document ' || CAST(doc_id AS VARCHAR),
         'Reader: low quality', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT)
  FROM labels WHERE quality = 0 AND toxic <> 1)""")


# --------------------------------------------------------------------------
# summary helpers
# --------------------------------------------------------------------------

def summary_sql(findings: str, dims: list[str]) -> str:
    vals = ", ".join(f"({i}, '{d}')" for i, d in enumerate(dims))
    sev_cols = ", ".join(
        f"CAST(count(*) FILTER (WHERE f.severity = '{s}') AS BIGINT) AS {s}" for s in C.SEVERITY_NAMES)
    sevs = ", ".join(f"'{s}'" for s in C.SEVERITY_NAMES)
    return f"""dims(dim_ord, dimension) AS (VALUES {vals}),
fd AS (SELECT coalesce(dimension, '') AS dimension, coalesce(severity, 'P3') AS severity FROM {findings}),
per_dim AS (
  SELECT CAST(d.dim_ord AS BIGINT) AS dim_ord, d.dimension, {sev_cols}
  FROM dims d LEFT JOIN (SELECT * FROM fd WHERE severity IN ({sevs})) f ON d.dimension = f.dimension
  GROUP BY d.dim_ord, d.dimension),
summary AS (
  SELECT dim_ord, dimension, P0, P1, P2, P3, P0 + P1 + P2 + P3 AS total FROM per_dim
  UNION ALL
  SELECT CAST({len(dims)} AS BIGINT), '{C.GRAND_TOTAL_LABEL}', CAST(sum(P0) AS BIGINT), CAST(sum(P1) AS BIGINT),
         CAST(sum(P2) AS BIGINT), CAST(sum(P3) AS BIGINT), CAST(sum(P0 + P1 + P2 + P3) AS BIGINT) FROM per_dim)"""


def _summary(findings_cte: str, dims: list[str], name: str) -> None:
    _add(name, summary_sql(findings_cte, dims), [findings_cte])


_summary("f_report", C.DIMENSIONS_CORE10, "summary_core10")
_summary("f_report", C.DIMENSIONS_ALL12, "summary_all12")
_add("f_report_manual", """f_report_manual AS (SELECT doc_id, detector, dimension, severity, location,
   description, phase, seq, sub FROM f_report UNION ALL SELECT * FROM manual)""", ["f_report", "manual"])
_summary("f_report_manual", C.DIMENSIONS_CORE10, "summary_manual")

FIND = "doc_id, detector, dimension, severity, location, description, phase, seq, sub"
SEV_TABLE = ("severities(severity, fill_rgb) AS (VALUES "
             + ", ".join(f"('{s}', '{f}')" for s, _, f in C.SEVERITIES) + ")")
_add("severities", SEV_TABLE)
SEG = "doc_id, seq, location, text"


def _register():
    ps = []
    for lang, formal, informal in C.REGISTER_FORMS:
        nw = "[^\\p{L}\\p{N}_]"
        fp = (f"(^|{nw}){formal}({nw}|$)" if formal == "Sie" else f"(?i)(^|{nw}){formal}({nw}|$)")
        ip = f"(?i)(^|{nw}){informal}({nw}|$)"
        ps.append((lang, formal, informal, fp, ip))
    return ps


def _ends(forms):
    return "(" + "|".join(forms) + ")$"


END = C.SENTENCE_END_CLASS
ENDS = f"regexp_extract_all(text, '([^{END[1:-1]}]{{1,4}}){END}', 1)"


def _count_ends(pred: str) -> str:
    return f"CAST(len(list_filter({ENDS}, lambda e: {pred})) AS BIGINT)"


JA_POL = f"regexp_matches(e, '{_ends(C.JA_POLITE_ENDINGS)}')"
JA_PLAIN = f"regexp_matches(e, '{_ends(C.JA_PLAIN_ENDINGS)}') AND NOT {JA_POL}"
KO_FOR = f"regexp_matches(e, '{_ends(C.KO_FORMAL_ENDINGS)}')"
KO_POL = f"regexp_matches(e, '{_ends(C.KO_POLITE_ENDINGS)}')"
_add("jako_counts", f"""jako_counts AS (
  SELECT doc_id, {_count_ends(JA_POL)} AS ja_polite, {_count_ends(JA_PLAIN)} AS ja_plain,
         {_count_ends(KO_FOR)} AS ko_formal, {_count_ends(KO_POL)} AS ko_polite FROM fx_jako)""",
     ["fx_jako"])

# --------------------------------------------------------------------------
# the oracle queries
# --------------------------------------------------------------------------

ORACLE: dict[str, str] = {}


def o(name: str, body: str, *ctes: str) -> None:
    ORACLE[name] = sql(body, *ctes)


# 2.1
o("load_documents", "SELECT doc_id, text, 'documents.parquet' AS file_name FROM documents")
o("route_format", "SELECT doc_id, path, suffix, format, parser FROM routed", "routed")
_add("md_segs", """md_segs AS (SELECT doc_id, line_no AS seq, 'Line ' || CAST(line_no AS VARCHAR) AS location,
   line AS text, line_no FROM md_parity WHERE NOT is_fence AND before % 2 = 0 AND NOT starts_with(line, '#')
   AND length(line) > 1)""", ["md_parity"])
_add("routed_docs", "routed_docs AS (SELECT r.doc_id, r.format, r.parser, f.text FROM routed r "
     "JOIN fx_routed f ON r.doc_id = f.doc_id)", ["routed"])
_add("r_txt_lines", explode_lines("r_txt_lines", "(SELECT * FROM routed_docs WHERE parser = 'txt')",
                                  extra="format"), ["routed_docs"])
_add("r_md_lines", explode_lines("r_md_lines", "(SELECT * FROM routed_docs WHERE parser = 'md')",
                                 extra="format"), ["routed_docs"])
_add("r_md_parity", """r_md_parity AS (
  SELECT *, starts_with(line, '```') AS is_fence,
         coalesce(sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (
           PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r_md_lines)""", ["r_md_lines"])
_add("r_html", _html_cte("r_html", "(SELECT * FROM routed_docs WHERE parser = 'html')", "doc_id", "text"),
     ["routed_docs"])
o("segment_routed", """SELECT doc_id, format, 'txt' AS parser, line_no AS seq, 'Line ' || CAST(line_no AS VARCHAR) AS location, line AS text FROM r_txt_lines WHERE length(line) > 1
UNION ALL SELECT doc_id, format, 'md', line_no, 'Line ' || CAST(line_no AS VARCHAR), line FROM r_md_parity
  WHERE NOT is_fence AND before % 2 = 0 AND NOT starts_with(line, '#') AND length(line) > 1
UNION ALL SELECT h.doc_id, r.format, 'html', h.seq, h.location, h.text FROM r_html h JOIN routed r ON h.doc_id = r.doc_id""",
  "r_txt_lines", "r_md_parity", "r_html", "routed")
o("segment_lines", "SELECT * FROM fx_lines", "fx_lines")
o("segment_markdown", "SELECT * FROM md_segs", "md_segs")
o("segment_html", "SELECT * FROM html_segs", "html_segs")
# the nested front of each page, said outright: an element's text is that of its whole subtree, node by node;
# the page's own blocks follow, 14 block tags further
_add("nested_front", """nested_front AS (
  SELECT page_id AS doc_id, CAST(x.seq AS BIGINT) AS seq, x.tag AS tag, x.text AS text FROM (
    SELECT page_id, unnest([
      {'seq': 2, 'tag': 'li', 'text': 'Item ' || page_id || ' é中文 a < b' || 'inner' || url || 'tail'},
      {'seq': 5, 'tag': 'li', 'text': 'next &lt; &unknown; <x>'},
      {'seq': 9, 'tag': 'td', 'text': 'Cell' || 'para ’x’ ' || page_id || 'end'},
      {'seq': 10, 'tag': 'p', 'text': 'para ’x’ ' || page_id}]) AS x FROM pages))""")
o("segment_html_nested", f"""SELECT doc_id, seq, {loc_html('tag', 'text')} AS location, text, tag FROM nested_front
  UNION ALL SELECT doc_id, seq + 14, location, text, tag FROM html_segs""", "nested_front", "html_segs")
o("unsegmented", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'docx' ELSE 'pdf' END AS format,
  CASE WHEN doc_id % 3 = 0 THEN 'docx' ELSE 'pdf' END AS parser FROM documents WHERE doc_id % 3 <> 2""")
o("segment_cells", "SELECT * FROM seg_tgt", "seg_tgt")
o("cell_map", f"SELECT workbook_id, sheet, sheet_idx, row_no, col_no, {strip('value')} AS value FROM fx_src "
  f"WHERE value IS NOT NULL AND {strip('value')} <> ''", "fx_src")
o("scan_cells", "SELECT * FROM conv_scan", "conv_scan")
o("segment_paragraphs", f"""SELECT doc_id, para_no AS seq, 'Paragraph ' || CAST(para_no AS VARCHAR) ||
  CASE WHEN style IS NULL OR style = 'Normal' THEN '' ELSE ' [' || style || ']' END AS location, t AS text
  FROM (SELECT *, {strip('text')} AS t FROM fx_paragraphs) WHERE t IS NOT NULL AND length(t) > 0""",
  "doc_lines_raw_paras")
o("segment_doc_tables", f"""SELECT doc_id, {place('1', 'table_no', 'row_no', 'col_no')} AS seq,
  'Table ' || CAST(table_no AS VARCHAR) || ', Row ' || CAST(row_no AS VARCHAR) || ', Col ' || CAST(col_no AS VARCHAR) AS location,
  t AS text FROM (SELECT *, {strip('text')} AS t FROM fx_part_tables) WHERE t IS NOT NULL AND length(t) > 0""",
  "fx_part_tables")
o("segment_slides", f"""SELECT doc_id, {place('slide_no', 'shape_no', ('0', 2), 'para_no', '0')} AS seq,
  'Slide ' || CAST(slide_no AS VARCHAR) || ', Paragraph ' || CAST(para_no AS VARCHAR) AS location, t AS text, shape_no
  FROM (SELECT *, {strip('text')} AS t FROM fx_slides) WHERE t IS NOT NULL AND length(t) > 0""", "fx_slides")
o("segment_slide_tables", f"""SELECT doc_id, {place('slide_no', 'shape_no', ('1', 2), 'row_no', 'col_no')} AS seq,
  'Slide ' || CAST(slide_no AS VARCHAR) || ', Table Row ' || CAST(row_no AS VARCHAR) || ', Col ' || CAST(col_no AS VARCHAR) AS location,
  t AS text, shape_no FROM (SELECT *, {strip('text')} AS t FROM fx_slide_tables) WHERE t IS NOT NULL AND length(t) > 0""",
  "fx_slide_tables")
o("segment_page_lines", f"""SELECT doc_id, {place('page_no', ('0', 2), '(i - 1)', '0', '0')} AS seq,
  'Page ' || CAST(page_no AS VARCHAR) || ', Line ' || CAST(i AS VARCHAR) AS location, t AS text
  FROM (SELECT *, {strip('arr[i]')} AS t FROM (SELECT doc_id, page_no, arr, unnest(range(1, len(arr) + 1)) AS i
        FROM (SELECT conv_id AS doc_id, CAST(turn + 1 AS BIGINT) AS page_no, string_split(text, chr(10)) AS arr
              FROM conversations))) WHERE length(t) > 1""")
o("segment_page_tables", f"""SELECT doc_id, {place('page_no', ('1', 2), 'table_no', 'row_no', 'col_no')} AS seq,
  'Page ' || CAST(page_no AS VARCHAR) || ', Table Row ' || CAST(row_no AS VARCHAR) || ', Col ' || CAST(col_no AS VARCHAR) AS location,
  t AS text FROM (SELECT *, {strip('text')} AS t FROM fx_page_tables) WHERE t IS NOT NULL AND length(t) > 0""",
  "fx_page_tables")
o("write_review", f"SELECT {FIND} FROM f_bitext", "f_bitext")
o("read_findings", "SELECT dimension, severity, location, description FROM f_bitext", "f_bitext")
o("report_detail", """SELECT CAST(row_number() OVER (ORDER BY stream, doc_id, phase, seq, sub) AS BIGINT) AS n,
  coalesce(location, '') AS location, coalesce(description, '') AS description,
  coalesce(f.severity, 'P3') AS severity, coalesce(dimension, '') AS dimension, s.fill_rgb
  FROM f_report f LEFT JOIN severities s ON coalesce(f.severity, 'P3') = s.severity""", "f_report", "severities")

o("run_status", f"""SELECT 'success' AS status, count(*) AS findings_count,
  '{C.DETAIL_SHEET},{C.SUMMARY_SHEET}' AS sheets FROM f_report""", "f_report")

# 2.2
o("has_cjk", f"SELECT workbook_id, sheet, row_no, col_no, value, {cjk('value')} AS has_cjk FROM fx_tgt", "fx_tgt")
o("residual_findings", "SELECT * FROM f_residual", "f_residual")
o("residual_findings_cells", f"""SELECT {_fcols('workbook_id', 'residual', "'漏翻'", "'P1'", "sheet || '!' || coordinate",
  "'Cell contains untranslated Chinese: ' || " + qt(cut('value', 60)), 0, 'cell_seq')} FROM tgt_scan WHERE has_cjk""",
  "tgt_scan")
o("sensitive_matches", "SELECT doc_id, seq, rule_no, rule_id, match_no, term, severity FROM sens_hits7", "sens_hits7")
_sec = [r for r in C.RULES_EXTENDED7 if r[0] == "security"][0]
o("sensitive_exempt", f"""SELECT doc_id, seq, CAST(i - 1 AS BIGINT) AS match_no, hits[i] AS term FROM (
  SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, seq, text, regexp_extract_all(text, '(?i){_sec[1]}') AS hits FROM sens_segs))
  WHERE contains(lower(text), 'security')""", "sens_segs")
o("sensitive_findings", "SELECT * FROM f_sensitive5", "f_sensitive5")
_add("f_sens_cells", _sensitive_findings("f_sens_cells", "sens_scan_hits", cells=True), ["sens_scan_hits"])
o("sensitive_findings_cells", "SELECT * FROM f_sens_cells", "f_sens_cells")
o("nonblank_filter", f"""SELECT doc_id, slide_no, para_no, t AS text FROM (SELECT *, {strip('text')} AS t FROM fx_slides)
  WHERE t IS NOT NULL AND length(t) > 1""", "fx_slides")
o("source_gate", "SELECT * FROM (SELECT * FROM f_sensitive5 UNION ALL "
  f"SELECT {_fcols('doc_id', 'residual', chr(39) + '漏翻' + chr(39), chr(39) + 'P1' + chr(39), 'location', chr(39) + 'Untranslated Chinese: ' + chr(39) + ' || ' + qt(cut('text', 60)), 0, 'seq')} "
  f"FROM sens_segs WHERE {cjk('text')}) WHERE CAST(doc_id AS BIGINT) % 2 = 0", "f_sensitive5", "sens_segs")
o("document_findings", "SELECT * FROM f_sensitive5 UNION ALL "
  f"SELECT {_fcols('doc_id', 'residual', chr(39) + '漏翻' + chr(39), chr(39) + 'P1' + chr(39), 'location', chr(39) + 'Untranslated Chinese: ' + chr(39) + ' || ' + qt(cut('text', 60)), 0, 'seq')} "
  f"FROM sens_segs WHERE {cjk('text')}", "f_sensitive5", "sens_segs")
o("dedup_findings", "SELECT * FROM f_sensitive7 UNION ALL "
  f"SELECT {_fcols('doc_id', 'residual', chr(39) + '漏翻' + chr(39), chr(39) + 'P1' + chr(39), 'location', chr(39) + 'Untranslated Chinese: ' + chr(39) + ' || ' + qt(cut('text', 60)), 0, 'seq')} "
  f"FROM sens_segs WHERE {cjk('text')}", "f_sensitive7", "sens_segs")
o("omission_findings", "SELECT * FROM f_omission", "f_omission")
o("addition_findings", "SELECT * FROM f_addition", "f_addition")
o("missing_sheet_findings", "SELECT * FROM f_missing_sheet", "f_missing_sheet")

# 2.3
o("match_sheets", "SELECT * FROM sheet_map", "sheet_map")
o("align_cells", """SELECT workbook_id, sheet, sheet_idx, target_sheet, row_no, col_no, coordinate, source, target,
  pair_seq, match FROM pairs""", "pairs")
o("classify_pairs", "SELECT workbook_id, sheet, coordinate, match FROM pairs", "pairs")
o("compare_sections", "SELECT * FROM cmp", "compare")
o("missing_sheets", "SELECT workbook_id, sheet, sheet_idx FROM sheet_map WHERE target_sheet IS NULL", "sheet_map")

# 2.4
o("match_stats", """SELECT workbook_id, sheet, match, count(*) AS n FROM pairs GROUP BY workbook_id, sheet, match
  UNION ALL SELECT workbook_id, NULL, match, count(*) FROM pairs GROUP BY workbook_id, match""", "pairs")
o("consistency_issues", """SELECT workbook_id, source, occurrences, n_translations,
  array_to_string(translations, ' | ') AS translations, first_seq FROM cstats WHERE n_translations > 1""",
  "consistency")
o("consistency_findings", "SELECT * FROM f_consistency", "consistency")
_add("workbooks", """workbooks AS (SELECT 'part' AS workbook_id UNION ALL SELECT 'empty-' || r_name FROM region)""")
o("consistency_totals", """SELECT w.workbook_id, count(s.source) AS total_unique,
  count(*) FILTER (WHERE s.n_translations > 1) AS issues
  FROM workbooks w LEFT JOIN cstats s ON w.workbook_id = s.workbook_id GROUP BY w.workbook_id""", "workbooks", "consistency")
o("issue_translations", """SELECT d.workbook_id, d.source, d.target, d.n, d.first_seq FROM dtrans d JOIN cstats s
  ON d.workbook_id = s.workbook_id AND d.source = s.source WHERE s.n_translations > 1 AND d.target IS NOT NULL""", "consistency")
o("issue_occurrences", """SELECT p.workbook_id, p.source, p.sheet, p.coordinate, p.target, p.pair_seq FROM cjkp p JOIN cstats s
  ON p.workbook_id = s.workbook_id AND p.source = s.source WHERE s.n_translations > 1""", "consistency")
o("review_texts", """SELECT doc_id, text, string_agg(location, '; ' ORDER BY seq) FILTER (WHERE rn <= 3) AS locations,
  count(*) AS occurrence_count, min(seq) AS first_seq
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY seq) AS rn FROM fx_lines)
  GROUP BY doc_id, text""", "fx_lines")
o("review_texts_cells", """SELECT doc_id, text, string_agg(location, '; ' ORDER BY seq) FILTER (WHERE rn <= 3) AS locations,
  count(*) AS occurrence_count, min(seq) AS first_seq
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY seq) AS rn FROM seg_tgt)
  GROUP BY doc_id, text""", "seg_tgt")
o("first_locations_cells", """SELECT doc_id, text, seq, location, rn FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, text ORDER BY seq) AS BIGINT) AS rn FROM seg_tgt)
  WHERE rn <= 3""", "seg_tgt")
_add("corpus_texts", """corpus_texts AS (
  SELECT text, string_agg(CAST(doc_id AS VARCHAR) || ':' || location, '; ' ORDER BY doc_id, seq)
           FILTER (WHERE rn <= 3) AS locations,
         count(*) AS occurrence_count, max(doc_id) FILTER (WHERE rn = 1) AS first_doc,
         max(seq) FILTER (WHERE rn = 1) AS first_seq
  FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, seq) AS rn FROM fx_lines)
  GROUP BY text)""", ["fx_lines"])
o("review_texts_corpus", "SELECT * FROM corpus_texts", "corpus_texts")
o("segment_totals_sensitive", """SELECT d.doc_id, coalesce(s.total_sections, 0) AS total_sections,
  coalesce(s.unique_texts, 0) AS unique_texts, CAST(coalesce(f.n, 0) AS BIGINT) AS automated_count
  FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS total_sections, count(DISTINCT text) AS unique_texts FROM sens_segs GROUP BY doc_id) s
    ON d.doc_id = s.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM f_sensitive5 GROUP BY doc_id) f ON CAST(d.doc_id AS VARCHAR) = f.doc_id""",
  "sens_segs", "f_sensitive5")
_add("md_hits5", _rule_hits("md_hits5", "md_segs", "basic5", keys="doc_id, seq, location"), ["md_segs"])
o("segment_totals", f"""SELECT d.doc_id, coalesce(s.total_sections, 0) AS total_sections,
  coalesce(s.unique_texts, 0) AS unique_texts, CAST(coalesce(f.n, 0) + coalesce(s.residual, 0) AS BIGINT) AS automated_count
  FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS total_sections, count(DISTINCT text) AS unique_texts,
                    count(*) FILTER (WHERE {cjk('text')}) AS residual FROM md_segs GROUP BY doc_id) s ON d.doc_id = s.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM md_hits5 GROUP BY doc_id) f ON d.doc_id = f.doc_id""",
  "md_segs", "md_hits5")
_cls = ", ".join(f"CAST(coalesce(c.{m}, 0) AS BIGINT) AS {m}" for m in
                 ["translated", "missing", "addition", "unchanged", "modified"])
_cnt = ", ".join(f"count(*) FILTER (WHERE match = '{m}') AS {m}" for m in
                 ["translated", "missing", "addition", "unchanged", "modified"])
o("sheet_alignment", f"""SELECT m.workbook_id, m.sheet, m.sheet_idx, m.target_sheet, m.stage,
  CAST(coalesce(c.pairs, 0) AS BIGINT) AS pairs, {_cls}
  FROM sheet_map m LEFT JOIN (SELECT workbook_id, sheet, count(*) AS pairs, {_cnt} FROM pairs GROUP BY workbook_id, sheet) c
  ON m.workbook_id = c.workbook_id AND m.sheet = c.sheet WHERE m.target_sheet IS NOT NULL""", "pairs")
o("pair_totals", """SELECT w.workbook_id, CAST(coalesce(p.n, 0) AS BIGINT) AS total_pairs,
  CAST(coalesce(f.n, 0) AS BIGINT) AS total_findings
  FROM workbooks w LEFT JOIN (SELECT workbook_id, count(*) AS n FROM pairs GROUP BY workbook_id) p ON w.workbook_id = p.workbook_id
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM f_bitext GROUP BY doc_id) f ON w.workbook_id = f.doc_id""",
  "workbooks", "pairs", "f_bitext")
o("size_ratio", """SELECT *, CASE WHEN size_flag = 'larger' THEN 'Target is ' || printf('%.1f', ratio) ||
  'x larger than source — possible additions or expanded version'
  WHEN size_flag = 'smaller' THEN 'Target is ' || printf('%.1f', ratio) || 'x smaller than source — possible omissions'
  END AS size_warning FROM cmp_ratio""", "cmp_ratio")
o("sheet_summary", """SELECT workbook_id, sheet, sheet_idx, CAST(sum(cells) AS BIGINT) AS total_cells,
  string_agg(lang, ',' ORDER BY first_seq) AS languages
  FROM (SELECT workbook_id, sheet, sheet_idx, lang, count(*) AS cells, min(cell_seq) AS first_seq FROM conv_scan
        GROUP BY ALL) GROUP BY workbook_id, sheet, sheet_idx
  UNION ALL SELECT 'conversations', 'zz', CAST(count(DISTINCT role) AS BIGINT), 0, '' FROM conversations""", "conv_scan")
o("workbook_summary", """SELECT 'conversations' AS workbook_id, count(DISTINCT role) + 1 AS sheet_count,
  string_agg(DISTINCT role, ', ' ORDER BY role) || ', zz' AS sheet_names FROM conversations""")
o("cells_by_language", """SELECT workbook_id, sheet, sheet_idx, lang, count(*) AS cells, min(cell_seq) AS first_seq
  FROM conv_scan GROUP BY ALL""", "conv_scan")
o("findings_by_dimension", "SELECT dimension, count(*) AS n FROM f_report GROUP BY dimension", "f_report")
_dims_vals = ", ".join(f"({i}, '{d}')" for i, d in enumerate(C.DIMENSIONS_ALL12))
o("findings_grouped", f"""SELECT f.dimension, doc_id, detector, severity, location, description, phase, seq, sub, stream,
  CAST(d.dim_ord AS BIGINT) AS dim_ord
  FROM f_report f LEFT JOIN (VALUES {_dims_vals}) d(dim_ord, dimension) ON f.dimension = d.dimension""", "f_report")
o("report_summary", "SELECT * FROM summary", "summary_core10")
o("report_summary_all12", "SELECT * FROM summary", "summary_all12")
o("report_grand_total", f"SELECT * FROM summary WHERE dimension = '{C.GRAND_TOTAL_LABEL}'", "summary_all12")
o("report_assessment", """SELECT *, CAST(NULL AS VARCHAR) AS note FROM summary
  UNION ALL SELECT CAST(10000 AS BIGINT), 'assessment', NULL, NULL, NULL, NULL, NULL,
  'Automated pass only; manual dimensions pending review.'""", "summary_core10")

# 2.5
o("fence_parity", "SELECT doc_id, line_no, is_fence, before % 2 = 1 AS in_code FROM md_parity", "md_parity")
o("first_locations", """SELECT doc_id, text, seq, location, rn FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, text ORDER BY seq) AS BIGINT) AS rn FROM fx_lines)
  WHERE rn <= 3""", "fx_lines")
o("first_coordinates", "SELECT * FROM ccoords", "consistency")
o("sample_texts", """SELECT workbook_id, sheet, lang, coordinate, value, rn FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY workbook_id, sheet, lang ORDER BY cell_seq) AS BIGINT) AS rn
  FROM conv_scan) WHERE rn <= 25""", "conv_scan")
o("cap_sections", """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS rn
  FROM fx_lines) WHERE rn <= 200""", "fx_lines")
o("cap_sections_cells", """SELECT doc_id, seq, location, text, rn FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS rn FROM seg_tgt) WHERE rn <= 200""", "seg_tgt")
# sheet lists with sheets that have no cells; matched as the rule says, by comparing all names
_add("listed", """l_src AS (SELECT * FROM src_sheets UNION ALL
  SELECT workbook_id, 'Notes', max(sheet_idx) + 1 FROM src_sheets GROUP BY workbook_id),
l_tgt AS (SELECT workbook_id, sheet, sheet_idx + 1 AS sheet_idx FROM tgt_sheets UNION ALL SELECT DISTINCT workbook_id, 'Brand#1', 0 FROM tgt_sheets),
l_cand AS (
  SELECT s.workbook_id, s.sheet, t.sheet AS target_sheet, t.sheet_idx AS target_idx,
         CASE WHEN t.sheet = s.sheet THEN 1 WHEN """ + _PREFIX + """ THEN 2 ELSE 3 END AS stage_no
  FROM l_src s JOIN l_tgt t ON s.workbook_id = t.workbook_id
   AND (t.sheet = s.sheet OR """ + _PREFIX + """ OR t.sheet_idx = s.sheet_idx)),
l_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY stage_no, target_idx) AS rn
           FROM l_cand) WHERE rn = 1)""", ["sheets"])
o("match_sheets_listed", """SELECT s.workbook_id, s.sheet, s.sheet_idx, b.target_sheet, CAST(b.target_idx AS BIGINT) AS target_idx,
  CASE b.stage_no WHEN 1 THEN 'exact' WHEN 2 THEN 'prefix' WHEN 3 THEN 'position' END AS stage
  FROM l_src s LEFT JOIN l_best b ON s.workbook_id = b.workbook_id AND s.sheet = b.sheet""", "listed")
o("sheet_position", "SELECT DISTINCT workbook_id, sheet, sheet_idx FROM fx_tgt", "fx_tgt")
o("pick_first_target", "SELECT * FROM sheet_map WHERE target_sheet IS NOT NULL", "sheet_map")
o("sort_column_major", """SELECT workbook_id, sheet, coordinate, pair_seq,
  CAST(row_number() OVER (ORDER BY workbook_id, pair_seq) AS BIGINT) AS rn FROM pairs""", "pairs")
o("sort_row_major", f"""SELECT workbook_id, sheet, {a1('col_no', 'row_no')} AS coordinate,
  {CELL_SEQ} AS cell_seq,
  CAST(row_number() OVER (ORDER BY workbook_id, {CELL_SEQ}) AS BIGINT) AS rn
  FROM fx_src""", "fx_src")
o("sort_by_frequency", """SELECT *, CAST(row_number() OVER (ORDER BY occurrence_count DESC, first_doc, first_seq) AS BIGINT)
  AS rn FROM corpus_texts""", "corpus_texts")
o("number_findings", """SELECT CAST(row_number() OVER (ORDER BY stream, doc_id, phase, seq, sub) AS BIGINT) AS n,
  stream, doc_id, location, dimension FROM f_report""", "f_report")

# 2.6
o("coord_union", "SELECT DISTINCT workbook_id, sheet, row_no, col_no FROM pairs", "pairs")
o("merge_findings", "SELECT * FROM f_report", "f_report")
o("merge_pairs", "SELECT workbook_id, sheet, target_sheet, coordinate, source, target FROM pairs", "pairs")
o("distinct_translations", "SELECT * FROM dtrans", "consistency")

# 2.7
o("py_strip", f"SELECT conv_id, turn, {strip('text')} AS stripped FROM conversations")
o("detect_language", f"SELECT doc_id, lang, {lang_case('text')} AS detected FROM (SELECT *, {lang_scores('text')} FROM documents)")
_names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANG_NAMES.items())
o("lang_name", f"""SELECT doc_id, CASE detected {_names} END AS language FROM (
  SELECT doc_id, {lang_case('text')} AS detected FROM (SELECT *, {lang_scores('text')} FROM documents))""")
o("count_matches", "SELECT doc_id, " + ", ".join(
    f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n_{lang.lower()}" for lang, p in C.LANG_PATTERNS)
  + " FROM documents")
o("find_terms", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i){C.RULES_EXTENDED7[4][1]}'), ',') AS terms "
  "FROM fx_sensitive", "fx_sensitive")
_coord = a1("(p_partkey % 16384) + 1", "p_size")
o("parse_coordinate", f"""SELECT p_partkey, coordinate,
  CASE WHEN l = '' THEN CAST(0 AS BIGINT) ELSE CAST(list_reduce(str_split(l, ''), lambda acc, x: acc * 26 + ascii(x) - 64, CAST(0 AS BIGINT)) AS BIGINT) END AS col_no,
  CASE WHEN l = '' THEN CAST(0 AS BIGINT) ELSE TRY_CAST(regexp_extract(coordinate, '^([A-Z]+)(\\d+)', 2) AS BIGINT) END AS row_no
  FROM (SELECT p_partkey, {_coord} AS coordinate, regexp_extract({_coord}, '^([A-Z]+)(\\d+)', 1) AS l FROM part)""")
o("a1_coordinate", f"SELECT p_partkey, {_coord} AS coordinate FROM part")
o("location_string", f"""SELECT p_partkey, p_brand || '!' || {a1('p_size', 'p_partkey + 1')} AS cell,
  'Line ' || CAST(p_partkey + 1 AS VARCHAR) AS line,
  'Paragraph ' || CAST(p_partkey + 1 AS VARCHAR) || CASE WHEN p_partkey % 3 = 1 THEN ' [Heading 1]' ELSE '' END AS paragraph,
  'Table ' || CAST(p_size AS VARCHAR) || ', Row ' || CAST(p_partkey + 1 AS VARCHAR) || ', Col 2' AS doc_table,
  'Slide ' || CAST(p_size AS VARCHAR) || ', Paragraph ' || CAST(p_partkey + 1 AS VARCHAR) AS slide,
  'Slide ' || CAST(p_size AS VARCHAR) || ', Table Row ' || CAST(p_partkey + 1 AS VARCHAR) || ', Col 1' AS slide_table,
  'Page ' || CAST(p_size AS VARCHAR) || ', Line ' || CAST(p_partkey + 1 AS VARCHAR) AS page_line,
  'Page ' || CAST(p_size AS VARCHAR) || ', Table Row ' || CAST(p_partkey + 1 AS VARCHAR) || ', Col 3' AS page_table,
  {loc_html("'p'", 'p_name')} AS html, 'Sheet: ' || p_brand AS sheet FROM part""")
o("truncate_text", "SELECT doc_id, " + ", ".join(f"{cut('text', n)} AS t{n}" for n in (30, 40, 50, 60))
  + " FROM documents")
o("char_count", "SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count FROM documents")
o("strip_sheet_suffix", "SELECT sheet, regexp_replace(sheet, '[_ENJAKODFRS]+\\z', '') AS base "
  "FROM (SELECT DISTINCT workbook_id, sheet, sheet_idx FROM fx_tgt)", "fx_tgt")
o("starts_with", """SELECT sheet AS source_sheet, target_sheet, starts_with(target_sheet, sheet) AS starts_with
  FROM sheet_map WHERE target_sheet IS NOT NULL""", "sheet_map")
o("file_suffix", f"SELECT doc_id, path, {SUFFIX} AS suffix FROM fx_routed", "fx_routed")
o("compare_mode", f"SELECT doc_id, CASE WHEN {SUFFIX} IN ('.xlsx', '.xls') THEN 'excel' ELSE 'generic' END AS mode "
  "FROM fx_routed", "fx_routed")
o("format_ratio", "SELECT pair_id, printf('%.1f', ratio) AS ratio_text FROM cmp_ratio", "cmp_ratio")

def py_list(x: str) -> str:
    """A list as Python prints it: escapes, then the quotes that need fewest of them."""
    esc = "replace(replace(replace(e, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(160), chr(92) || 'xa0')"
    one = (f"CASE WHEN contains(e, chr(39)) AND NOT contains(e, chr(34)) THEN chr(34) || {esc} || chr(34) "
           f"ELSE chr(39) || replace({esc}, chr(39), chr(92) || chr(39)) || chr(39) END")
    return f"('[' || array_to_string(list_transform({x}, lambda e: {one}), ', ') || ']')"


o("list_repr", f"""SELECT source, {py_list('translations')} AS repr,
  {py_list("list_transform(translations, lambda t: 'l' || chr(39) || t || chr(92))")} AS quoted,
  {py_list("list_transform(translations, lambda t: 'l' || chr(39) || chr(34) || t || chr(10) || chr(160))")} AS both,
  '[]' AS none FROM cstats WHERE n_translations > 1""", "consistency")
o("html_text", f"SELECT page_id, {html_text('html')} AS text FROM pages")
o("severity_style", """SELECT stream, doc_id, phase, seq, sub, coalesce(f.severity, 'P3') AS severity, s.fill_rgb
  FROM f_report f LEFT JOIN severities s ON coalesce(f.severity, 'P3') = s.severity""", "f_report", "severities")
o("finding_json", """SELECT stream, doc_id, phase, seq, sub,
  CAST(json_object('dimension', dimension, 'severity', severity, 'location', location, 'description', description)
       AS VARCHAR) AS json FROM f_report""", "f_report")

# 2.10
o("fullwidth_punct", f"""SELECT {_fcols('doc_id', 'fullwidth_punct', "'翻译规范'", "'P2'", 'location',
  "'Full-width punctuation in target: ' || " + qt(f"array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{C.FULLWIDTH_PUNCT_CLASS}'))), '')"),
  0, 'seq')} FROM fw_segs WHERE regexp_matches(text, '{C.FULLWIDTH_PUNCT_CLASS}')
  AND NOT regexp_matches(text, '[一-鿿ぁ-ゟ゠-ヿ가-힣]')""", "fw_segs")
_reg_parts = []
for _i, (_lang, _f, _inf, _fp, _ip) in enumerate(_register()):
    _reg_parts.append(
        f"SELECT {_fcols('doc_id', 'register_mix', chr(39) + '翻译规范' + chr(39), chr(39) + 'P2' + chr(39), chr(39) + 'Document' + chr(39), chr(39) + f'Mixed formal and informal address ({_lang}): ' + chr(39) + ' || ' + qt(chr(39) + _f + chr(39)) + ' || ' + chr(39) + ' and ' + chr(39) + ' || ' + qt(chr(39) + _inf + chr(39)), 0, 0, _i)} "
        f"FROM fx_register WHERE coalesce(lower(lang) = '{_lang}', true) AND regexp_matches(text, '{_fp}') AND regexp_matches(text, '{_ip}')")
# without a language column all forms count
_reg_any = [p.replace(f"coalesce(lower(lang) = '{lang}', true) AND ", "") for p, (lang, *_) in zip(_reg_parts, _register())]
o("register_mix_any", " UNION ALL ".join(_reg_any), "fx_register")
o("register_mix", " UNION ALL ".join(_reg_parts), "fx_register")
o("register_mix_jako", "SELECT * FROM jako_counts", "jako_counts")
o("register_mix_jako_findings", f"""SELECT {_fcols('doc_id', 'register_mix_jako', "'翻译规范'", "'P2'", "'Document'",
  "'Mixed polite and plain sentence endings (ja): ' || CAST(ja_polite AS VARCHAR) || ' polite, ' || CAST(ja_plain AS VARCHAR) || ' plain'", 0, 0, 0)}
  FROM jako_counts WHERE ja_polite > 0 AND ja_plain > 0
  UNION ALL SELECT {_fcols('doc_id', 'register_mix_jako', "'翻译规范'", "'P2'", "'Document'",
  "'Mixed formal and polite sentence endings (ko): ' || CAST(ko_formal AS VARCHAR) || ' formal, ' || CAST(ko_polite AS VARCHAR) || ' polite'", 0, 0, 1)}
  FROM jako_counts WHERE ko_formal > 0 AND ko_polite > 0""", "jako_counts")
o("terminology_check", f"""SELECT CAST(p.workbook_id AS VARCHAR) AS doc_id, 'terminology' AS detector, '术语错误' AS dimension,
  'P2' AS severity, p.sheet || '!' || p.coordinate AS location,
  'Term ' || {qt('g.term')} || ' should be rendered as ' || {qt('g.approved')} || ', target: ' || {qt(cut('p.target', 50))} AS description,
  CAST(0 AS BIGINT) AS phase, CAST(p.pair_seq AS BIGINT) AS seq
  FROM pairs p JOIN fx_glossary g ON contains(p.source, g.term)
  WHERE p.target IS NOT NULL AND p.source IS NOT NULL AND NOT contains(p.target, g.approved)""", "pairs", "fx_glossary")
o("ingest_manual", """SELECT CAST(0 AS BIGINT) AS stream, dimension, severity, location, description FROM f_bitext
  UNION ALL SELECT CAST(1 AS BIGINT), dimension, severity, location, description FROM manual""", "f_bitext", "manual")
o("report_with_manual", "SELECT * FROM summary", "summary_manual")
_md_cols = ["dimension"] + C.SEVERITY_NAMES + ["total"]
_md_head = "| " + " | ".join(C.SUMMARY_HEADINGS[c] for c in _md_cols) + " |"
_md_rule = "|" + "|".join(["---"] * len(_md_cols)) + "|"
o("markdown_summary", f"""SELECT CAST(-2 AS BIGINT) AS dim_ord, '{_md_head}' AS line
  UNION ALL SELECT CAST(-1 AS BIGINT), '{_md_rule}'
  UNION ALL SELECT dim_ord, '| ' || concat_ws(' | ', {', '.join(f'CAST({c} AS VARCHAR)' for c in _md_cols)}) || ' |'
  FROM summary""", "summary_all12")


# files
o("load_text_files", """SELECT CAST(doc_id // 50 AS BIGINT) AS part, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars,
  md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1""")
_add("file_texts", """file_texts AS (SELECT CAST(doc_id // 50 AS BIGINT) AS doc_id,
  string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1)""")
_add("file_lines", explode_lines("file_lines", "file_texts"), ["file_texts"])
_add("file_segs", seg_lines("file_segs", "file_lines"), ["file_lines"])
o("segment_text_lines", "SELECT doc_id AS part, seq, location, text FROM file_segs", "file_segs")
_add("label_items", """label_items AS (SELECT CAST(doc_id // 20 AS BIGINT) AS part, doc_id, quality,
  CASE doc_id % 5 WHEN 0 THEN '{}' WHEN 1 THEN '{"note": 1}' WHEN 2 THEN '"' || CAST(doc_id AS VARCHAR) || '"'
    ELSE '{"severity": "P' || CAST(quality AS VARCHAR) || '", "location": "Document ' || CAST(doc_id AS VARCHAR)
      || '", "dimension": "地道性"}' END AS item FROM labels)""")
o("read_findings_files", """SELECT part, 'finding' AS what, CASE WHEN doc_id % 5 < 3 THEN 'P3' ELSE 'P' || CAST(quality AS VARCHAR) END AS severity,
  CASE WHEN doc_id % 5 < 3 THEN '' ELSE 'Document ' || CAST(doc_id AS VARCHAR) END AS location,
  CASE WHEN doc_id % 5 < 3 THEN '' ELSE '地道性' END AS dimension
  FROM label_items WHERE part % 4 < 2 AND doc_id % 5 <> 2
UNION ALL SELECT part, 'reject', '', item, '' FROM label_items WHERE part % 4 < 2 AND doc_id % 5 = 2
UNION ALL SELECT DISTINCT part, 'assessment', '', 'part ' || CAST(part AS VARCHAR), '' FROM label_items WHERE part % 4 = 1
UNION ALL SELECT part, 'reject', '', '[' || string_agg(item, ', ' ORDER BY doc_id) || ',', '' FROM label_items
  WHERE part % 4 = 3 GROUP BY part""", "label_items")
o("sensitive_matches_large", """SELECT p_partkey, w AS rule_id,
  CAST(row_number() OVER (PARTITION BY p_partkey, w ORDER BY i) - 1 AS BIGINT) AS match_no, w AS term, 'P2' AS severity
  FROM (SELECT p_partkey, ws[i] AS w, i FROM (SELECT p_partkey, ws, unnest(range(1, len(ws) + 1)) AS i
    FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)))
  WHERE regexp_full_match(w, '[a-z]+')""")
ORACLE["terminology_check_large"] = ORACLE["terminology_check"]
o("detect_language_table", f"""SELECT doc_id, CASE WHEN text IS NULL OR {strip('text')} = '' THEN 'unknown' ELSE upper(lang) END AS detected
  FROM (SELECT doc_id, text, r.lang, row_number() OVER (PARTITION BY doc_id ORDER BY
          len(regexp_extract_all(coalesce(text, ''), '(?i)[' || r.lang || ']{{2}}')) DESC, r.n DESC, upper(r.lang)) AS rn
        FROM documents, (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) r)
  WHERE rn = 1""")
o("run_counts", """SELECT 'findings' AS name, count(*) AS n FROM f_report_manual
UNION ALL SELECT 'rejects', CAST(0 AS BIGINT)
UNION ALL SELECT 'unlisted', count(*) FILTER (WHERE dimension IN ('增译', '漏译')) FROM f_report_manual
UNION ALL SELECT dimension, total FROM summary""", "f_report_manual", "summary_manual")
