"""Fixed values of the review model.

Everything in this module is data, not logic: dimension and severity lists,
rule packs, language character classes, message templates. The values that
must equal the behaviour we reproduce are stated plainly, in their natural
order, under the FIXED VALUES markers below.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: review dimensions, in report order.
# The first ten are the summary dimensions; the last two are the comparative
# dimensions (addition, omission) that only the twelve-dimension summary lists.
# ---------------------------------------------------------------------------
DIMENSIONS_CORE10 = [
    "漏翻",      # missing (untranslated text left in the target)
    "错译",      # mistranslation
    "一致性",    # consistency
    "术语错误",  # terminology
    "拼写错误",  # spelling
    "语法错误",  # grammar
    "敏感词",    # sensitive
    "技术原理",  # technical accuracy
    "翻译规范",  # style
    "地道性",    # idiomaticity
]
DIMENSIONS_COMPARATIVE = [
    "增译",  # addition
    "漏译",  # omission
]
DIMENSIONS_ALL12 = DIMENSIONS_CORE10 + DIMENSIONS_COMPARATIVE

DIM_MISSING = "漏翻"
DIM_CONSISTENCY = "一致性"
DIM_TERMINOLOGY = "术语错误"
DIM_SENSITIVE = "敏感词"
DIM_STYLE = "翻译规范"
DIM_ADDITION = "增译"
DIM_OMISSION = "漏译"

# Label of the grand-total row of the summary table.
GRAND_TOTAL_LABEL = "总计"

# ---------------------------------------------------------------------------
# FIXED VALUES: severities, rank order, fill colour.
# ---------------------------------------------------------------------------
SEVERITIES = [
    ("P0", 0, "FF4444"),
    ("P1", 1, "FF9933"),
    ("P2", 2, "FFDD44"),
    ("P3", 3, "88CCEE"),
]
SEVERITY_NAMES = [s[0] for s in SEVERITIES]
DEFAULT_SEVERITY = "P3"

# Report headings (detail sheet, summary sheet) used by the report sinks.
DETAIL_HEADINGS = {"n": "#", "location": "问题位置", "description": "问题描述",
                   "severity": "严重程度", "dimension": "问题类别"}
SUMMARY_HEADINGS = {"dimension": "维度", "P0": "P0", "P1": "P1", "P2": "P2",
                    "P3": "P3", "total": "合计"}
DETAIL_SHEET = "审查结果"
SUMMARY_SHEET = "审查总结"

# ---------------------------------------------------------------------------
# FIXED VALUES: finding messages and location formats.  ``{name}`` marks a
# value filled in per row; texts are cut as noted (code points).
# ---------------------------------------------------------------------------
MESSAGES = {
    "residual": "Untranslated Chinese: '{text}'",                  # text cut at 60
    "residual_cell": "Cell contains untranslated Chinese: '{text}'",  # text cut at 60
    "sensitive": "{description}: '{term}'",
    "sensitive_cell": "{description}: '{term}' in '{text}'",      # text cut at 60
    "missing_sheet": "No matching sheet in target for '{sheet}'",
    "omission": "Source '{text}' not translated",                  # text cut at 50
    "addition": "Added '{text}' with no source",                   # text cut at 50
    "consistency": "'{text}' translated {k} ways: {translations}",  # text cut at 30
    "larger": "Target is {ratio}x larger than source — possible additions or expanded version",
    "smaller": "Target is {ratio}x smaller than source — possible omissions",
}
LOCATIONS = {
    "cell": "{sheet}!{coordinate}",
    "sheet": "Sheet: {sheet}",
    "line": "Line {line}",
    "paragraph": "Paragraph {para}{style}",
    "paragraph_style": " [{style}]",                 # left out for Normal / no style
    "table": "Table {table}, Row {row}, Col {col}",
    "slide_paragraph": "Slide {slide}, Paragraph {para}",
    "slide_table": "Slide {slide}, Table Row {row}, Col {col}",
    "page_line": "Page {page}, Line {line}",
    "page_table": "Page {page}, Table Row {row}, Col {col}",
    "html": '<{tag}> "{text}"',                      # text cut at 40, then "..."
}

# ---------------------------------------------------------------------------
# FIXED VALUES: the "Chinese" character range (U+4E00..U+9FFF).
# ---------------------------------------------------------------------------
CJK_CLASS = "[一-鿿]"

# ---------------------------------------------------------------------------
# FIXED VALUES: whitespace removed by a Python-style strip():
# ASCII controls TAB..CR, FS GS RS US, space, NEL, NBSP, OGHAM SPACE MARK,
# EN QUAD..HAIR SPACE, LINE SEPARATOR, PARAGRAPH SEPARATOR, NARROW NBSP,
# MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE.  (Not U+200B, not U+FEFF.)
# Written in a syntax both the JVM and RE2 regex engines accept.
# ---------------------------------------------------------------------------
STRIP_CLASS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# ---------------------------------------------------------------------------
# FIXED VALUES: sensitive-term rule packs.
# Each rule: (rule_id, pattern body, severity, description).
# Pattern bodies are case-insensitive, whole-word alternations; the JVM form
# adds the (?iU) flags.  The taiwan rule excludes "Taiwan" followed by
# whitespace and "Strait".  The security rule of the extended pack is exempt
# when the text contains "security" (any case).
# ---------------------------------------------------------------------------
RULES_BASIC5 = [
    ("taiwan", r"\bTaiwan\b(?!\s+Strait)", "P0", "Possible Taiwan reference"),
    ("tibet", r"\bTibet\b", "P0", "Possible Tibet reference"),
    ("drugs", r"\b(drug|narcotic|cocaine|heroin)\b", "P1", "Sensitive term"),
    ("violence", r"\b(kill|destroy|attack|bomb)\b", "P1", "Violence-related term"),
    ("legal", r"\b(fraud|scam|illegal)\b", "P1", "Legal sensitivity"),
]
RULES_EXTENDED7 = [
    ("taiwan", r"\bTaiwan\b(?!\s+Strait)", "P0", "可能涉及台湾表述"),
    ("tibet", r"\bTibet\b", "P0", "可能涉及西藏表述"),
    ("politics", r"\b(Communist|CCP|Mao|Tiananmen)\b", "P0", "敏感政治词汇"),
    ("drugs", r"\b(drug|narcotic|cocaine|heroin)\b", "P1", "敏感词汇"),
    ("security", r"\b(hacker?|crack(er|ing)|exploit|backdoor)\b", "P2", "安全敏感词"),
    ("violence", r"\b(kill|destroy|attack|bomb)\b", "P1", "暴力相关词汇"),
    ("legal", r"\b(fraud|scam|illegal|criminal)\b", "P1", "法律敏感词"),
]
RULE_PACKS = {"basic5": RULES_BASIC5, "extended7": RULES_EXTENDED7}
# rule_id -> substring (lower case) whose presence exempts the text
RULE_EXEMPTIONS = {"extended7": {"security": "security"}}

# ---------------------------------------------------------------------------
# FIXED VALUES: language detection classes, in tie-break order.
# EN counts runs of three or more ASCII letters; the others count characters.
# ---------------------------------------------------------------------------
LANG_PATTERNS = [
    ("EN", "[a-zA-Z]{3,}"),
    ("JA", "[ぁ-んァ-ン]"),
    ("KO", "[가-힣]"),
    ("DE", "[äöüßÄÖÜ]"),
    ("FR", "[éèêëàâùûîïôçÉÈÊËÀÂÙÛÎÏÔÇ]"),
    ("ES", "[áéíóúñÁÉÍÓÚÑüÜ]"),
]
LANG_NAMES = {
    "EN": "English", "JA": "Japanese", "KO": "Korean",
    "DE": "German", "FR": "French", "ES": "Spanish",
}
LANG_UNKNOWN = "unknown"

# ---------------------------------------------------------------------------
# FIXED VALUES: characters stripped from the end of a target sheet name
# before comparing it with a source sheet name (a character set, not a suffix).
# ---------------------------------------------------------------------------
SHEET_SUFFIX_CHARS = "_EN_JA_KO_DE_FR_ES"

# ---------------------------------------------------------------------------
# FIXED VALUES: document suffix -> parser.  Unknown suffixes read as text.
# ---------------------------------------------------------------------------
SUFFIX_PARSERS = {
    ".xlsx": "xlsx", ".xls": "xlsx",
    ".docx": "docx", ".doc": "docx",
    ".pptx": "pptx", ".ppt": "pptx",
    ".pdf": "pdf",
    ".md": "md", ".markdown": "md",
    ".html": "html", ".htm": "html",
    ".txt": "txt", ".csv": "txt",
}
DEFAULT_PARSER = "txt"
EXCEL_SUFFIXES = [".xlsx", ".xls"]

# ---------------------------------------------------------------------------
# FIXED VALUES: output caps and thresholds.
# ---------------------------------------------------------------------------
CAP_SECTIONS = 200          # segments shown per side in a document compare
CAP_SAMPLES = 25            # sample texts per sheet and language
CAP_LOCATIONS = 3           # locations listed per unique text
CAP_COORDINATES = 5         # coordinates listed per consistency finding
RATIO_LARGER = 1.5          # target/source segment ratio above which we warn
RATIO_SMALLER = 0.5         # ... and below which we warn
ADDITION_MIN_LEN = 3        # an added cell is a finding when longer than this

# Text cut lengths (code points) used in messages.
CUT_CONSISTENCY = 30
CUT_HTML_LOCATION = 40
CUT_PAIR = 50
CUT_FINDING = 60

# ---------------------------------------------------------------------------
# FIXED VALUES: HTML handling.
# ---------------------------------------------------------------------------
HTML_SKIP_TAGS = ["script", "style", "nav", "footer", "code", "pre"]
HTML_TEXT_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th"]
HTML_BLOCK_TAGS = HTML_TEXT_TAGS + ["ul", "ol", "table", "tr", "div", "article",
                                    "section", "body", "html"]
# Elements that end an open element of the second list when they begin, unless
# one of the third list stands between (an item ends the item before it in the
# same list, a cell the cell before it in the same row).
HTML_IMPLIED_ENDS = [
    (["li"], ["li"], ["ul", "ol"]),
    (["td", "th"], ["td", "th"], ["tr", "table"]),
    (["tr"], ["tr"], ["table"]),
]
# Character references that would read as markup; decoded after tags are gone,
# "&amp;" last, so that "&amp;lt;" stays "&lt;".
HTML_MARKUP_REFERENCES = [
    ("<", ["&lt;", "&#60;", "&#x3c;", "&#x3C;"]), (">", ["&gt;", "&#62;", "&#x3e;", "&#x3E;"]),
    ("&", ["&#38;", "&#x26;", "&amp;"]),
]

# ---------------------------------------------------------------------------
# Rule packs of our own for checks the reference only documents
# (style notes per target language).  Semantics are ours.
# ---------------------------------------------------------------------------
# Full-width punctuation that should not survive in a Latin-script target.
FULLWIDTH_PUNCT_CLASS = "[，。！？；：（）]"
# Formal vs informal address per language: (lang, formal form, informal form).
REGISTER_FORMS = [
    ("de", "Sie", "du"),
    ("fr", "vous", "tu"),
    ("es", "usted", "tú"),
]
# Japanese polite vs plain sentence endings; Korean formal vs polite endings.
JA_POLITE_ENDINGS = ["です", "ます", "でした", "ました", "ません", "ましょう"]
JA_PLAIN_ENDINGS = ["だ", "である", "だった", "ない", "る", "た"]
KO_FORMAL_ENDINGS = ["니다", "니까", "십시오"]
KO_POLITE_ENDINGS = ["요"]
SENTENCE_END_CLASS = "[。．！？!?.]"
