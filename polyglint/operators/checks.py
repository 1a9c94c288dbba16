"""Automated checks: untranslated (CJK) text and sensitive terms.

Findings share one flat schema (``FINDING_COLS``).  Ordering columns:
``phase`` (0 main pass, 1 corpus-level checks such as consistency), ``seq``
(position of the item in its document) and ``sub`` (order inside the item:
0 for the residual check, then rule by rule, match by match).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog as C
from ..functions import text as X
from . import literals

FINDING_COLS = ["doc_id", "detector", "dimension", "severity", "location",
                "description", "phase", "seq", "sub"]

RULE_STRIDE = 1_000_000_000   # sub = (rule_no + 1) * RULE_STRIDE + match_no


def _order_value(df: DataFrame, seq) -> Column:
    """A place as it is, a DECIMAL or a BIGINT."""
    wide = isinstance(df.select(X.col_(seq).alias("s")).schema["s"].dataType, T.DecimalType)
    return X.col_(seq).cast("decimal(38,0)" if wide else "bigint")


def finding(df: DataFrame, *, detector: str, dimension, severity, location, description,
            seq, doc_id="doc_id", phase: int = 0, sub=None) -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    sub = F.lit(0) if sub is None else sub
    return df.select(
        X.col_(doc_id).cast("string").alias("doc_id"),
        F.lit(detector).alias("detector"),
        lit(dimension).alias("dimension"),
        lit(severity).alias("severity"),
        X.col_(location).alias("location"),
        X.col_(description).alias("description"),
        F.lit(phase).cast("bigint").alias("phase"),
        _order_value(df, seq).alias("seq"),
        X.col_(sub).cast("bigint").alias("sub"),
    )


def target_only(segments: DataFrame) -> DataFrame:
    """Source documents get no automated findings."""
    if "is_source" in segments.columns:
        return segments.filter(~F.coalesce(F.col("is_source"), F.lit(False)))
    return segments


# --------------------------------------------------------------------------
# residual (untranslated) text
# --------------------------------------------------------------------------

def residual_findings(segments: DataFrame, script_class: str = C.CJK_CLASS) -> DataFrame:
    """漏翻 / P1 for every target segment holding a character of the source
    script (``script_class``, default U+4E00..U+9FFF)."""
    hit = target_only(segments).filter(X.has_cjk("text", script_class))
    desc = X.render(C.MESSAGES["residual"], text=X.truncate_text("text", C.CUT_FINDING))
    return finding(hit, detector="residual", dimension=C.DIM_MISSING, severity="P1",
                   location="location", description=desc, seq="seq")


def residual_findings_cells(cells: DataFrame) -> DataFrame:
    """Scan wording, over ``scan_cells`` output."""
    hit = cells.filter(F.col("has_cjk"))
    desc = X.render(C.MESSAGES["residual_cell"], text=X.truncate_text("value", C.CUT_FINDING))
    return finding(hit, detector="residual", dimension=C.DIM_MISSING, severity="P1",
                   doc_id="workbook_id",
                   location=X.loc_cell("sheet", "coordinate"), description=desc,
                   seq="cell_seq")


# --------------------------------------------------------------------------
# sensitive terms
# --------------------------------------------------------------------------

JVM_FLAGS = "(?iU)"   # Unicode case folding and Unicode word boundaries


def rule_pattern(body: str) -> str:
    return JVM_FLAGS + body


RULES_SCHEMA = ("rule_id string, pattern string, severity string, description string, "
                "exempt_if_contains string")


def rules_table(spark, pack: str = "basic5") -> DataFrame:
    """A built-in rule pack as a table (rule_id, pattern, severity,
    description, exempt_if_contains): the form in which users supply their
    own packs."""
    ex = C.RULE_EXEMPTIONS.get(pack, {})
    rows = [(rid, body, sev, desc, ex.get(rid)) for rid, body, sev, desc in C.RULE_PACKS[pack]]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def resolve_rules(pack) -> tuple[list, dict]:
    """(rules, exemptions) from a pack name, a list of
    (rule_id, pattern, severity, description[, exempt_if_contains]) tuples,
    or a rules DataFrame.  A rule pack is configuration — a handful of rows —
    so a DataFrame pack is read on the driver and compiled into expressions."""
    if isinstance(pack, str):
        return list(C.RULE_PACKS[pack]), dict(C.RULE_EXEMPTIONS.get(pack, {}))
    pack = resolve_pack(pack)
    rules, exempt = [], {}
    for r in pack:
        rules.append(tuple(r[:4]))
        if len(r) > 4 and r[4]:
            exempt[r[0]] = r[4].lower()
    return rules, exempt


MAX_RULES = 10_000


def resolve_pack(pack):
    """A pack that is a DataFrame, read once; any other as it is."""
    if isinstance(pack, DataFrame):
        rows = pack.select("rule_id", "pattern", "severity", "description", "exempt_if_contains").limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            raise ValueError(f"a rule pack holds at most {MAX_RULES} rules")
        return [tuple(r) for r in rows]
    return pack


def _factored(rules: list) -> tuple[literals.Pack | None, str, list[int]]:
    """The literal rules of a large pack as one (None in small packs), a pattern
    of all rules, and the numbers of the rules that keep a pass of their own."""
    pack = literals.compiled(tuple(r[1] for r in rules))
    if pack is None:
        return None, "|".join(f"(?:{body})" for _, body, _, _ in rules), list(range(len(rules)))
    own = [rf"\b(?:{pack.trie})\b", *[f"(?:{rules[no][1]})" for no in pack.others]]
    return pack, "|".join(own), list(pack.others)


def combined_pattern(pack) -> str:
    rules, _ = resolve_rules(pack)
    return JVM_FLAGS + _factored(rules)[1]


_RULE_HITS = "array<struct<rule_no:bigint,match_no:bigint,term:string>>"


def rule_hits(text: Column, rules: list) -> Column:
    """Array of (rule_no, match_no, term): what each rule finds in a text, one rule
    after the other where each has its pass, the literal rules of a large pack
    before the others."""
    pack, _, others = _factored(rules)
    parts = [F.transform(F.regexp_extract_all(text, F.lit(rule_pattern(rules[no][1])), 0), _rule_hit(no)) for no in others]
    if pack is not None:
        parts.insert(0, literals.literal_hits(text, pack))
    return F.flatten(F.array(*parts)) if parts else F.array().cast(_RULE_HITS)


def _rule_hit(no: int):
    return lambda term, i: F.struct(F.lit(no).cast("bigint").alias("rule_no"), i.cast("bigint").alias("match_no"), term.alias("term"))


def _rules_literal(rules: list, exemptions: dict) -> Column:
    """The rules as one literal array, read once by the optimiser; a rule is found
    by its number."""
    rows = [{"rule_id": r[0], "severity": r[2], "rule_desc": r[3], "exempt": exemptions.get(r[0])} for r in rules]
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)),
                       "array<struct<rule_id:string,severity:string,rule_desc:string,exempt:string>>")


def sensitive_matches(df: DataFrame, pack="basic5", text_col: str = "text") -> DataFrame:
    """All rule hits per row: one output row per match, in rule order then
    text order, with ``rule_no, rule_id, match_no, term, severity, rule_desc``.

    One pass for all rules: a single combined alternation pre-filters the
    rows, and the hits of every rule are flattened into one array that is
    exploded once.  The literal rules of a large pack are one factored pattern
    (``literals``).  Exemptions (a rule dropped when the text contains a word)
    are applied after the explode.
    """
    rules, exemptions = resolve_rules(pack)
    text = F.col(text_col)
    if not rules:
        df = df.limit(0)
    known = _rules_literal(rules, exemptions)
    out = (df.filter(text.rlike(combined_pattern(rules)) if rules else F.lit(False))
           .select("*", F.inline(rule_hits(text, rules)))
           .withColumn("_rule", F.element_at(known, (F.col("rule_no") + 1).cast("int"))))
    allowed = F.col("_rule.exempt").isNull() | ~F.lower(text).contains(F.col("_rule.exempt"))
    return out.where(allowed).select(*df.columns, "rule_no", "_rule.rule_id", "match_no", "term", "_rule.severity", "_rule.rule_desc")


def sensitive_findings(segments: DataFrame, pack="basic5") -> DataFrame:
    """敏感词 findings over segments: ``<description>: '<term>'``."""
    m = sensitive_matches(target_only(segments), pack)
    desc = X.render(C.MESSAGES["sensitive"], description="rule_desc", term="term")
    sub = (F.col("rule_no") + 1) * F.lit(RULE_STRIDE) + F.col("match_no")
    return finding(m, detector="sensitive", dimension=C.DIM_SENSITIVE,
                   severity=F.col("severity"), location="location", description=desc,
                   seq="seq", sub=sub)


def sensitive_findings_cells(cells: DataFrame, pack="extended7") -> DataFrame:
    """Scan wording over ``scan_cells`` output:
    ``<description>: '<term>' in '<value cut at 60>'``."""
    m = sensitive_matches(cells, pack, "value")
    desc = X.render(C.MESSAGES["sensitive_cell"], description="rule_desc", term="term",
                    text=X.truncate_text("value", C.CUT_FINDING))
    sub = (F.col("rule_no") + 1) * F.lit(RULE_STRIDE) + F.col("match_no")
    return finding(m, detector="sensitive", dimension=C.DIM_SENSITIVE,
                   severity=F.col("severity"), doc_id="workbook_id",
                   location=X.loc_cell("sheet", "coordinate"), description=desc,
                   seq="cell_seq", sub=sub)


HIT = "array<struct<detector:string,dimension:string,severity:string,description:string,sub:bigint>>"


def finding_hits(text, pack="basic5", script_class: str = C.CJK_CLASS, include_residual: bool = True) -> Column:
    """All findings of one text, as an array inside the row: the residual
    finding first, then rule by rule, match by match.  One pass serves both
    checks."""
    text = X.col_(text)
    rules, exemptions = resolve_rules(pack)
    none = F.array().cast(HIT)
    parts = []
    if include_residual:
        desc = X.render(C.MESSAGES["residual"], text=X.truncate_text(text, C.CUT_FINDING))
        parts.append(F.when(X.has_cjk(text, script_class), F.array(F.struct(
            F.lit("residual").alias("detector"), F.lit(C.DIM_MISSING).alias("dimension"), F.lit("P1").alias("severity"),
            desc.alias("description"), F.lit(0).cast("bigint").alias("sub"))).cast(HIT)).otherwise(none))
    known = _rules_literal(rules, exemptions)

    def sensitive(hit):
        def described(rule):
            return F.when(rule["exempt"].isNull() | ~F.lower(text).contains(rule["exempt"]), F.struct(
                F.lit("sensitive").alias("detector"), F.lit(C.DIM_SENSITIVE).alias("dimension"), rule["severity"].alias("severity"),
                X.render(C.MESSAGES["sensitive"], description=rule["rule_desc"], term=hit["term"]).alias("description"),
                ((hit["rule_no"] + 1) * RULE_STRIDE + hit["match_no"]).cast("bigint").alias("sub")))
        return X.let(F.element_at(known, (hit["rule_no"] + 1).cast("int")), described)

    if rules:
        parts.append(F.filter(F.transform(rule_hits(text, rules), sensitive), lambda h: h.isNotNull()).cast(HIT))
    if not parts:
        return none
    hits = F.flatten(F.array(*parts))
    return F.when(_may_hit(text, rules, script_class, include_residual), hits).otherwise(none)


def _may_hit(text: Column, rules: list, script_class: str, include_residual: bool) -> Column:
    any_rule = text.rlike(combined_pattern(rules)) if rules else F.lit(False)
    return (any_rule | X.has_cjk(text, script_class)) if include_residual else any_rule


def loose_pattern(pack) -> str | None:
    """A pattern that matches a whole document whenever any line of it could
    match a rule, or None where there is no telling.

    Negative look-aheads without groups are dropped, which only widens a rule.
    A rule with an anchor, with another look-around or with a back reference
    depends on where a line begins or ends, which the whole text doesn't
    show."""
    rules, _ = resolve_rules(pack)
    factored, _, others = _factored(rules)
    parts = [] if factored is None else [rf"\b(?:{factored.trie})\b"]
    for no in others:
        wide = re.sub(r"[(][?]![^()]*[)]", "", rules[no][1])
        # escaped characters and character classes can't anchor anything
        bare = re.sub(r"\\[^AzZGbBkQE0-9]|\[\^?\]?[^\]]*\]", "", wide)
        if re.search(r"[\^$]|\\[AzZGBkQE0-9]|[(][?][^:]", bare):
            return None
        parts.append(f"(?:{wide})")
    return JVM_FLAGS + "|".join(parts) if parts else None


def may_hold_findings(text, pack="basic5", script_class: str = C.CJK_CLASS, include_residual: bool = True) -> Column:
    """False only for a document none of whose lines can have a finding (see
    ``loose_pattern``); for plain text and markdown."""
    text = X.col_(text)
    loose = loose_pattern(pack)
    if loose is None:
        return F.lit(True)
    return (text.rlike(script_class) | text.rlike(loose)) if include_residual else text.rlike(loose)


def document_findings(docs: DataFrame, segmenter, pack="basic5",
                      script_class: str = C.CJK_CLASS, text_col: str = "text",
                      include_residual: bool = True) -> DataFrame:
    """Residual + sensitive findings of line-segmented documents (plain
    text, markdown).  A document that can hold no finding is dropped before
    its lines are split, where the rules allow to tell (``loose_pattern``);
    else all are split.  Equal to ``automated_findings`` of all segments for
    segmenters whose segments are stripped substrings of the text (not for
    HTML, where tag removal can join text)."""
    pack = resolve_pack(pack)
    docs = docs.filter(may_hold_findings(text_col, pack, script_class, include_residual))
    return automated_findings(segmenter(docs), pack, script_class=script_class, include_residual=include_residual)


def automated_findings(segments: DataFrame, pack="basic5", dedup: bool = False,
                       script_class: str = C.CJK_CLASS, include_residual: bool = True) -> DataFrame:
    """Residual + sensitive findings of target segments (document review), in
    one pass over them.

    ``dedup=True`` checks each distinct text once and joins the texts that
    have hits back to their segments — worth it when boilerplate repeats
    massively (the regexes then run once per distinct text; the join-back of
    a hot text is an inner join AQE can split)."""
    segs = target_only(segments)
    hits = finding_hits("text", pack, script_class, include_residual)
    if dedup:
        segs = segs.join(segs.select("text").distinct().select("text", F.inline(hits)), "text")
    else:
        segs = segs.select("doc_id", "location", "seq", F.inline(hits))
    return segs.select(
        F.col("doc_id").cast("string").alias("doc_id"), "detector", "dimension", "severity", "location",
        "description", F.lit(0).cast("bigint").alias("phase"), _order_value(segs, "seq").alias("seq"), "sub")


def scan_findings(scanned: DataFrame, pack="extended7") -> DataFrame:
    """Residual + sensitive findings of scanned workbook cells."""
    return residual_findings_cells(scanned).unionByName(
        sensitive_findings_cells(scanned, pack))
