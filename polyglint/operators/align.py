"""Source/target workbook alignment.

Plan shape::

    distinct sheets (src, tgt) --equi-joins on (workbook_id, key)--> min(stage, idx)
        -> sheet_map (one row per source sheet; small, cached, size-checked)
    src cells --broadcast sheet_map--+
                                     +--full outer on cell key--> pairs
    tgt cells --broadcast sheet_map--+
    pairs -> classify -> {omissions, additions, stats, consistency}

The only wide operations on cells are the full outer join (keys include the
row and column, so no key is hot) and the consistency aggregation, which is
pre-aggregated on (source, target) before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import text as X
from ..plans.strategy import key_filter
from ..sources.segmenters import SHEET_SHIFT, cell_map, pair_seq
from .checks import finding

MATCH_CLASSES = ["translated", "missing", "addition", "unchanged", "modified"]
STAGES = {1: "exact", 2: "prefix", 3: "position"}


def sheets_of(cells: DataFrame) -> DataFrame:
    """Distinct (workbook_id, sheet, sheet_idx) of a cell table.  Sheets
    without cells are not in it: where a sheet list exists, use that."""
    return cells.select("workbook_id", "sheet", "sheet_idx").distinct()


def sheet_position(sheets: DataFrame, order_col: str = "ord") -> DataFrame:
    """(workbook_id, sheet, sheet_idx): the place of each sheet in its
    workbook, from 0, in the order of ``order_col``.  Sheets of a workbook are
    few: they are listed and numbered inside one row."""
    listed = sheets.select("workbook_id", F.col(order_col).alias("o"), "sheet").distinct().groupBy("workbook_id").agg(
        F.array_sort(F.collect_set(F.struct("o", "sheet"))).alias("s"))
    return listed.select("workbook_id", F.posexplode("s").alias("i", "x")).select(
        "workbook_id", "x.sheet", F.col("i").cast("bigint").alias("sheet_idx"))


def match_sheets(src_sheets: DataFrame, tgt_sheets: DataFrame) -> DataFrame:
    """Pick a target sheet for every source sheet.

    Stages, first that applies: (1) a target with the same name; (2) the
    first target, in workbook order, whose name stripped of the characters
    ``_ENJAKODFRS`` at its end equals the source name, or which starts with
    the source name; (3) the target at the same position; else none.
    Several source sheets may take the same target.

    Every stage is an *equi*-join on ``workbook_id`` plus a key — the name,
    the stripped name, each prefix of the target name (``starts with`` is
    ``source == prefix``; sheet names are short), or the position — so no
    pair of sheets is ever enumerated.  ``min(struct(stage, target_idx,
    ...))`` per source sheet then keeps the first candidate: an aggregate
    with map-side combine instead of a window.
    """
    s = src_sheets.select("workbook_id", "sheet", "sheet_idx")
    t = tgt_sheets.select("workbook_id", F.col("sheet").alias("target_sheet"),
                          F.col("sheet_idx").alias("target_idx"))
    cand_cols = ["workbook_id", "target_sheet", "target_idx"]
    keyed = [
        (1, t.select(*cand_cols, F.col("target_sheet").alias("key"))),
        (2, t.select(*cand_cols, X.strip_sheet_suffix("target_sheet").alias("key"))),
        (2, t.select(*cand_cols,
                     F.explode(F.sequence(F.lit(0), F.length("target_sheet"))).alias("k"))
         .select(*cand_cols, F.substring("target_sheet", 1, F.col("k")).alias("key"))),
    ]
    # all name keys of the targets in one table: one join for stages 1 and 2
    keys = None
    for stage, k in keyed:
        k = k.withColumn("stage", F.lit(stage))
        keys = k if keys is None else keys.unionByName(k)
    cands = s.join(keys, (s["workbook_id"] == keys["workbook_id"]) & (s["sheet"] == keys["key"])) \
        .select(s["workbook_id"], s["sheet"], keys["stage"], keys["target_idx"],
                keys["target_sheet"])
    by_pos = s.join(t, (s["workbook_id"] == t["workbook_id"]) & (s["sheet_idx"] == t["target_idx"])) \
        .select(s["workbook_id"], s["sheet"], F.lit(3).alias("stage"), t["target_idx"],
                t["target_sheet"])
    cands = cands.unionByName(by_pos)
    best = (cands.groupBy("workbook_id", "sheet")
            .agg(F.min(F.struct("stage", "target_idx", "target_sheet")).alias("b"))
            .select("workbook_id", "sheet",
                    F.col("b.target_sheet").alias("target_sheet"),
                    F.col("b.target_idx").cast("bigint").alias("target_idx"),
                    F.col("b.stage").alias("stage_no")))
    stage = None
    for no, label in STAGES.items():
        stage = (F.when(F.col("stage_no") == no, label) if stage is None
                 else stage.when(F.col("stage_no") == no, label))
    return (s.join(best, ["workbook_id", "sheet"], "left")
            .select("workbook_id", "sheet", F.col("sheet_idx").cast("bigint").alias("sheet_idx"),
                    "target_sheet", "target_idx", stage.alias("stage")))


def missing_sheets(sheet_map: DataFrame) -> DataFrame:
    """Source sheets without any target (the anti-join outcome of the map)."""
    return sheet_map.filter(F.col("target_sheet").isNull())


def classify(source, target):
    sv, tv = X.col_(source), X.col_(target)
    cj = X.has_cjk(sv)
    both = sv.isNotNull() & tv.isNotNull()
    return (F.when(both & cj, "translated")
            .when(sv.isNotNull() & cj & tv.isNull(), "missing")
            .when(sv.isNull() & tv.isNotNull(), "addition")
            .when(both & (sv == tv), "unchanged")
            .otherwise("modified"))


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """translated / missing / addition / unchanged / modified, tested in that
    order (identical Chinese on both sides is ``translated``; a non-Chinese
    source without target is ``modified``)."""
    return pairs.withColumn("match", classify("source", "target"))


def align_cells(src_cells: DataFrame, tgt_cells: DataFrame, sheet_map: DataFrame) -> DataFrame:
    """Full outer join of source and target cells of every matched sheet.

    ``sheet_map`` should already be broadcast-wrapped (``checked_broadcast``)
    when small; the map is joined to both sides before the full outer join so
    that a target sheet shared by two source sheets pairs with each of them.
    """
    m = sheet_map.filter(F.col("target_sheet").isNotNull()) \
        .select("workbook_id", "sheet", "sheet_idx", "target_sheet")
    src = (cell_map(src_cells)
           .select("workbook_id", "sheet", "row_no", "col_no", F.col("value").alias("source"))
           .join(m, ["workbook_id", "sheet"]))
    tgt = (cell_map(tgt_cells)
           .select("workbook_id", F.col("sheet").alias("target_sheet"), "row_no", "col_no",
                   F.col("value").alias("target"))
           .join(m, ["workbook_id", "target_sheet"]))
    key = ["workbook_id", "sheet", "sheet_idx", "target_sheet", "row_no", "col_no"]
    pairs = src.join(tgt, key, "full_outer")
    return classify_pairs(pairs.select(
        *key,
        X.a1_coordinate("col_no", "row_no").alias("coordinate"),
        "source", "target",
        pair_seq("sheet_idx", "col_no", "row_no").alias("pair_seq")))


# --------------------------------------------------------------------------
# findings
# --------------------------------------------------------------------------

def omission_findings(pairs: DataFrame) -> DataFrame:
    """漏译 / P1 for every ``missing`` pair."""
    p = pairs.filter(F.col("match") == "missing")
    desc = X.render(C.MESSAGES["omission"], text=X.truncate_text("source", C.CUT_PAIR))
    return finding(p, detector="omission", dimension=C.DIM_OMISSION, severity="P1",
                   doc_id="workbook_id", location=X.loc_cell("sheet", "coordinate"),
                   description=desc, seq="pair_seq")


def addition_findings(pairs: DataFrame) -> DataFrame:
    """增译 / P2 for ``addition`` pairs whose target is longer than 3."""
    p = pairs.filter((F.col("match") == "addition")
                     & (F.length("target") > C.ADDITION_MIN_LEN))
    desc = X.render(C.MESSAGES["addition"], text=X.truncate_text("target", C.CUT_PAIR))
    return finding(p, detector="addition", dimension=C.DIM_ADDITION, severity="P2",
                   doc_id="workbook_id", location=X.loc_cell("sheet", "coordinate"),
                   description=desc, seq="pair_seq")


def unpicked_target_findings(tgt_cells: DataFrame, sheet_map: DataFrame) -> DataFrame:
    """Optional (off by default): 增译 / P2 for the non-blank cells, longer
    than 3, of target sheets that no source sheet picked — by default such
    sheets are ignored.  A left anti join on (workbook_id, sheet)."""
    picked = sheet_map.filter(F.col("target_sheet").isNotNull()) \
        .select("workbook_id", F.col("target_sheet").alias("sheet")).distinct()
    cells = cell_map(tgt_cells).join(picked, ["workbook_id", "sheet"], "left_anti") \
        .filter(F.length("value") > C.ADDITION_MIN_LEN)
    coord = X.a1_coordinate("col_no", "row_no")
    desc = X.render(C.MESSAGES["addition"], text=X.truncate_text("value", C.CUT_PAIR))
    return finding(cells, detector="unpicked_target", dimension=C.DIM_ADDITION, severity="P2",
                   doc_id="workbook_id", location=X.loc_cell("sheet", coord), description=desc,
                   seq=F.lit(1 << 62) + pair_seq("sheet_idx", "col_no", "row_no"))


def missing_sheet_findings(sheet_map: DataFrame) -> DataFrame:
    """漏翻 / P1 for every source sheet without a target."""
    p = missing_sheets(sheet_map)
    desc = X.render(C.MESSAGES["missing_sheet"], sheet="sheet")
    return finding(p, detector="missing_sheet", dimension=C.DIM_MISSING, severity="P1",
                   doc_id="workbook_id", location=X.loc_sheet("sheet"), description=desc,
                   seq=F.col("sheet_idx") * F.lit(1 << SHEET_SHIFT))


# --------------------------------------------------------------------------
# consistency
# --------------------------------------------------------------------------

def cjk_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("source").isNotNull() & X.has_cjk("source"))


def distinct_translations(pairs: DataFrame) -> DataFrame:
    """(workbook_id, source, target) with occurrence count and first position;
    NULL targets kept as their own row (they count as occurrences only)."""
    return (cjk_pairs(pairs).groupBy("workbook_id", "source", "target")
            .agg(F.count(F.lit(1)).alias("n"), F.min("pair_seq").alias("first_seq")))


def consistency_counts(pairs: DataFrame) -> DataFrame:
    """One row per distinct CJK source: occurrences, number of distinct
    non-NULL translations, first position.

    Two-level aggregation: (source, target) first, with map-side combine, so a
    boilerplate source repeated millions of times reaches the second level as
    one row per distinct translation.  Counts only; nothing is collected.
    """
    return _by_source(distinct_translations(pairs))


def _by_source(translations: DataFrame, *more) -> DataFrame:
    return translations.groupBy("workbook_id", "source").agg(
        F.sum("n").cast("bigint").alias("occurrences"),
        F.count("target").cast("bigint").alias("n_translations"),
        F.min("first_seq").alias("first_seq"), *more)


def consistency_issues(pairs: DataFrame) -> DataFrame:
    """CJK sources with more than one distinct non-NULL translation, and these
    as a sorted list: the finding's message holds them all.  The pairs are
    aggregated once; the list of a source that is no issue has one entry."""
    return _by_source(distinct_translations(pairs), F.array_sort(F.collect_list("target")).alias("translations")).where(
        "n_translations > 1")


def of_issues(pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """The CJK pairs that may belong to an issue (see ``strategy.key_filter``)."""
    return key_filter(cjk_pairs(pairs), issues, ["workbook_id", "source"])


def first_coordinates(pairs: DataFrame, k: int = C.CAP_COORDINATES,
                      qualified: bool = False, issues: DataFrame | None = None) -> DataFrame:
    """First ``k`` coordinates (pair order) of every CJK source, joined with
    ', '; with ``issues``, of the sources of these (and few others) only.
    ``row_number() <= k`` plans as a partial WindowGroupLimit below the
    shuffle, so at most k rows per source leave each map task."""
    p = cjk_pairs(pairs) if issues is None else of_issues(pairs, issues)
    coord = X.loc_cell("sheet", "coordinate") if qualified else F.col("coordinate")
    w = Window.partitionBy("workbook_id", "source").orderBy("pair_seq")
    top = (p.select("workbook_id", "source", "pair_seq", coord.alias("c"))
           .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k))
    return (top.groupBy("workbook_id", "source")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair_seq", "c"))),
                                          lambda x: x["c"]), ", ").alias("coordinates")))


def issue_translations(pairs: DataFrame) -> DataFrame:
    """The translations of the inconsistent sources as flat rows:
    (workbook_id, source, target, n, first_seq)."""
    known = distinct_translations(pairs)
    issues = _by_source(known).where("n_translations > 1")
    return known.where(F.col("target").isNotNull()).join(
        issues.select("workbook_id", "source"), ["workbook_id", "source"], "left_semi")


def issue_occurrences(pairs: DataFrame) -> DataFrame:
    """Every place of the inconsistent sources: (workbook_id, source, sheet,
    coordinate, target, pair_seq), a missing target included."""
    issues = consistency_counts(pairs).where("n_translations > 1").select("workbook_id", "source")
    return of_issues(pairs, issues).select("workbook_id", "source", "sheet", "coordinate", "target", "pair_seq").join(
        issues, ["workbook_id", "source"], "left_semi")


def consistency_findings(pairs: DataFrame, qualified_location: bool = False) -> DataFrame:
    """一致性: P1 when translated more than two ways, else P2; location lists
    the first five coordinates; description quotes the source cut at 30."""
    issues = consistency_issues(pairs).drop("occurrences")
    coords = first_coordinates(pairs, qualified=qualified_location, issues=issues)
    j = issues.join(coords, ["workbook_id", "source"])
    k = F.col("n_translations")
    desc = X.render(C.MESSAGES["consistency"],
                    text=X.truncate_text("source", C.CUT_CONSISTENCY), k=k,
                    translations=X.list_repr("translations"))
    return finding(j, detector="consistency", dimension=C.DIM_CONSISTENCY,
                   severity=F.when(k > 2, "P1").otherwise("P2"),
                   doc_id="workbook_id", location="coordinates", description=desc,
                   seq="first_seq", phase=1)


def _every_workbook(counts: DataFrame, workbooks: DataFrame | None) -> DataFrame:
    """``counts`` with a row of zeros for each workbook that has none."""
    if workbooks is None:
        return counts
    names = [c for c in counts.columns if c != "workbook_id"]
    return workbooks.select("workbook_id").distinct().join(counts, "workbook_id", "left").select(
        "workbook_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names])


def consistency_totals(pairs: DataFrame, workbooks: DataFrame | None = None) -> DataFrame:
    """Per workbook: distinct CJK sources (singletons too) and issue count,
    from counts alone; with ``workbooks``, those without pairs too."""
    return _every_workbook(
        consistency_counts(pairs).groupBy("workbook_id")
        .agg(F.count(F.lit(1)).alias("total_unique"),
             F.count_if(F.col("n_translations") > 1).alias("issues")), workbooks)


# --------------------------------------------------------------------------
# statistics
# --------------------------------------------------------------------------

def match_stats(pairs: DataFrame) -> DataFrame:
    """Pairs per match class, per sheet and per workbook (``sheet`` NULL).
    The workbook level is summed from the (tiny) sheet level: one pass."""
    per_sheet = (pairs.groupBy("workbook_id", "sheet", "match")
                 .agg(F.count(F.lit(1)).alias("n")))
    total = (per_sheet.groupBy("workbook_id", "match")
             .agg(F.sum("n").cast("bigint").alias("n"))
             .select("workbook_id", F.lit(None).cast("string").alias("sheet"), "match", "n"))
    return per_sheet.unionByName(total)


def sheet_alignment(pairs: DataFrame, sheet_map: DataFrame) -> DataFrame:
    """One row per matched source sheet: target name, pair and class counts."""
    counts = pairs.groupBy("workbook_id", "sheet").agg(
        F.count(F.lit(1)).alias("pairs"),
        *[F.count_if(F.col("match") == m).alias(m) for m in MATCH_CLASSES])
    m = sheet_map.filter(F.col("target_sheet").isNotNull())
    out = m.join(counts, ["workbook_id", "sheet"], "left")
    return out.select("workbook_id", "sheet", "sheet_idx", "target_sheet", "stage",
                      *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                        for c in ["pairs"] + MATCH_CLASSES])


def pair_totals(pairs: DataFrame, findings: DataFrame, workbooks: DataFrame | None = None) -> DataFrame:
    """Total pairs and findings per workbook: of every workbook that has one
    or the other and, with ``workbooks``, of all others too."""
    p = pairs.select("workbook_id", F.lit(1).alias("p"), F.lit(0).alias("f"))
    f = findings.select(F.col("doc_id").alias("workbook_id"), F.lit(0).alias("p"), F.lit(1).alias("f"))
    return _every_workbook(p.unionByName(f).groupBy("workbook_id").agg(
        F.sum("p").cast("bigint").alias("total_pairs"), F.sum("f").cast("bigint").alias("total_findings")), workbooks)


def coord_union(src_cells: DataFrame, tgt_cells: DataFrame, sheet_map: DataFrame) -> DataFrame:
    """Distinct coordinates of both sides of every matched sheet, under the
    source sheet's name (stand-alone form of what the full outer join of
    ``align_cells`` does implicitly)."""
    m = sheet_map.filter(F.col("target_sheet").isNotNull()).select("workbook_id", "sheet", "target_sheet")
    a = cell_map(src_cells).select("workbook_id", "sheet", "row_no", "col_no").join(
        m.select("workbook_id", "sheet"), ["workbook_id", "sheet"], "left_semi")
    b = cell_map(tgt_cells).select("workbook_id", F.col("sheet").alias("target_sheet"), "row_no", "col_no").join(
        m, ["workbook_id", "target_sheet"]).select("workbook_id", "sheet", "row_no", "col_no")
    return a.union(b).distinct()
