"""Conversation structure repair: weighted CYK parsing over intervals of turns.

A conversation is repaired to the role initials ``(s?(ua)+)?`` by the cheapest
edits: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty user or
assistant turn 5; a truncated turn that stays adds 5, a blank or repeated one
must go.

The repair grammar is in Chomsky normal form.  Its nonterminals X(p, q) are the
pairs of states of that language: START, S (behind a system turn), U (behind a
user turn, an assistant due), A (behind an assistant turn).  X(p, q) derives the
spans that lead from p to q, by X(p, q) -> X(p, r) X(r, q) or, for a span of one
turn, by an edit of it.  The insertion closure, what insertions alone lead from p
to q, is on both sides of each turn's cell.  A cell of the chart holds the least
(cost, audit) for each nonterminal, the audit being the edits' initials.

Nonterminals tell all that a span's neighbours need, and of two audits of one
span and cost neither begins the other (they would differ in insertions alone,
which cost), so that least cells combine to least cells at any split.  One split
a span is therefore enough: spans combine bottom-up in lengths 1, 2, 4 ..., and
a long conversation is parsed in pieces on several tasks whose cells combine.

As many edited turns as the audit keeps fix the roles of the result: it begins
with a system turn if their number is odd.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, map_arrow, slices, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\f\r"
FINE, CUT, GONE = 0, 1, 2          # states of a turn: as it should be, truncated, to be deleted

START, S, U, A = range(4)
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ACCEPTED = (START, A)

Cell = dict                         # (p, q) -> (cost, audit)


# --------------------------------------------------------------------------
# cells
# --------------------------------------------------------------------------

def better(cell: Cell, key: tuple[int, int], value: tuple[int, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans: X(p, q) -> X(p, r) X(r, q)."""
    by_start: dict[int, list] = {}
    for (r, q), value in right.items():
        by_start.setdefault(r, []).append((q, value))
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q, (more, rest) in by_start.get(r, ()):
            known = out.get((p, q))
            if known is None or cost + more < known[0] or (cost + more == known[0] and audit + rest < known[1]):
                out[p, q] = (cost + more, audit + rest)
    return out


def closure() -> Cell:
    """Insertions alone: the shortest way from each state to each other."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    step: Cell = {(p, q): (INSERT, "I") for (p, c), q in NEXT.items() if c != "s"}
    for _ in range(3):
        for key, value in combined(cell, step).items():
            better(cell, key, value)
    return cell


INSERTED = closure()


def turn_cell(initial: str, state: int) -> Cell:
    """The cell of one turn, the insertion closure on both sides."""
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if state != GONE:
        extra = TRUNCATED if state == CUT else 0
        for (p, c), q in NEXT.items():
            if c == initial:
                better(edits, (p, q), (KEEP + extra, "K"))
            if c != "s":
                better(edits, (p, q), (REROLE + extra, "R"))
    return combined(combined(INSERTED, edits), INSERTED)


_TURNS: dict[tuple[str, int], Cell] = {}


def leaf(initial: str, state: int) -> Cell:
    initial = initial if initial in ("s", "u", "a") else ""
    if (initial, state) not in _TURNS:
        _TURNS[initial, state] = turn_cell(initial, state)
    return _TURNS[initial, state]


class Chart:
    """The open spans of a conversation read turn by turn: lengths are powers of
    two that fall from left to right; two of a length become one of twice it."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cell]] = []

    def append(self, cell: Cell, size: int = 1) -> None:
        self.spans.append((size, cell))
        while len(self.spans) > 1 and self.spans[-2][0] <= self.spans[-1][0]:
            (m, left), (n, right) = self.spans[-2:]
            self.spans[-2:] = [(m + n, combined(left, right))]

    def repeat(self, cell: Cell, times: int) -> None:
        """``times`` turns with this cell, by doubling."""
        powers = [cell]
        while 2 << (len(powers) - 1) <= times:
            powers.append(combined(powers[-1], powers[-1]))
        for k in range(len(powers) - 1, -1, -1):
            if times >> k & 1:
                self.append(powers[k], 1 << k)

    def cell(self) -> Cell:
        out = None
        for _, span in reversed(self.spans):
            out = span if out is None else combined(span, out)
        return INSERTED if out is None else out


# --------------------------------------------------------------------------
# runs: pieces of conversations that one task reads in order
# --------------------------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, tie, key): nulls in role and text are one space;
    ``tie`` tells different rows of a turn apart and orders them, ``key`` tells
    different rows of the table apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    digest = lambda *parts: F.md5(F.concat_ws(":", *parts).cast("binary"))
    place = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("conv_id", "turn")]
    return (conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text)
            .withColumn("tie", digest(F.length("role").cast("string"), F.col("role"), F.col("text")))
            .withColumn("key", digest(F.col("tie"), *place)))


def _state(text: Column) -> Column:
    end = F.rtrim(text, F.lit(WHITE))
    return F.when(end == "", GONE).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)


_COUNTS = ["letters", "blank", "duplicate", "truncated", "illegal", "turns"]
_RUN_FIELDS = (["run int", "place long"] + [f"{c} long" for c in _COUNTS]
               + ["first_turn long", "last_turn long", "first_initial string", "last_initial string",
                  "cell array<struct<p:int,q:int,cost:long,audit:string>>"])
_TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PLAN_FIELDS = (["run int", "place long", "before long", "system_first boolean", "part string", "head boolean", "audit string"]
                + [f"{c} long" for c in _TOTALS])


def _schema(df: DataFrame, keys: list[str], fields: list[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keys] + list(T._parse_datatype_string(", ".join(fields)).fields))


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


class Run:
    """What is known of a run so far; ``place`` is that of its first turn."""

    def __init__(self, place: int) -> None:
        self.place, self.chart, self.n = place, Chart(), dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def append(self, turn: int | None, initial: str, state: int, seen: bool, copies: int) -> None:
        n = self.n
        if state == GONE:
            n["blank"] += copies
        else:
            n["duplicate"] += copies if seen else copies - 1
            n["truncated"] += not seen and state == CUT
        n["illegal"] += copies - 1 + (self.last_initial is not None and not legal(self.last_initial, initial))
        if turn is not None and turn != self.last_turn:
            n["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.first_initial = initial if self.first_initial is None else self.first_initial
        self.last_initial = initial
        n["letters"] += copies
        self.chart.append(leaf(initial, GONE if seen else state))
        self.chart.repeat(leaf(initial, GONE), copies - 1)

    def row(self) -> dict:
        return {"place": self.place, **self.n, "first_turn": self.first_turn, "last_turn": self.last_turn,
                "first_initial": self.first_initial, "last_initial": self.last_initial,
                "cell": [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in self.chart.cell().items()]}


def read_runs(conversations: DataFrame) -> DataFrame:
    """Rows with a key: where each different row of the table stands (``run``, the
    task that read it, and ``place``, the letters of that task before it); rows
    without one: the cell and counts of each run of a conversation.

    Equal rows are one row with a count before anything but their digests is
    shuffled.  Ranges over (conv_id, turn, tie) deal a conversation of any length
    over many tasks, and a task holds a few rows and one chart."""
    slim = turns(conversations).select("conv_id", "turn", "tie", "key", F.left("role", F.lit(1)).alias("initial"),
                                       _state(F.col("text")).cast("int").alias("state"))
    same = ["conv_id", "turn", "tie", "key", "initial", "state"]
    rows = written(slim.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")), "turns")
    # a struct orders null turns first
    least = rows.groupBy("conv_id", "tie").agg(F.min(F.struct("turn")).alias("least")).select(
        F.col("conv_id").alias("c"), F.col("tie").alias("t"), "least")
    known = rows.join(least, rows["conv_id"].eqNullSafe(F.col("c")) & (rows["tie"] == F.col("t"))).select(
        *rows.columns, (~F.col("turn").eqNullSafe(F.col("least.turn"))).alias("seen"))
    order = ["conv_id", "turn", "tie"]
    schema = _schema(known, ["conv_id", "key"], _RUN_FIELDS)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, run, place, arrow = TaskContext.get().partitionId(), None, None, 0, None
        for batch in slices(it):
            arrow, out = arrow or to_arrow_schema(schema), []
            for r in batch.to_pylist():
                if run is None or r["conv_id"] != conv:
                    if run is not None:
                        out.append({"conv_id": conv, "run": part, **run.row()})
                    conv, run = r["conv_id"], Run(place)
                out.append({"conv_id": conv, "key": r["key"], "run": part, "place": place})
                run.append(r["turn"], r["initial"], r["state"], r["seen"], r["copies"])
                place += r["copies"]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if run is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "run": part, **run.row()}], schema=arrow)

    return written(map_arrow(known.repartitionByRange(*order).sortWithinPartitions(*order), task, schema), "turn-runs")


# --------------------------------------------------------------------------
# runs of a conversation together
# --------------------------------------------------------------------------

def settle(runs: list[dict]) -> list[dict]:
    """The part of the audit of each run of one conversation, in order, and what
    the conversation counts, in the row of its first run (the head)."""
    chart = Chart()
    for r in runs:
        chart.append({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in r["cell"]}, r["letters"])
    cell = chart.cell()
    cost, audit = min(cell[START, q] for q in ACCEPTED)
    total = {c: sum(r[c] for r in runs) for c in _COUNTS}
    last_turn = last_initial = None
    for r in runs:
        total["illegal"] += last_initial is not None and not legal(last_initial, r["first_initial"])
        if r["first_turn"] is not None:
            total["turns"] -= r["first_turn"] == last_turn
            last_turn = r["last_turn"]
        last_initial = r["last_initial"]
    first_turn = next((r["first_turn"] for r in runs if r["first_turn"] is not None), None)
    total["gaps"] = 0 if first_turn is None else last_turn - first_turn + 1 - total["turns"]
    total["cost"] = cost
    kept, out, at, before = len(audit) - audit.count("D"), [], 0, 0
    for k, r in enumerate(runs):
        # a run's part ends with its last turn; insertions behind that are the next run's
        end, letters = at, 0
        while letters < r["letters"] or (k + 1 == len(runs) and end < len(audit)):
            letters += audit[end] != "I"
            end += 1
        part = audit[at:end]
        out.append({"run": r["run"], "place": r["place"], "before": before, "system_first": kept % 2 == 1, "part": part,
                    "head": k == 0, "audit": audit if k == 0 else None, **{c: total[c] for c in _TOTALS}})
        before += len(part) - part.count("D")
        at = end
    return out


def plan(placed: DataFrame) -> DataFrame:
    """One row for each run: its part of the audit, and where its part of the
    result begins.  A conversation has one run for each task that read it; they
    meet in one task as cells, together as long as a few of its audits."""
    runs = placed.where(F.col("key").isNull()).drop("key").repartition("conv_id").sortWithinPartitions("conv_id", "run")
    schema = _schema(placed, ["conv_id"], _PLAN_FIELDS)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held = to_arrow_schema(schema), []
        for batch in slices(it):
            for r in batch.to_pylist():
                if held and r["conv_id"] != held[0]["conv_id"]:
                    yield pa.RecordBatch.from_pylist([{"conv_id": held[0]["conv_id"], **p} for p in settle(held)], schema=arrow)
                    held = []
                held.append(r)
        if held:
            yield pa.RecordBatch.from_pylist([{"conv_id": held[0]["conv_id"], **p} for p in settle(held)], schema=arrow)

    return written(map_arrow(runs, task, schema), "turn-plan")


def _edits(planned: DataFrame) -> DataFrame:
    """One row for each turn of the result: (run, place) of the turn it comes from
    (place null where inserted), position, edit and the initial due there."""
    schema = _schema(planned, ["conv_id", "run"], ["place long", "position long", "edit string", "due string"])

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in it:
            out = []
            for r in batch.to_pylist():
                place, position = r["place"], r["before"]
                for edit in r["part"]:
                    if edit != "D":
                        due = "s" if r["system_first"] and position == 0 else "u" if position % 2 == r["system_first"] else "a"
                        out.append({"conv_id": r["conv_id"], "run": r["run"], "place": None if edit == "I" else place,
                                    "position": position, "edit": edit, "due": due})
                        position += 1
                    place += edit != "I"
                    if len(out) >= SLICE_ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return map_arrow(planned.select("conv_id", "run", "place", "before", "system_first", "part"), task, schema)


def _repaired(conversations: DataFrame, placed: DataFrame, planned: DataFrame) -> DataFrame:
    edits = _edits(planned)
    rows = placed.where(F.col("key").isNotNull()).select("run", "place", "key")
    # equal rows of a turn are one, of which at most one stays
    texts = turns(conversations).select("key", "turn", "role", "text").dropDuplicates(["key"])
    kept = edits.where(F.col("place").isNotNull()).join(rows, ["run", "place"]).join(texts, "key")
    due = F.when(F.col("due") == "u", "user").otherwise("assistant")
    stay = kept.select("conv_id", "position", "edit", F.when(F.col("edit") == "R", due).otherwise(F.col("role")).alias("role"), "text", "turn")
    new = edits.where(F.col("place").isNull()).select(
        "conv_id", "position", "edit", due.alias("role"), F.lit("").alias("text"), F.lit(None).cast("long").alias("turn"))
    return stay.unionByName(new)


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I),
    role, text, and the turn it comes from (null where inserted).

    Turns go by ``turn``, nulls first, and different rows of one turn by a digest
    of role and text.  A null id is a conversation, null roles and texts are one
    space.  A row without a character other than white space is blank, one whose
    role and text came before (equal rows of the same turn too) repeated: these
    go.  A role is known by its first character; one of no or another initial
    can't stay as it is.  Conversations without a turn that stays have no rows.
    Columns other than conv_id, turn, role and text are left out.  An empty table
    gives an empty result."""
    placed = read_runs(conversations)
    return _repaired(conversations, placed, plan(placed))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): hash of the lines ``role:text``, read in order
    and never held."""
    rows = repaired.select("conv_id", "position", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    schema = _schema(repaired, ["conv_id"], ["repaired_sha256 string"])

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, conv, sha = to_arrow_schema(schema), None, None
        for batch in slices(it):
            out = []
            for r in batch.to_pylist():
                if r["position"] == 0:
                    if sha is not None:
                        out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                    conv, sha = r["conv_id"], hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{r['role']}:{r['text']}".encode())
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if sha is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": sha.hexdigest()}], schema=arrow)

    return map_arrow(rows, task, schema)


def audit(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of the table: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    placed = read_runs(conversations)
    planned = plan(placed)
    heads = planned.where("head").select("conv_id", *_TOTALS, "audit")
    hashes = digests(_repaired(conversations, placed, planned)).withColumnRenamed("conv_id", "c")
    return heads.join(hashes, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


# --------------------------------------------------------------------------
# planted damage
# --------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties
    its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes it a user's; nulls
    are one space, in the checksum too."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("case") == 3, 2).otherwise(1)))
    return (conversations.withColumn("case", case).where(F.col("case") != 0)
            .select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(spaced("role")).alias("role"),
                    text.alias("text"), times.alias("copy")).drop("copy"))


def damage_and_audit(conversations: DataFrame) -> DataFrame:
    """``audit`` of the damaged rows, with a row for every conversation there was:
    zeros, an empty audit and the hash of nothing where no row is left."""
    own = conversations.select("conv_id", "turn", "role", "text")
    found = audit(damaged(own)).withColumnRenamed("conv_id", "c")
    return own.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _TOTALS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def oracle() -> str:
    """DuckDB SQL of ``damage_and_audit`` over ``conversations``: turn by turn from
    left to right, a value for each state, written as cost (12 digits) and audit."""
    def plus(v: str, cost: str, letters: str) -> str:
        return (f"CASE WHEN {v} IS NOT NULL THEN lpad((left({v}, 12)::BIGINT + ({cost}))::VARCHAR, 12, '0') "
                f"|| substr({v}, 13) || '{letters}' END")

    def inserted(v: list[str]) -> str:
        to_u = f"least({v[2]}, {', '.join(plus(v[k], '5', 'I') for k in (0, 1, 3))})"
        to_a = f"least({v[3]}, {plus(v[2], '5', 'I')}, {plus(v[0], '10', 'II')}, {plus(v[1], '10', 'II')})"
        return f"{v[0]} AS v0, {v[1]} AS v1, {to_u} AS v2, {to_a} AS v3"

    stays = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    can = "fault NOT IN ('blank', 'duplicate')"
    before_u, before_a = "least(v0, v1, v3)", "v2"

    def edited(own: str, source: str, initial: str) -> str:
        keep = f"CASE WHEN {can} AND left(role, 1) = '{initial}' THEN {plus(source, stays, 'K')} END"
        rerole = f"CASE WHEN {can} THEN {plus(source, '1 + ' + stays, 'R')} END"
        return f"least({plus(own, '2', 'D')}, {keep}{'' if initial == 's' else ', ' + rerole})"

    return f"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT range, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT b, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
cased AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
             lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS k
  FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM cased WHERE k <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(len(role) || ':' || role || ':' || text), copy) AS i
  FROM damaged),
faulty AS (
  SELECT *, CASE WHEN rtrim(text, E' \t\n\x0b\f\r') = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(rtrim(text, E' \t\n\x0b\f\r'), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         CASE WHEN i > 1 AND left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au')
              THEN 1 ELSE 0 END AS illegal
  FROM ordered),
parsed(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, 0::BIGINT, {inserted(["lpad('0', 12, '0')", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR"])}
  FROM (SELECT DISTINCT conv_id FROM faulty)
  UNION ALL
  SELECT conv_id, i, {inserted(["n0", "n1", "n2", "n3"])} FROM (
    SELECT f.conv_id, f.i, {plus("v0", "2", "D")} AS n0, {edited("v1", "v0", "s")} AS n1,
           {edited("v2", before_u, "u")} AS n2, {edited("v3", before_a, "a")} AS n3
    FROM parsed p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)),
best AS (
  SELECT conv_id, least(v0, v3) AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM parsed) WHERE back = 1),
letters AS (
  SELECT conv_id, j, substr(audit, j, 1) AS letter, len(audit) - len(replace(audit, 'D', '')) AS gone, len(audit) AS n,
         len(replace(left(audit, j), 'I', '')) AS i, len(replace(left(audit, j), 'D', '')) - 1 AS position
  FROM (SELECT conv_id, substr(v, 13) AS audit, unnest(range(1, len(v) - 11)) AS j FROM best)),
lines AS (
  SELECT l.conv_id, position,
         CASE WHEN letter = 'K' THEN f.role WHEN position % 2 = (n - gone) % 2 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END AS line
  FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i
  WHERE letter <> 'D'),
hashed AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY position)) AS h FROM lines GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, sum(illegal) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(left(v, 12)::BIGINT, 0) AS cost, coalesce(substr(v, 13), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
"""
