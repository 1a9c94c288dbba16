import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from fixtures import given, with_extra
from polyglint.llm import turn_repair as R
from polyglint.llm.queries import ORACLE, QUERIES

ROWS = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = " \t\n\x0b\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        s = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(s.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(turns):
    """Turn by turn from left to right; ``turns`` are (initial, state)."""
    values = {"": (0, "")}                      # by the roles so far, as a state of the language

    def go(state, c):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, c))

    def put(d, state, value):
        if state is not None and (state not in d or value < d[state]):
            d[state] = value

    def grown(d):
        for _ in range(4):
            for state, (cost, audit) in list(d.items()):
                for c in "ua":
                    put(d, go(state, c), (cost + 5, audit + "I"))
        return d

    values = grown(values)
    for initial, state in turns:
        new = {}
        for at, (cost, audit) in values.items():
            put(new, at, (cost + 2, audit + "D"))
            if state != R.GONE:
                extra = 5 if state == R.CUT else 0
                put(new, go(at, initial), (cost + extra, audit + "K"))
                for c in "ua":
                    put(new, go(at, c), (cost + 1 + extra, audit + "R"))
        values = grown(new)
    return min(values[s] for s in ("", "a") if s in values)


def plain(rows, convs):
    out = []
    for conv in convs:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()))
        seen, turns, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            end = text.rstrip(SPACE)
            fault = ("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            turns.append((role[:1], R.CUT if fault == "truncated" else R.GONE if fault else R.FINE))
        initials = [t[0] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(turns)
        numbers = {r[1] for r in mine if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        due, lines = (["s"] if sum(c != "D" for c in audit) % 2 else []), []
        due += ["user", "assistant"] * len(audit)
        rest = iter(mine)
        for c in audit:
            row = None if c == "I" else next(rest)
            if c != "D":
                want = due[len(lines)]
                lines.append(f"{row[2]}:{row[3]}" if c == "K" else f"{want}:{'' if c == 'I' else row[3]}")
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def made(seed, convs=40):
    rnd, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "what", "", " \n", None, "Yes.", "Well? ", "long " * 300 + ".", "你好。", "ok…", "\t.\x0b"]
    for conv in [None, *range(convs)]:
        for turn in range(rnd.randint(1, 9)):
            n = rnd.choice([turn, turn, turn, None, 2])
            rows.append((conv, n, rnd.choice(["user", "assistant", "system", "user", "assistant", None, "tool", "", "User"]), rnd.choice(texts)))
    return rows + rows[:10]


def collected(df):
    return sorted((tuple(r) for r in df.select(COLS).collect()), key=repr)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.001/conversations.parquet')")
    cur = con.execute(ORACLE["op11_turn_repair"])
    names = [d[0] for d in cur.description]
    got = QUERIES["op11_turn_repair"](spark, "/root/testdata/sf0.001")
    assert got.columns == COLS and names == COLS
    assert collected(got) == sorted(cur.fetchall(), key=repr)
    data = [tuple(r) for r in given(spark, "conversations").collect()]
    assert collected(got) == sorted(plain(plain_damage(data), {r[0] for r in data}), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_awkward_rows_match_brute_force_and_sql(spark, seed):
    data = made(seed)
    df = spark.createDataFrame(data, ROWS).repartition(3)
    got = collected(R.damage_and_audit(with_extra(df)))
    assert got == sorted(plain(plain_damage(data), {r[0] for r in data}), key=repr)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert got == sorted(con.execute(R.oracle()).fetchall(), key=repr)


def test_cells_match_every_sequence_of_edits():
    def language(s):
        return re.fullmatch("(s?(ua)+)?", s) is not None

    def every(turns):
        options = []
        for initial, state in turns:
            extra = 5 if state == R.CUT else 0
            own = [(2, "D", "")]
            if state != R.GONE:
                own += [(extra, "K", initial), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
            options.append(own)
        new = [(0, "", "")] + [(5 * n, "I" * n, "".join(w)) for n in (1, 2) for w in itertools.product("ua", repeat=n)]
        best = None
        for picks in itertools.product(*options):
            for gaps in itertools.product(new, repeat=len(turns) + 1):
                parts = [gaps[0]] + [x for pair in zip(picks, gaps[1:]) for x in pair]
                cost = sum(p[0] for p in parts)
                if best is not None and cost > best[0] or not language("".join(p[2] for p in parts)):
                    continue
                value = (cost, "".join(p[1] for p in parts))
                best = value if best is None or value < best else best
        return best

    kinds = [("s", 0), ("u", 0), ("a", 0), ("t", 0), ("u", 1), ("a", 2), ("s", 1)]
    for n in (0, 1, 2):
        for turns in itertools.product(kinds, repeat=n):
            chart = R.Chart()
            for t in turns:
                chart.append(R.leaf(*t))
            cell = chart.cell()
            assert min(cell[R.START, q] for q in R.ACCEPTED) == every(turns) == cheapest(turns), turns


def test_any_split_gives_the_same_cell():
    rnd = random.Random(3)
    leaves = [R.leaf(rnd.choice("suat"), rnd.choice([0, 0, 1, 2])) for _ in range(40)]
    chart, repeated = R.Chart(), R.Chart()
    one_by_one = R.INSERTED
    for cell in leaves:
        chart.append(cell)
        one_by_one = R.combined(one_by_one, cell)
    assert chart.cell() == one_by_one
    cut = rnd.randrange(40)
    halves = R.Chart(), R.Chart()
    for k, cell in enumerate(leaves):
        halves[k >= cut].append(cell)
    assert R.combined(halves[0].cell(), halves[1].cell()) == one_by_one
    gone = R.leaf("u", R.GONE)
    repeated.repeat(gone, 37)
    plain_chart = R.Chart()
    for _ in range(37):
        plain_chart.append(gone)
    assert repeated.cell() == plain_chart.cell()


def test_hot_conversation_is_read_by_several_tasks(spark):
    """One conversation holds most rows, and one of its rows a third of them."""
    rnd = random.Random(5)
    data = [(7, t, rnd.choice(["user", "assistant"]), rnd.choice(["Yes.", f"word {t}.", f"cut {t}", ""])) for t in range(900)]
    data += [(7, 450, "user", "the same.")] * 500 + [(8, 1, "user", "a."), (8, 2, "assistant", "b.")]
    df = spark.createDataFrame(data, ROWS).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = R.read_runs(df)
        assert placed.where("key is null and conv_id = 7").count() > 2
        got = collected(R.audit(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == sorted(plain(data, {7, 8}), key=repr)


def test_repaired_rows(spark):
    data = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "There?"), (1, 4, "assistant", "Yes."),
            (2, 0, "assistant", "No start."), (3, 0, "user", "")]
    rows = R.repair(spark.createDataFrame(data, ROWS)).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in rows] == [
        (1, "K", "system", "Be kind."), (1, "K", "user", "There?"), (1, "K", "assistant", "Yes.")]   # KDDKK is before KKDDK


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], ROWS)
    assert R.damage_and_audit(empty).count() == 0 and R.repair(empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = collected(R.damage_and_audit(spark.createDataFrame([(gone, 0, "user", "x.")], ROWS)))
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
