import hashlib
import math
import re
from collections import defaultdict

from fixtures import DOCS, SF, docs, given, same, with_extra
from hypothesis import given as some
from hypothesis import settings
from hypothesis import strategies as st
from polyglint.llm import sanitize
from polyglint.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    """The contract's patterns, applied as they stand."""
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


@settings(max_examples=500, deadline=None)
@some(st.text(alphabet="ab@@..+-%_ 0123456789()é\n", max_size=60))
def test_base_spans_are_the_patterns_matches(text):
    assert sanitize.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1(" * 60_000):
        sanitize.base_spans(t)


def expected(data):
    """Spans by counting terms and entities in distinct texts."""
    texts = {t or "" for _, t, *_ in data}
    has, near = defaultdict(set), defaultdict(set)
    for t in texts:
        s = plain(t)
        for k, spans in s.items():
            for a, b in spans:
                has[sanitize.entity(k, t[a:b])].add(t)
        for e, term, _, _ in sanitize.context_terms(t, s):
            near[e, term].add(t)
    words = {t: {w.lower() for w in re.findall(r"[^\W_]+", t)} for t in texts}
    n, out = len(texts), []
    act = {}
    for (e, term), where in near.items():
        if len(where) >= 3 and len(has[e]) < n:
            n_t = max(len(where), sum(term in words[t] for t in texts))
            share = math.log2(len(where) * n / (len(has[e]) * n_t)) / math.log2(n / len(has[e]))
            if share >= 0.7:
                act[e, term] = "removed" if share >= 0.9 else "generalised"
    for i, t, *_ in data:
        t = t or ""
        s = plain(t)
        base = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in s[k])
        extra = {}
        for e, term, a, b in sanitize.context_terms(t, s):
            if (e, term) in act:
                extra[a, b] = max(extra.get((a, b), ""), act[e, term])
        more = ",".join(f"{k}:{a}:{b}" for k in ("removed", "generalised") for (a, b), x in sorted(extra.items()) if x == k)
        out.append((i, *(len(s[k]) for k in PATTERNS), hashlib.sha256(base.encode()).hexdigest(),
                    ",".join(x for x in (base, more) if x)))
    return out


def disclosing():
    """An address that always stands with one name, among other prose."""
    data = [(i, f"note {i} from Zorblax the boss at boss@corp.example.com about {w} things", "en", "a", 0)
            for i, w in enumerate(["many", "few", "some", "odd"])]
    data += [(10 + i, f"plain text number {i} about the things we do, call +1 (555) 010-{1000 + i} the boss", "en", "a", 0)
             for i in range(40)]
    return data


def cols(df):
    return df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()


def test_terms_that_disclose(spark):
    data = disclosing()
    got = cols(sanitize.find(docs(spark, data)))
    same(got, expected(data))
    assert all("removed:" in r.spans for r in got if r.doc_id < 4)
    assert all("removed:" not in r.spans for r in got if r.doc_id >= 10)
    masked = {r.doc_id: r for r in sanitize.sanitise(docs(spark, data)).collect()}
    assert "Zorblax" not in masked[0].text and "[EMAIL]" in masked[0].text and "[PHONE]" in masked[11].text
    assert masked[0].n_chars == len(masked[0].text)


def test_awkward_rows_and_query(spark):
    df = docs(spark)
    data = [tuple(r) for r in df.collect()]
    same(cols(sanitize.find(with_extra(df))), expected(data))
    clean = sanitize.sanitise(with_extra(df))
    assert clean.columns == with_extra(df).columns
    untouched = [r for r in data if not any(plain(r[1] or "").values())]
    kept = [tuple(r)[:5] for r in clean.collect()]
    assert len(kept) == len(data) and all(r in kept for r in untouched)
    same(cols(QUERIES["op3_personal_data"](spark, SF)), expected([(r.doc_id, r.text) for r in given(spark).collect()]))
    assert sanitize.find(df.limit(0)).count() == 0 and sanitize.sanitise(df.limit(0)).count() == 0


def test_terms_far_from_the_entity(spark):
    """A disclosing name goes wherever it stands in a text with the entity."""
    far = " ".join(f"of{k}" for k in range(20))
    data = [(i, f"Zorblax the boss at boss@corp.example.com {far} Zorblax said {w}; {far} Quuxly too", "en", "a", 0)
            for i, w in enumerate(["many", "few", "some", "odd"])]
    data += [(10 + i, f"plain text number {i} about the boss {far}", "en", "a", 0) for i in range(40)]
    same(cols(sanitize.find(docs(spark, data))), expected(data))
    masked = {r.doc_id: r.text for r in sanitize.sanitise(docs(spark, data)).collect()}
    assert all("Zorblax" not in masked[i] and "Quuxly" not in masked[i] and "of7" in masked[i] for i in range(4))
    assert masked[10] == data[4][1]


def test_terms_that_disclose_a_class(spark):
    """Every address stands in one text, but those of a domain with one name."""
    data = [(i, f"{w} from Zorblax to p{i}q@corp.example.com", "en", "a", 0) for i, w in enumerate(["many", "few", "odd"] * 2)]
    data += [(10 + i, f"Kremlor {w} asks 10.{20 + i}.0.{i} things", "en", "a", 0) for i, w in enumerate(["many", "few", "odd"])]
    data += [(20 + i, f"Vexil {w} calls +1 (777) {100 + i}-1234 things", "en", "a", 0) for i, w in enumerate(["many", "few", "odd"])]
    data += [(30 + i, f"plain text number {i} many few odd from things asks calls", "en", "a", 0) for i in range(40)]
    data += data[:2]                # copies count once
    got = {r.doc_id: r.text for r in sanitize.sanitise(docs(spark, data)).collect()}
    assert all("Zorblax" not in got[i] and "from" in got[i] for i in range(6))
    assert all("Kremlor" not in got[10 + i] and "things" in got[10 + i] for i in range(3))
    assert all("Vexil" not in got[20 + i] and "calls" in got[20 + i] for i in range(3))
    rows = sanitize.find(docs(spark, data)).collect()
    assert all((r.n_terms > 0) == (r.doc_id < 30) for r in rows)
    found = sanitize.find_base(docs(spark, data))
    counts = {r.term: r.n_t for r in sanitize.term_counts(found, docs(spark, data)).collect()}
    assert counts["zorblax"] == 6 and counts["from"] == 46 and counts["plain"] == 40


def test_classes():
    assert sanitize.classes("email", "Jan.Kowalski7@Corp.example.com") == {
        "email", "email@corp.example.com", "email~jan", "email~kowalski"}
    assert sanitize.classes("ip", "10.020.3.4") == {"ip", "ip/10", "ip/10.20", "ip/10.20.3"}
    assert sanitize.classes("phone", "+1 (555) 010-1000") == {"phone", "phone/1555", "phone/1555010"}


def test_only_texts_with_terms_move(spark):
    """Texts that have no disclosing term are masked where they stand."""
    data = [(i, f"Zorblax the boss at boss@corp.example.com said {w}", "en", "a", 0) for i, w in enumerate(["many", "few", "odd"])]
    data += [(10 + i, f"plain text number {i} to p{i}q@corp{i}.example.com", "en", "a", 0) for i in range(40)]
    clean = sanitize.sanitise(docs(spark, data).where("doc_id >= 0"))
    plan = clean._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan
    got = {r.doc_id: r.text for r in clean.collect()}
    assert len(got) == 43 and all("Zorblax" not in got[i] for i in range(3))
    assert got[10] == "plain text number 0 to [EMAIL]"
