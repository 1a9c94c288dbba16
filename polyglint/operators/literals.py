"""Large rule packs: the literal rules of a pack as one pattern.

A rule that lists whole words or phrases (``\\b(kill|attack dog)\\b``) needs no
pattern of its own.  The phrases of all such rules make one prefix trie, which
becomes one factored pattern; at each place of a text it finds the longest phrase
there, and the phrase tells the rules (those of it and of the phrases it begins
with).  The time of a pass then hardly depends on the number of rules.

Rules of other patterns, and rules one of whose phrases can begin inside another
(so that what a rule finds depends on what it found before), keep their own pass.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from ..plans.strategy import lower_bound

FACTORED_FROM = 32          # literal rules from which the trie pays
FLAGS = "(?iU)"             # Unicode case folding and word boundaries, as of single rules

_BODY = re.compile(r"\\b(?:\((?:\?:)?([^()\\]+)\)|([^()\\|]+))\\b")
_SEPARATORS = " -'&/,:"
_SIGMAS = "\u03c3\u03c2\u03a3"          # their lower case depends on the place in a word


def _simple(c: str) -> bool:
    """A word character whose cases are one character each and fold together."""
    if c == "_" or (c.isalnum() and c.lower() == c.upper() == c):
        return True
    return c.isalnum() and len(c.lower()) == len(c.upper()) == 1 and c.upper().lower() == c.lower() and c not in _SIGMAS


def phrases(body: str) -> list[str] | None:
    """The phrases of a literal rule, folded, in its order; None for other rules."""
    m = _BODY.fullmatch(body)
    if not m:
        return None
    out = (m[1] or m[2]).split("|")
    if not all(p and all(_simple(c) or c in _SEPARATORS for c in p) and p[0] not in _SEPARATORS and p[-1] not in _SEPARATORS
               for p in out):
        return None
    out = [p.upper().lower() for p in out]
    inner = [p[i:] for p in out for i in range(1, len(p)) if p[i - 1] in _SEPARATORS and p[i] not in _SEPARATORS]
    if any(rest.startswith(p) or p.startswith(rest) for rest in inner for p in out):
        return None
    return out


def trie_pattern(words: list[str]) -> str:
    """One pattern of all words, common beginnings written once, the longest first."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = []
        for c in sorted(k for k in node if k):
            text = re.escape(c)
            child = node[c]
            while len(child) == 1 and "" not in child:      # a chain is one piece
                (d, child), = child.items()
                text += re.escape(d)
            branches.append(text + written(child))
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return written(root)


@dataclass(frozen=True)
class Pack:
    """The literal rules of a pack, and the numbers of the others."""

    trie: str
    rules_of: str               # JSON: phrase -> [{"rule_no", "len"}], what each rule finds where the phrase stands
    others: tuple[int, ...]


@lru_cache(maxsize=16)
def compiled(bodies: tuple[str, ...]) -> Pack | None:
    """The pack of these patterns, or None where too few of them are literal."""
    listed = {no: p for no, body in enumerate(bodies) if (p := phrases(body))}
    if len(listed) < FACTORED_FROM:
        return None
    where: dict[str, list[tuple[int, int]]] = {}
    for no, words in listed.items():
        for place, w in enumerate(words):
            where.setdefault(w, []).append((no, place))
    rules_of = {}
    for w in where:
        ends = [i for i in range(1, len(w)) if (w[i - 1] in _SEPARATORS) != (w[i] in _SEPARATORS)] + [len(w)]
        first: dict[int, tuple[int, int]] = {}
        for end in ends:
            for no, place in where.get(w[:end], ()):
                first[no] = min(first.get(no, (place, end)), (place, end))
        rules_of[w] = [{"rule_no": no, "len": end} for no, (_, end) in sorted(first.items())]
    return Pack(trie_pattern(sorted(where)), json.dumps(rules_of, ensure_ascii=False),
                tuple(no for no in range(len(bodies)) if no not in listed))


def literal_hits(text: Column, pack: Pack) -> Column:
    """Array of (rule_no, match_no, term) of the literal rules, by rule and place."""
    rules_of = F.from_json(F.lit(pack.rules_of), "map<string,array<struct<rule_no:bigint,len:int>>>")
    found = F.regexp_extract_all(text, F.lit(rf"{FLAGS}\b(?=({pack.trie})\b)"), 1)

    def rules(term, i):
        # as the pattern folds case: upper, then lower case, where a capital I with a dot is an i
        key = F.lower(F.translate(F.upper(term), "\u0130", "I"))
        return F.transform(F.coalesce(F.try_element_at(rules_of, key), F.array().cast("array<struct<rule_no:bigint,len:int>>")),
                           lambda r: F.struct(r["rule_no"].alias("rule_no"), i.alias("at"), F.left(term, r["len"]).alias("term")))

    def numbered(hits):
        return F.transform(hits, lambda x, j: F.struct(
            x["rule_no"].alias("rule_no"),
            (j - lower_bound(hits, F.size(hits), lambda e: e["rule_no"] < x["rule_no"])).cast("bigint").alias("match_no"),
            x["term"].alias("term")))

    return let(F.array_sort(F.flatten(F.transform(found, rules))), numbered)
