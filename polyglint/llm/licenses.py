"""Licence scan: notice phrases and identifier tags found by Aho-Corasick.

A text is lower-cased (A-Z) and cut into words; the words, joined by single
spaces, pass one automaton of notice phrases.  Identifier tags are found by a
second automaton over the text itself, and the expression behind a tag (and,
or, with, parentheses) is parsed by the shunting-yard algorithm.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, map_arrow

# The phrases of the contract and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notice phrases of our own (words as the scanner cuts them) and their labels.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
}

# Texts that come before a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:")

# How freely works under a label may be used again: 1 without conditions, 0 not at all.
FREEDOM = {"mit": 1.0, "apache-2": 0.9, "bsd": 1.0, "public-domain": 1.0, "unlicense": 1.0,
           "mpl-2": 0.6, "lgpl": 0.5, "cc-by-sa": 0.4, "gpl-2": 0.3, "gpl-3": 0.3, "agpl-3": 0.2,
           "cc-by-nc": 0.1}
UNKNOWN_FREEDOM = 0.2
EXCEPTION_BONUS = 0.2      # an exception (with) widens what a licence permits

# Identifiers that mean a label above.
ALIASES = {"apache-2.0": "apache-2", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2",
           "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "agpl-3.0": "agpl-3",
           "agpl-3.0-only": "agpl-3", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "mpl-2.0": "mpl-2",
           "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "cc-by-nc-4.0": "cc-by-nc", "cc-by-sa-4.0": "cc-by-sa",
           "cc0-1.0": "public-domain"}

# SPDX identifiers without digit or hyphen, in lower case.
PLAIN_IDS = frozenset("""
aal abstyles adsl afmparse aladdin amdplpa aml ampas apafml baekmuk bahyph barr beerware blessing borceux caldera
checkmk clartistic crossword crystalstacker cube curl diffmark doc dotseqn dsdp dvipdfm egenix entessa epics
eudatagrid eurosym fair freeimage fsfap fsful fsfullr ftl gd giftware glide glulxe gnuplot haskellreport hpnd icu ijg
imagemagick imatix intel ipa isc jam jasper jpnic json leptonica libtiff loop makeindex metamail miros mit mitnfa
motosoto mtll mup naist naumen nbpl ncsa netcdf newsletr ngpl nlpl nokia noweb nrl ntp ogtsl oml openssl plexus
postgresql psfrag psutils python qhull rdisc rscpl ruby scea sendmail shl sissl sleepycat smlnj smppl snia swl tcl tmate
torque tosl ttwl unlicense vim vostrom watcom wsuipa wtfpl xerox xinetd xnet xpp xskat zed zend zlib""".split())
NO_LICENCE = ("none", "noassertion")    # what SPDX says where there is no licence to name

_NOT_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
                  for b in range(256))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII digits, letters (lower case) and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_NOT_WORD).split()


def _lower(text: str) -> str:
    """A-Z in lower case; places stay as they are."""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


@functools.cache
def _phrases() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in {**NOTICE_PHRASES, **BASE_PHRASES}.items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


@functools.cache
def _tags() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for tag in TAGS:
        a.add_word(tag, tag)
    a.make_automaton()
    return a


def is_identifier(token: str) -> bool:
    """A known licence, or a name with a digit or hyphen."""
    return token in FREEDOM or token in ALIASES or token in PLAIN_IDS or bool(re.search("[0-9-]", token))


def to_postfix(said: str, lowered: str | None = None, start: int = 0, end: int | None = None) -> list[str]:
    """The longest licence expression at a place of a text, operands first
    and in lower case (shunting-yard); empty where there is none.  What cannot
    follow ends the expression, so that prose behind it is not taken in.

    Any word is an operand inside parentheses, which prose would not close in
    its place.  Elsewhere it must be an identifier (``is_identifier``) or have
    an upper-case initial at the start or behind an operator in upper case, and
    no other word right behind it."""
    expression = _lower(said) if lowered is None else lowered
    end = len(said) if end is None else end
    formal = True            # whether names in upper case count: at the start, behind AND, OR, WITH
    out: list[str] = []
    ops: list[str] = []
    good: list[str] = []
    operand = False          # whether the last token ended an operand
    at = start
    while m := _TOKEN.match(expression, at, end):
        tok, at = m[1], m.end()
        if tok == "(":
            if operand:
                break
            ops.append(tok)
        elif tok == ")":
            if not operand or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif tok in _PRECEDENCE:
            if not operand:
                break
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[tok]:
                out.append(ops.pop())
            ops.append(tok)
            operand = False
            formal = said[m.start(1):m.end(1)].isupper()
        else:
            tok = tok.rstrip(".-")
            after = _TOKEN.match(expression, at, end)
            ends = not after or after[1] in _PRECEDENCE or after[1] in "()"
            named = is_identifier(tok) or "(" in ops or formal and ends and said[m.start(1)].isupper()
            if operand or not named or tok in NO_LICENCE:
                break
            out.append(tok)
            operand = True
        if operand and "(" not in ops:
            good = out + ops[::-1]
    return good


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels named by an expression, and its freedom: ``and`` keeps the
    stricter side, ``or`` the freer one, ``with`` widens its licence."""
    stack: list[tuple[set[str], float]] = []
    for tok in postfix:
        if tok in _PRECEDENCE:
            (lb, fb), (la, fa) = stack.pop(), stack.pop()
            if tok == "with":
                stack.append((la, min(1.0, fa + EXCEPTION_BONUS)))
            else:
                stack.append((la | lb, min(fa, fb) if tok == "and" else max(fa, fb)))
        else:
            label = ALIASES.get(tok, tok)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN_FREEDOM)))
    return stack[0] if stack else (set(), 0.0)


def scan_text(text: str) -> dict:
    """What one text says of its licence.

    places: (start word, phrase, label) of all phrases; expressions: (start
    code point, postfix tokens); labels; freedom of the strictest notice."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    joined = line.decode("utf-8", "surrogatepass")
    places, found = [], []
    word_at, number = 0, -1          # code point and number of the last word begun so far
    hits = sorted((end - len(phrase) - 1, phrase, label) for end, (phrase, label) in _phrases().iter(joined))
    for start, phrase, label in hits:
        # starts ascend, so the blanks before them are counted once
        number += joined.count(" ", word_at, start + 1)
        word_at = start + 1
        places.append((number, phrase, label))
    freedoms = [FREEDOM.get(label, UNKNOWN_FREEDOM) for _, _, label in places]
    labels = {label for _, _, label in places}
    low = _lower(text) if ":" in text else ""
    for end, _ in _tags().iter(low):
        line_end = text.find("\n", end + 1)
        tokens = to_postfix(text, low, end + 1, len(text) if line_end < 0 else line_end)
        if tokens:
            found.append((end + 1, tokens))
            named, free = evaluate(tokens)
            labels |= named
            freedoms.append(free)
    return {"n_words": len(words), "places": places, "expressions": found, "labels": labels,
            "freedom": min(freedoms) if freedoms else 0.0}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: what the licence scan found in its whole text.

    score is the freedom of the strictest notice in the text (1: free, 0: none
    found).  expressions holds the parsed identifier expressions in postfix
    order.  Null and empty texts have no words and no labels; repeated rows are
    scanned alike; other columns are ignored.  No shuffle.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(it, "text"):
            rows = []
            for t in texts:
                r = scan_text(t)
                base = [(w, label) for w, phrase, label in r["places"] if phrase in BASE_PHRASES]
                rows.append((r["n_words"], len(base), min((w for w, _ in base), default=None),
                             max((w for w, _ in base), default=None), ",".join(sorted({x for _, x in base})),
                             ",".join(sorted(r["labels"])), r["freedom"],
                             "; ".join(" ".join(e) for _, e in r["expressions"])))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                 "expressions"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run,
                     "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                     "base_labels string, labels string, score double, expressions string")
