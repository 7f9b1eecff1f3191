"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K

#: The base phrases and labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases, their labels, and how sure each makes one.
MORE = {
    "gnu general public license version 3": ("gpl-3", 0.95),
    "gnu general public license version 2": ("gpl-2", 0.95),
    "gnu general public license": ("gpl", 0.8),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license version 2": ("mpl-2", 0.95),
    "eclipse public license": ("epl", 0.9),
    "bsd 3 clause": ("bsd-3-clause", 0.9),
    "bsd 2 clause": ("bsd-2-clause", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "creative commons zero": ("cc0", 0.85),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", 0.85),
    "all rights reserved": ("proprietary", 0.5),
}
TAG = "spdx license identifier"
#: Everything but letters, digits and bytes from 0x80 separates words; A-Z become lower case.
TABLE = bytes(K.LOWER[i] if K.ALNUM[i] else 0x20 for i in range(256))
_EXPRESSION = re.compile(r"SPDX-License-Identifier\s*:\s*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:\-]*)")
#: Operators of licence expressions and how tightly they bind.
BINDS = {"OR": 1, "AND": 2, "WITH": 3}


def to_postfix(text: str) -> list[str]:
    """The longest well-formed expression at the start of ``text`` in postfix order; [] if there is none."""
    return _yard(_well_formed(text))


def _well_formed(text: str) -> list[str]:
    """The tokens of the longest well-formed expression at the start of ``text``, in one pass."""
    tokens: list[str] = []
    at = depth = whole = 0
    while m := _TOKEN.match(text, at):
        t = m[1].upper() if m[1].upper() in BINDS else m[1]
        depth += (t == "(") - (t == ")")
        tokens.append(t)
        if depth < 0 or not _fits(tokens):
            break
        at = m.end()
        if not depth and t not in BINDS:
            whole = len(tokens)
    return tokens[:whole]


def _fits(tokens: list[str]) -> bool:
    """Whether the last token may follow the one before it."""
    last = tokens[-1]
    operand = len(tokens) == 1 or tokens[-2] in BINDS or tokens[-2] == "("
    return operand == (last not in BINDS and last != ")")


def _yard(tokens: list[str]) -> list[str]:
    """Shunting-yard over well-formed tokens."""
    out: list[str] = []
    held: list[str] = []
    for t in tokens:
        if t in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[t]:
                out.append(held.pop())
            held.append(t)
        elif t == "(":
            held.append(t)
        elif t == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            out.append(t)
    return out + held[::-1]


def required(postfix: list[str]) -> set[str]:
    """The licences that hold whichever choice is made; their number never exceeds the expression's. An exception belongs to its licence."""
    stack: list[set[str]] = []
    for t in postfix:
        if t not in BINDS:
            stack.append({t.lower()})
            continue
        b, a = stack.pop(), stack.pop()
        if t == "WITH" and len(a) == len(b) == 1:
            stack.append({f"{x} with {y}" for x in a for y in b})
            continue
        few, many = sorted((a, b), key=len)
        if t == "OR":
            few &= many
            stack.append(few)
        else:
            many |= few
            stack.append(many)
    return stack[0] if stack else set()


def evaluate(postfix: list[str]) -> list[frozenset[str]]:
    """The ways to comply: each a set of licences (with their exceptions) that hold together; or gives a choice, and unites."""
    stack: list[list[frozenset[str]]] = []
    for t in postfix:
        if t not in BINDS:
            stack.append([frozenset([t.lower()])])
            continue
        b, a = stack.pop(), stack.pop()
        if t == "OR":
            stack.append(list(dict.fromkeys(a + b)))
        elif t == "AND":
            stack.append(list(dict.fromkeys(x | y for x in a for y in b)))
        else:
            stack.append([frozenset(f"{x} with {y}" for x in one for y in other) for one in a for other in b])
    return stack[0] if stack else []


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *MORE, TAG}:
        a.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    a.make_automaton()
    return a


def scan(text: str | None, a: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, required of one whole text, in one pass."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, [], []
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base, places, labels, unsure, said = set(), [], set(), 1.0, False
    for end, (phrase, _) in a.iter(line):
        if phrase in BASE:
            base.add(BASE[phrase])
            places.append(end - len(phrase) - 1)
            unsure *= 0.02
        elif phrase in MORE:
            labels.add(MORE[phrase][0])
            unsure *= 1 - MORE[phrase][1]
        else:
            said = True
    starts = []
    if places:  # a place's word is the number of spaces before it; all are counted in one walk, as places rise
        places.sort()
        at = word = 0
        for p in places:
            word += line.count(" ", at, p)
            at = p
            starts.append(word)
    out, needed = [], set()
    if said:
        for m in _EXPRESSION.finditer(text):
            if tokens := _well_formed(m[1]):
                postfix = _yard(tokens)
                labels |= {x.lower() for x in postfix if x not in BINDS}
                out.append(" ".join(tokens).replace("( ", "(").replace(" )", ")").lower())
                needed |= required(postfix)
                unsure *= 0.01
    if "gpl-3" in labels or "gpl-2" in labels:
        labels.discard("gpl")
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(1 - unsure, 6), out, sorted(needed)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and places of the base phrases, labels, licence expressions (as written, lower case, spaced
    alike) and the licences that these require whichever choice is made.

    Null and empty texts have no words, no labels, score 0. Repeated rows each give a row; other columns are left out.
    """
    K.row_bytes(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    made: list = []

    def each(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(automaton())
        rows = [scan(t, made[0]) for t in K.texts(batch.column(1))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
        return {key: batch.column(0)} | dict(zip(("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "required"), map(list, cols), strict=True))

    return K.map_batches(docs, [key, text], f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, required array<string>", each)


def query(spark, sf_dir: str) -> DataFrame:
    return find(K.docs_of(spark, sf_dir))
