"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The items (a test set; its words are bounded by ``MAX_ITEM_WORDS``, checked) make one automaton that every task holds.
Training words stream through it: the state's match length at a word is the longest run of words ending there that
some item contains, so a run of ``window`` words or more is contaminated, and so is a whole shorter item.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K
from .license_scan import TABLE

#: Bounds of the test items, which every worker holds: 4 million words make an automaton of about 1 GB; long words count by their bytes.
MAX_ITEM_WORDS, MAX_ITEM_BYTES = 4_000_000, 64 << 20
#: Words as ``split`` takes them, for the JVM.
JVM_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Automaton:
    """States with the length of their longest string, suffix links and moves; state 0 is the empty string."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.size, self.link, self.moves = [0], [-1], [{}]
        kept = [(k, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for k, ws in items if ws]
        self.least = min([window, *(len(ws) for _, ws in kept)])
        for _, ws in kept:
            last = 0
            for w in ws:
                last = self._add(last, w)
        self._mark(kept)

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._state(self.size[p] + 1, self.link[q], dict(self.moves[q]))
        self.link[q] = c
        while p >= 0 and self.moves[p].get(w) == q:
            self.moves[p][w] = c
            p = self.link[p]
        return c

    def _state(self, size: int, link: int, moves: dict) -> int:
        self.size.append(size)
        self.link.append(link)
        self.moves.append(moves)
        return len(self.size) - 1

    def _add(self, last: int, w: int) -> int:
        if (q := self.moves[last].get(w)) is not None:
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, q, w)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and w not in self.moves[p]:
            self.moves[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.moves[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, w)
        return new

    def _mark(self, kept: list) -> None:
        """at[v]: the state of the last ``window`` words of v's strings; of[u]: items that contain u's strings; short: whole short items."""
        self.at, self.of, self.short = [0] * len(self.size), {}, {}
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            if self.size[v] >= self.window:
                self.at[v] = v if self.size[self.link[v]] < self.window else self.at[self.link[v]]
        for key, ws in kept:
            v = 0
            for n, w in enumerate(ws, 1):
                v = self.moves[v][w]
                if n >= self.window and len(ws) >= self.window:
                    self.of.setdefault(self.at[v], set()).add(key)
            if len(ws) < self.window:
                self.short.setdefault(v, []).append((len(ws), key))
        #: For each state, whether it or one above holds a whole short item.
        self.ends = [False] * len(self.size)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.ends[v] = v in self.short or self.ends[self.link[v]]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The hit runs of words as [start, end) and the items with an occurring window."""
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        spans: list[tuple[int, int]] = []
        items: set = set()
        size, link, moves, at, window = self.size, self.link, self.moves, self.at, self.window
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):  # an unknown word leads to state 0
            if b - a < self.least:
                continue
            v = n = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while v and w not in moves[v]:
                    v = link[v]
                    n = size[v]
                if w in moves[v]:
                    v = moves[v][w]
                    n += 1
                if n >= window:
                    found = self.of.get(at[v])
                    if found:  # a window that only joins nothing but short items is no window
                        items |= found
                        spans.append((i + 1 - window, i + 1))
                if self.ends[v]:
                    u = v
                    while u:
                        for m, key in self.short.get(u, ()):
                            if m <= n:
                                items.add(key)
                                spans.append((i + 1 - m, i + 1))
                        u = link[u]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def automaton(benchmark: DataFrame, key: str, text: str, window: int) -> Automaton:
    items = benchmark.select(F.col(text).alias("t")).where("t IS NOT NULL")
    n, size = items.select(F.coalesce(F.sum(F.size(F.regexp_extract_all("t", F.lit(JVM_WORD), F.lit(0)))), F.lit(0)), F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()
    if n > MAX_ITEM_WORDS or size > MAX_ITEM_BYTES:
        raise ValueError(f"the test items have {n} words and {size} bytes; give them in tables of at most {MAX_ITEM_WORDS} words and {MAX_ITEM_BYTES} bytes and run each")
    return Automaton([(r[0], split(r[1])) for r in benchmark.select(key, text).dropDuplicates().collect()], window)


def _shared(spark, a: Automaton):
    return spark.sparkContext.broadcast(a)


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per document: word counts, hit words, the items found and their digest, and the hit spans (word numbers).

    Null and empty texts and items have no words. Repeated rows each give a row; items of one text all count.
    """
    K.row_bytes(docs.sparkSession)
    held = _shared(docs.sparkSession, automaton(benchmark, item, item_text, window))

    def each(batch: pa.RecordBatch) -> dict:
        a, out = held.value, {x: [] for x in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")}
        for t in K.texts(batch.column(1)):
            words = split(t)
            spans, items = a.match(words)
            hit = sum(y - x for x, y in spans)
            row = len(words), hit, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), hit > 0, [v for s in spans for v in s]
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {key: batch.column(0)} | out

    kind = docs.schema[key].dataType.simpleString()
    return K.map_batches(docs, [key, text], f"`{key}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>", each)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, coverage: float = 0.5) -> DataFrame:
    """``docs`` without the spans that benchmark items share, and without documents of which they cover more than ``coverage``.

    Exactly that share stays. Null and empty texts have no words and stay as they are; rows are judged by their text alone, so
    null and repeated keys do not matter and repeated rows are treated alike; an empty table of documents or items changes
    nothing. Other columns stay, whatever their names; a column ``n_chars`` is counted anew.
    """
    K.row_bytes(docs.sparkSession)
    held = _shared(docs.sparkSession, automaton(benchmark, item, item_text, window))
    names, schema = docs.columns, docs.schema

    def each(batch: pa.RecordBatch) -> dict:
        keep, texts = [], []
        for t in K.texts(batch.column(text)):
            words = split(t)
            spans, _ = held.value.match(words)
            keep.append(sum(y - x for x, y in spans) <= coverage * len(words))
            texts.append(without(t, spans) if spans and keep[-1] else t)
        mask = pa.array(keep, pa.bool_())
        return {c: (pa.array(texts, pa.string()) if c == text else batch.column(c)).filter(mask) for c in names}

    out = K.map_batches(docs, names, schema, each)
    return out.withColumn("n_chars", F.length(text).cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from each span's first word to its last."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    return scan(K.docs_of(spark, sf_dir), K.docs_of(spark, sf_dir, "benchmark")).drop("spans")
