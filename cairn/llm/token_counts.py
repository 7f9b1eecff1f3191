"""Token counts by prefix dynamic programming.

For each prefix of a piece (what the vocabulary's splitting pattern gives) exactly one token can be the last of the
prefix's encoding: the one that the encoding of the rest before it may precede. The table of last tokens holds the
count at every prefix, so truncation and budget questions need no second encoding. Tables are kept by chunk (a run of
white space with the word after it), which the pattern never joins to its neighbours.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from . import kernel as K

#: Fixed value: the public vocabulary's splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
#: Entries of a worker's cache of chunks; a full cache is emptied, which costs time and changes nothing.
CACHED = 350_000
#: Characters of texts whose chunks are learned together.
TOGETHER = 1 << 20
_CHUNK = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space that some of the libraries count as such and some not: a text with it is one chunk.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")


class Counter:
    """Counts at every prefix for one byte-level vocabulary given as ranks (base64 token, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.longest = max(map(len, self.ranks))
        self.split, self.white = regex.compile(PATTERN), regex.compile(r"\s+")
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.tables: dict[str, bytes | list[int]] = {}
        self.pieces: dict[bytes, bytes | list[int]] = {}
        #: The piece whose table was made last, its last tokens and its counts.
        self.before, self.last, self.count = b"", [b""], [0]
        #: How often the cache of chunks was emptied.
        self.emptied = 0

    def _may_join(self, a: bytes, b: bytes) -> bool:
        known = self.joins.get((a, b))
        if known is None:
            if len(self.joins) > 2 * CACHED:
                self.joins.clear()
            known = self.joins[a, b] = list(self.merge(a + b)) == [self.ranks[a], self.ranks[b]]
        return known

    def piece(self, p: bytes) -> list[int]:
        """The count at each prefix of one piece, from the empty one on."""
        return [0, 1] if len(p) == 1 else list(self._known(p))

    def _known(self, p: bytes) -> bytes | list[int]:
        known = self.pieces.get(p)
        if known is None:
            if len(self.pieces) >= CACHED:
                self.pieces.clear()
            known = self.pieces[p] = self._piece(p)
        return known

    def _piece(self, p: bytes) -> bytes | list[int]:
        n, before = len(p), self.before
        k, most = 0, min(n, len(before))
        while k < most and p[k] == before[k]:
            k += 1
        # Tables follow from left to right, so what p shares with the piece before it is known.
        last = self.last[: k + 1] + [b""] * (n - k)
        count = self.count[: k + 1] + [0] * (n - k)
        ranks, longest, joins = self.ranks, self.longest, self.joins
        for i in range(k + 1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = p[j:i]
                if t in ranks and (not j or (joins[x] if (x := (last[j], t)) in joins else self._may_join(*x))):
                    last[i], count[i] = t, count[j] + 1
                    break
        self.before, self.last, self.count = p, last, count
        return bytes(count) if n < 256 else count

    def table(self, chunk: str) -> bytes | list[int]:
        """The count at each prefix of a chunk, by UTF-8 bytes."""
        if chunk[0] == " ":  # most chunks are a space and letters, with a point or comma after them at most; they need no pattern to be split
            word = chunk[1:]
            if word.isalpha() and max(word) < "\u0500":
                return self._known(chunk.encode())
            if word[-1:] in (".", ",") and word[:-1].isalpha() and max(word) < "\u0500":
                t = self._known(chunk[:-1].encode())
                return [*t, t[-1] + 1] if t[-1] == 255 or not isinstance(t, bytes) else t + bytes([t[-1] + 1])
        return self._split_table(chunk)

    def _split_table(self, chunk: str) -> bytes | list[int]:
        word = chunk.lstrip(" \t\n\x0b\x0c\r")
        white = chunk[: len(chunk) - len(word)]
        out = [0, 1][: len(white) + 1] if len(white) < 2 else self.piece(white.encode())  # until a word begins, white space so far is one piece
        if word:
            base = self.piece(white[:-1].encode())[-1] if len(white) > 1 else 0
            tail = [base]
            for p in self.split.findall(white[-1:] + word):
                base, n = tail[-1], self.piece(p.encode())
                if len(p) == 3 and p[0] == "'" and p[1:].isalpha():  # a part of 're, 've or 'll is two pieces
                    n[2] = 2
                tail += [base + x for x in n[1:]]
            out += tail[1 + len(white[-1:]) :]
        return bytes(out) if max(out) < 256 else out

    def _learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.tables)
        if new and len(self.tables) + len(new) > CACHED:
            self.tables.clear()
            self.emptied += 1
            new = chunks
        for c in sorted(new):  # neighbours share prefixes, and so their tables
            self.tables[c] = self.table(c)

    def total(self, text: str) -> int:
        """The count of the whole text; the special string, as the library takes it, is one token."""
        first, *rest = text.split(SPECIAL)
        return self._plain(first) + sum(1 + self._plain(x) for x in rest)

    def _plain(self, text: str) -> int:
        if _ODD.search(text):
            return sum(self.piece(p.encode())[-1] for p in self.split.findall(text))
        chunks = _CHUNK.findall(text)
        self._learn(set(chunks))
        return sum([t[-1] for t in map(self.tables.__getitem__, chunks)])

    def prefixes(self, text: str) -> np.ndarray:
        """The count of every prefix of ``text``, by characters, from the empty one to the whole."""
        out, plain = np.zeros(1, np.int64), text.split(SPECIAL)
        for k, part in enumerate(plain):
            start = out[-1]
            if k == len(plain) - 1:
                return np.concatenate([out, start + self._plain_prefixes(part)[1:]])
            n = self._plain_prefixes(part + SPECIAL[:-1])[1:]  # a part of the special string is ordinary text
            out = np.concatenate([out, start + n, [start + self._plain(part) + 1]])
        return out

    def _plain_prefixes(self, text: str) -> np.ndarray:
        if _ODD.search(text):
            return self._odd_prefixes(text)
        chunks = _CHUNK.findall(text)
        self._learn(set(chunks))
        out, base = [np.zeros(1, np.int64)], 0
        for c in chunks:
            t = self._by_characters(c, self.tables[c])
            out.append(base + t[1:])
            base += int(t[-1])
        return np.concatenate(out)

    @staticmethod
    def _by_characters(text: str, table: bytes | list[int]) -> np.ndarray:
        t = np.array(list(table), np.int64)
        return t if text.isascii() else t[np.concatenate([[0], np.cumsum([len(x.encode()) for x in text])])]

    def _odd_prefixes(self, text: str) -> np.ndarray:
        """Of a text that only the pattern can split: a prefix ends in a part of one piece, but where that piece follows white space."""
        out, base, before, last = [np.zeros(1, np.int64)], 0, 0, ""
        for p in self.split.findall(text):
            t = self._by_characters(p, self.piece(p.encode()))
            if len(p) == 3 and p[0] == "'" and p[1:].isalpha():  # a part of 're, 've or 'll is two pieces
                t[2] = 2
            made = base + t[1:]
            if last and self.white.fullmatch(last) and self.white.match(p):  # until a word begins, white space so far is one piece
                made[0] = before + self.piece((last + p[0]).encode())[-1]
            out.append(made)
            before, base, last = base, base + int(t[-1]), p
        return np.concatenate(out)

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """The count of the whole text, and the characters of its longest prefix of at most ``limit`` tokens."""
        return next(self.measure_all([text], limit))

    def measure_all(self, texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
        """``measure`` of each text; the chunks of neighbouring texts are learned together."""
        at = 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and size + len(texts[stop]) <= TOGETHER:
                size += len(texts[stop])
                stop += 1
            split = [None if SPECIAL in t or _ODD.search(t) else _CHUNK.findall(t) for t in texts[at:stop]]
            self._learn(set().union(*(c for c in split if c is not None)))
            emptied = self.emptied
            for t, chunks in zip(texts[at:stop], split, strict=True):
                if chunks is None:
                    n = self.total(t)
                    yield n, len(t) if n <= limit else len(self.truncate(t, limit))
                else:
                    if self.emptied > emptied:  # by a text between
                        self._learn(set(chunks))
                    yield self._measured(t, chunks, limit)
            at = stop

    def _measured(self, text: str, chunks: list[str], limit: int) -> tuple[int, int]:
        counts = [t[-1] for t in map(self.tables.__getitem__, chunks)]
        n = sum(counts)
        if n <= limit:
            return n, len(text)
        sums = list(accumulate(counts))
        k = bisect_right(sums, limit)  # the first chunk that goes beyond the limit
        inside = self._by_characters(chunks[k], self.tables[chunks[k]]) + (sums[k - 1] if k else 0)
        return n, sum(map(len, chunks[:k])) + int(np.flatnonzero(inside <= limit)[-1])

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        fits = np.flatnonzero(self.prefixes(text) <= budget)
        return text[: fits[-1]] if len(fits) else ""


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker process: tasks that a worker runs one after another share its tables."""
    return Counter(path)


def count(docs: DataFrame, ranks: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: bytes, tokens, whether over the limit, and cut_at, the characters of the longest prefix within it,
    read from the same tables.

    Null is empty: no bytes, no tokens. Repeated rows each give a row; other columns are left out.
    """
    K.row_bytes(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> dict:
        held = counter(ranks)
        out: dict = {"n_bytes": [], "n_tokens": [], "over_limit": [], "cut_at": []}
        texts = [t or "" for t in K.texts(batch.column(1))]
        for t, (n, at) in zip(texts, held.measure_all(texts, limit), strict=True):
            out["n_bytes"].append(len(t.encode()))
            out["n_tokens"].append(n)
            out["over_limit"].append(n > limit)
            out["cut_at"].append(at)
        return {key: batch.column(0)} | out

    return K.map_batches(docs, [key, text], f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_at long", each)


def truncate(docs: DataFrame, ranks: str, budget: int, text: str = "text") -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens; null stays null."""
    K.row_bytes(docs.sparkSession)

    def each(batch: pa.RecordBatch) -> dict:
        return {c: [None if t is None else counter(ranks).truncate(t, budget) for t in K.texts(batch.column(c))] if c == text else batch.column(c) for c in batch.schema.names}

    return K.map_batches(docs, docs.columns, docs.schema, each)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(K.docs_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
