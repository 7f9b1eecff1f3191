"""Packing token sequences by the length histogram, shortest pack first.

Documents are encoded once; pieces of at most ``size`` ids get their length, checksum and rank among the pieces of that
length in their partition. The driver sees only the histogram (``size`` rows at most): it places lengths longest first,
each into the pack with the most room left, and keeps counts of equal packs (patterns). Patterns are joined back to
pieces by rank, so no ids are shuffled and no task gathers a length.
"""

from __future__ import annotations

import codecs
import os
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import kernel as K

SIZE, END = 4096, 2
#: Bytes of a worker's cache of encoded words, its own about ``ENTRY`` an entry; a full cache keeps only the words at hand, which costs time and changes nothing.
CACHED, ENTRY = 60_000_000, 200
#: Bytes of texts whose words are looked up together, and words of letters that go to the library as one line.
TOGETHER, JOINED = 8 << 20, 1000
#: Byte-level vocabularies write each byte as one character: these as they are, the others, in order, from U+0100 on; a space parts words here.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [x for x in range(256) if x not in _SHOWN]
BYTE_LEVEL = "".join(" " if x == 0x20 else chr(x if x in _SHOWN else 0x100 + _OTHERS.index(x)) for x in range(256))
#: The vocabulary's special strings, which it takes out of a text before all else.
SPECIAL = re.compile(rb"<\|(?:start|end)oftext\|>")
#: 1: ASCII letters and digits, 2: ASCII marks, 3: the apostrophe, which may begin a token that ends in letters.
_KIND = np.array([0 if x <= 0x20 or x >= 0x7F else 1 if chr(x).isalnum() else 3 if x == 0x27 else 2 for x in range(256)], np.uint8)
#: Pairs of kinds, as 4 * first + second, that no token spans.
_PARTED = np.isin(np.arange(16), [4 * 1 + 2, 4 * 1 + 3, 4 * 2 + 1])
#: Two-byte characters, as 256 * first + second, that are letters and whose lower case is.
_LETTERS = np.zeros(1 << 16, bool)
_LETTERS[[int.from_bytes(chr(x).encode()) for x in range(0x80, 0x500) if chr(x).isalpha() and chr(x).lower().isalpha()]] = True


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to the library's for the whole text.

    The vocabulary's pre-tokenizer drops white space and never joins what stands on both sides of it, nor letters or digits and
    marks after them. What lies between is encoded on its own. Arrow splits and numbers these words, and gathers the ids in
    the end; Python sees each distinct one of a group of texts once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        #: The same merges for words that normalisation and splitting leave as they are, written byte by byte.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.lib.get_vocab()
        #: Whether an id ends a pre-token.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.seen: dict[bytes, bytes] = {b"": b""}
        self.held = 0

    def _learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if (w.isalpha() and w.islower()) or (not w.isascii() and _as_it_is(_text(w)))]
        self._learn_joined(self.plain, plain, lambda line: codecs.charmap_decode(line, "strict", BYTE_LEVEL)[0])
        left = [w for w in words if w not in self.seen]
        self._learn_joined(self.lib, [w for w in left if not w.isascii() and _text(w).isalpha()], _text)
        self._learn_each([w for w in left if w not in self.seen])

    def _learn_joined(self, lib, words: list[bytes], text: Callable[[bytes], str]) -> None:
        """Each word of letters is one pre-token, or at least one: if a line of them has as many ends as words, each end is a word's."""
        for at in range(0, len(words), JOINED):
            line = words[at : at + JOINED]
            ids = np.array(lib.encode_batch_fast([text(b" ".join(line))], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(line):
                raw, a = ids.tobytes(), 0
                for w, b in zip(line, (4 * stops).tolist(), strict=True):
                    self.seen[w] = raw[a:b]
                    a = b

    def _learn_each(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            for w, e in zip(part, self.lib.encode_batch_fast([_text(w) for w in part], add_special_tokens=False), strict=True):
                self.seen[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        at, n = 0, len(texts)
        while at < n:
            stop, size = at + 1, len(texts[at])
            while stop < n and size + len(texts[stop]) <= TOGETHER:
                size += len(texts[stop])
                stop += 1
            yield from self._encode(texts[at:stop])
            at = stop

    def _encode(self, texts: list[bytes]) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(_parted(texts))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.view(pa.large_binary()).to_pylist()
        self._make_known(words)
        ids = [self.seen[w] for w in words]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        made = lists.take(coded.indices).flatten().to_numpy()
        bounds = np.concatenate([[0], np.cumsum(n[coded.indices.to_numpy()])])[split.offsets.to_numpy()].tolist()
        for a, b in pairwise(bounds):
            yield made[a:b].tobytes()

    def _make_known(self, words: list[bytes]) -> None:
        # Ids take no more than four bytes for each byte of their word.
        cost = lambda some: sum(map(len, some)) * 5 + ENTRY * len(some)
        missing = [w for w in words if w not in self.seen]
        need = cost(missing)
        if self.held and self.held + need > CACHED:
            self.seen = {w: self.seen[w] for w in words if w in self.seen} | {b"": b""}
            self.held = cost(self.seen)
        self.held += need
        self._learn(missing)


def _parted(texts: list[bytes]) -> pa.LargeStringArray:
    """The texts, A-Z lower-cased as the vocabulary does, with a space between a letter or digit and a mark, but for special strings."""
    raw = b"\n".join([*texts, b""])
    data = K.LOWER[np.frombuffer(raw, np.uint8)]
    kind = _KIND[data]
    at = np.flatnonzero(_PARTED[kind[:-1] * 4 + kind[1:]])
    # A wide letter before a mark; its first byte cannot be another text's last, as a line feed lies between.
    wide = np.flatnonzero((data[:-1] >= 0x80) & (kind[1:] >= 2))
    wide = wide[wide > 0]
    at = np.sort(np.concatenate([at, wide[_LETTERS[data[wide - 1].astype(np.int64) << 8 | data[wide]]]])) + 1
    if b"<|" in raw:
        spans = np.array([m.span() for m in SPECIAL.finditer(raw)], np.int64).reshape(-1, 2)
        # Inside a special string one more has begun before the place than has ended by it.
        at = at[np.searchsorted(spans[:, 0], at, side="left") == np.searchsorted(spans[:, 1], at, side="right")]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    made = np.insert(data, at, 0x20)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds + np.searchsorted(at, bounds)), pa.py_buffer(made))


def _text(word: bytes) -> str:
    return word.decode("utf-8", "replace")


def _as_it_is(word: str) -> bool:
    """Whether a word of Latin, Greek or Cyrillic letters is composed and lower case."""
    return word.isalpha() and max(word) < "\u0500" and word.lower() == word and unicodedata.is_normalized("NFC", word)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process: tasks that a worker runs one after another share its cache."""
    return Encoder(path)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths in order) of packs; every length of the histogram is placed as often as it says."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    top = 0  # the most room that any open pack has
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while top and not room[top]:
                top -= 1
            if top < length:
                room[size - length].append((left, (length,)))
                top = max(top, size - length)
                break
            count, pack = room[top].pop()
            took = min(count, left)
            if count > took:
                room[top].append((count - took, pack))
            room[top - length].append((took, (*pack, length)))
            left -= took
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in room.values():
        for count, pack in packs:
            merged[pack] += count
    return [(n, p) for p, n in sorted(merged.items(), reverse=True)]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) sorted: the pieces of a length from that rank on, one a sequence."""
    at: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for count, pack in packs:
        offset = 0
        for length in pack:
            rows.append((length, at[length], first, offset))
            at[length] += count
            offset += length
        first += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per piece, with its partition and its rank there among the pieces of its length. Null texts are empty."""
    K.row_bytes(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        held, ranks, part = encoder(tokenizer), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in K.tidied(batches):
            rows: list[tuple] = []
            for i, ids in enumerate(held.encode([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, size):
                    b = min(a + size, n)
                    rows.append((i, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n, ranks[b - a]))
                    ranks[b - a] += 1
            made = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(made[0])), *map(pa.array, made[1:]), pa.array(np.full(made.shape[1], part, np.int64))], names)

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "rank", "part"]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, rank long, part long")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Every piece with its sequence and the offset there.

    An empty table gives none; null and empty texts are their end id alone; repeated rows are packed each; bytes that are not UTF-8
    count as U+FFFD. Of other columns none is returned.
    """
    made = K.cut(pieces(docs, tokenizer, key, text, size))
    counts = made.groupBy("length", "part").count()
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most ``size`` rows
    table = slots(shortest_pack_first(histogram, size))
    before = counts.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    ranked = made.join(before, ["length", "part"]).select(key, "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rank")).alias("rank"))
    codes = table[:, 0] << 44 | table[:, 1]  # ranks below 2 ** 44

    def place(batch: pa.RecordBatch) -> dict:
        length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
        at = table[np.searchsorted(codes, length << 44 | rank, side="right") - 1] if len(table) else np.zeros((0, 4), np.int64)
        return {c: batch.column(c) for c in batch.schema.names[:5]} | {"sequence_id": at[:, 2] + rank - at[:, 1], "offset": at[:, 3]}

    kind = docs.schema[key].dataType.simpleString()
    return K.map_batches(ranked, ranked.columns, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", place)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(K.docs_of(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
