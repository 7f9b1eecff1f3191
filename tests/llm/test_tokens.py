import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import packing as K, token_counts as T

from ..conftest import SMALL

PARTS = ["a", "b", "The", "QUICK", "Éa", "<|", "|>", "F#", *"#$%&()*+-/:;<=>?@[]^_`{|}~", " ", "  ", "\n", "\t", "'", "re", "ve", "ll", "s", "!", "é", "ß", "漢", "1", "23", "<|endoftext|>", "<|endo", " the", "\x1c", "😀", ".", "\r\n", "　", "don't", "we've", "é", "İ", "ΑΣ ", "<|startoftext|>", "<|ENDOFTEXT|>", "word.", "it's,"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_bpe():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def word_bpe():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_every_prefix_has_the_librarys_count(byte_bpe):
    c = T.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for t in texts(500, 1):
        assert list(c.prefixes(t)) == [byte_bpe(t[:i]) for i in range(len(t) + 1)], t
        assert c.total(t) == byte_bpe(t)
        cut = c.truncate(t, 5)
        assert byte_bpe(cut) <= 5 and all(byte_bpe(t[:i]) > 5 for i in range(len(cut) + 1, len(t) + 1))


def test_where_to_cut(byte_bpe):
    c = T.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(6)
    for t in [*texts(300, 4), *("".join(r.choice(["\x1c", " ", "  ", "\xa0", "\u2003", "\n", "a", "We're", "été", "12", "!"]) for _ in range(12)) for _ in range(300))]:
        want = [byte_bpe(t[:i]) for i in range(len(t) + 1)]
        assert list(c.prefixes(t)) == want, t
        for limit in (0, 1, 3, 7, 100):
            assert c.measure(t, limit) == (want[-1], max(i for i, n in enumerate(want) if n <= limit)), (t, limit)


def test_texts_that_only_the_pattern_splits_take_linear_time():
    import time

    c, took = T.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken")), []
    for n in (5_000, 40_000):
        t = time.process_time()
        assert len(c.prefixes("mot\xa0: voilà " * n)) == 12 * n + 1
        took.append(time.process_time() - t)
    assert took[1] < 24 * took[0] + 0.5


def test_counts(spark, byte_bpe):
    docs = dict(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()))
    for r in T.query(spark, SMALL).collect():
        n = byte_bpe(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def test_count_edges(spark, byte_bpe):
    rows = [(1, None), (1, ""), (2, "x" * 3000), (3, " " * 500), (3, " " * 500)]
    got = T.count(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert [r.n_tokens for r in got] == [byte_bpe(t or "") for _, t in rows]
    cut = T.truncate(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken"), 3).collect()
    assert cut[0].text is None and byte_bpe(cut[2].text) <= 3


def test_word_ids_are_the_librarys(word_bpe):
    e = K.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for t in texts(800, 2):
        assert next(e.encode([t.encode()])) == np.array(word_bpe(t), "<u4").tobytes(), t


def test_words_learned_together_have_the_librarys_ids(word_bpe, monkeypatch):
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzäéßñİΣσςжЖ漢한ｱªⅨ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) + r.choice(["", "", ".", ",", "'s", "1"]) for _ in range(3000)]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(200)]
    for joined, together, cached in ((1000, 1 << 20, 60_000_000), (7, 300, 60_000_000), (50, 2000, 40_000)):
        for name, value in (("JOINED", joined), ("TOGETHER", together), ("CACHED", cached)):
            monkeypatch.setattr(K, name, value)
        e = K.Encoder(public_tokenizers.path("word_bpe_49k.json"))
        assert list(e.encode([t.encode() for t in lines])) == [np.array(word_bpe(t), "<u4").tobytes() for t in lines]


def test_words_reach_the_library_once_whatever_marks_they_have(word_bpe, monkeypatch):
    stems = ["".join(p) for p in product("abé", "cdü", "efß", "ghñ")]
    ends = ["", ".", ",", "***", ".###", "!!", ")", "-", "'", "|>", "1."]
    lines = [" ".join(s + x for s in stems) for x in ends]
    e, learned = K.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    monkeypatch.setattr(e, "_learn", lambda words, learn=e._learn: (learned.extend(words), learn(words))[1])
    assert list(e.encode([t.encode() for t in lines])) == [np.array(word_bpe(t), "<u4").tobytes() for t in lines]
    assert len(learned) == len(set(learned)) <= 2 * len(stems) + len(ends)


def test_a_full_cache_keeps_the_words_at_hand(word_bpe, monkeypatch):
    common = " ".join(f"common{a}{b}" for a in "abcde" for b in "fghij")
    lines = [f"{common} " + " ".join(f"rare{c}{a}{b}" for a in "abcde" for b in "fghij") for c in "klmnopqr"]
    monkeypatch.setattr(K, "TOGETHER", 1)
    monkeypatch.setattr(K, "CACHED", 14_000)
    e, learned = K.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    monkeypatch.setattr(e, "_learn", lambda words, learn=e._learn: (learned.extend(words), learn(words))[1])
    assert list(e.encode([t.encode() for t in lines])) == [np.array(word_bpe(t), "<u4").tobytes() for t in lines]
    assert len(learned) == len(set(learned))  # those of every line are not learned again
    assert len(e.seen) < 80  # and those of one line went


def test_words_are_parted_only_where_the_library_parts_them():
    lib, e = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), K.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(9)
    odd = ["x", "Z", "1", "'s", "'LL", "'", "\u0338", "\u0301", "\u0345", "\u0374", "\u0387", "\u037e", "×", "ª", "Ⅸ", "٣", "İ", "ǅ", "ʰ", "ﬁ", "\u212a", "\u0482", "ж", "Σ", "\x00", "\x7f", "\x85", "\xa0", "\u200b", "<|endoftext|>", "<|EndOfText|>", "\x0b"]
    lines = ["".join(r.choice([*PARTS, *odd]) for _ in range(r.randint(0, 14))).encode() for _ in range(4000)]
    lines += [bytes(r.choice([r.randrange(256), *b"a.<|\xc3\xa9\xe2"]) for _ in range(r.randint(0, 20))) for _ in range(1000)]
    lines += [b"a<|endof", b"text|>b", b"", b"\xc3", b"\xa9.", b"<|startoftext|><|endoftext|>the.end"]
    want = lib.encode_batch([t.decode("utf-8", "replace") for t in lines], add_special_tokens=False)
    assert list(e.encode(lines)) == [np.array(w.ids, "<u4").tobytes() for w in want]


def test_shortest_pack_first():
    r = random.Random(3)
    for _ in range(50):
        h = {r.randint(1, 64): r.randint(1, 40) for _ in range(r.randint(0, 30))}
        packs = K.shortest_pack_first(h, 64)
        used = defaultdict(int)
        for n, p in packs:
            assert sum(p) <= 64
            for x in p:
                used[x] += n
        assert dict(used) == h


def check_packing(rows, docs, word_bpe, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, parts in by_doc.items():
        ids, at = np.array(word_bpe(docs[i] or "") + [2], "<u4"), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return sum(r.length for r in rows) / (size * len(by_sequence))


def test_packing(spark, word_bpe):
    docs = dict(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()))
    assert check_packing(K.query(spark, SMALL).collect(), docs, word_bpe, 4096) > 0.95


def test_packing_edges(spark, word_bpe):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = {1: None, 2: "", 3: "a b c " * 40, 4: "x"} | {i: "one two" for i in range(10, 40)}
    df = spark.createDataFrame([(i, t, "z") for i, t in docs.items()], "doc_id long, text string, rank string").repartition(5)
    check_packing(K.pack(df, path, size=16).collect(), docs, word_bpe, 16)
    twice = K.pack(df.union(df), path, size=16)
    assert twice.count() == 2 * K.pack(df, path, size=16).count() and twice.select("sequence_id", "offset").distinct().count() == twice.count()
    assert K.pack(df.limit(0), path).count() == 0


def test_keys_of_any_name(spark):
    from cairn.llm import decontaminate, language_id, license_scan, ngram_join, quality_rules

    df = spark.createDataFrame([(7, "one two three four five six")], "`my id` long, text string")
    for made in (
        K.pack(df, public_tokenizers.path("word_bpe_49k.json"), key="my id"), T.count(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), key="my id"), license_scan.find(df, key="my id"), ngram_join.join(df, key="my id"),
        language_id.label(df, language_id.Model({"en": ["one two"]}), key="my id"), decontaminate.scan(df, df.select(F.col("my id").alias("item_id"), "text"), key="my id"), quality_rules.assess(df),
    ):
        assert [r["my id"] for r in made.collect()] == [7]
