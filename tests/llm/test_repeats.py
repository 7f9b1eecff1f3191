import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import repeats as R

from ..conftest import SMALL


def brute(texts, span):
    """(spans, kept) of texts in their order."""
    seen, out = set(), []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - span + 1):
            w = t[i : i + span]
            if w in seen:
                hit[i : i + span] = b"\1" * span
            else:
                seen.add(w)
        spans, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and hit[j]:
                j += 1
            if j > i:
                spans.append((i, j - i))
            i = j + 1
        out.append((spans, bytes(b for b, h in zip(t, hit, strict=True) if not h)))
    return out


def made(r, n, letters=b"ab\0\xc3\xa9 "):
    """Texts of pieces that recur, some cut, some changed, some of one sign."""
    pieces = [bytes(r.choice(letters) for _ in range(r.randint(30, 400))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = bytearray(r.choice(pieces))
            a, b = sorted((r.randrange(len(p)), r.randrange(len(p))))
            p = p[a:b] if r.random() < 0.4 else p
            if p and r.random() < 0.3:
                p[r.randrange(len(p))] = 0x7A
            parts.append(bytes(p) if r.random() < 0.9 else bytes([r.choice(letters)]) * r.randint(1, 300))
        out.append(b"".join(parts))
    return out


def run(spark, rows, schema="doc_id long, text binary", **more):
    df = spark.createDataFrame([(k, None if t is None else bytearray(t)) for k, t in rows], schema).repartition(3).withColumn("text", F.col("text").cast("string"))
    return [(r[0], r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in R.dedup(df, **more).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_brute_force(spark, seed):
    texts = made(random.Random(seed), 60)
    got = sorted(run(spark, list(enumerate(texts))))
    assert got == [(i, len(t), s, k) for i, (t, (s, k)) in enumerate(zip(texts, brute(texts, 100), strict=True))]
    assert sum(len(s) for _, _, s, _ in got) > 20


def test_other_lengths_and_edges_dealt_string_by_string(spark, monkeypatch):
    monkeypatch.setattr(R, "SPLIT", 2)
    monkeypatch.setattr(R, "STRETCHES", 2_000)
    monkeypatch.setattr(R, "SUFFIXES", 3_000)
    texts = made(random.Random(9), 60)
    for span in (41, 75, 290):
        want = [(i, len(t), s, k) for i, (t, (s, k)) in enumerate(zip(texts, brute(texts, span), strict=True))]
        assert sorted(run(spark, list(enumerate(texts)), span=span)) == want
    with pytest.raises(ValueError):
        run(spark, [(1, b"")], span=40)


def test_odd_rows(spark):
    r = random.Random(1)
    p, q = (bytes(r.randrange(97, 123) for _ in range(150)) for _ in range(2))
    # Null and repeated keys are numbered by key and text; of repeated rows one stays; bytes need not be UTF-8.
    rows = [(None, p), (3, q), (3, q), (3, p + b"\xff"), (5, None), (6, b""), (None, None), (7, b"\xff\xfe" * 60)]
    got = sorted(((k is not None, k or 0), n, s, t) for k, n, s, t in run(spark, rows))
    assert [x for x in got if x[1] == 150] == [((False, 0), 150, [], p), ((True, 3), 150, [], q), ((True, 3), 150, [(0, 150)], b"")]
    assert ((True, 3), 151, [(0, 150)], b"\xff") in got and ((True, 7), 120, [(2, 118)], b"\xff\xfe") in got
    assert sum(n == 0 for _, n, _, _ in got) == 3
    assert run(spark, []) == []
    # Keys that are no numbers; columns of the operator's own names.
    df = spark.createDataFrame([("b", p.decode(), 1, 2), ("a", p.decode(), 3, 4)], "name string, text string, own int, gone int")
    assert {r.name: r.n_bytes - sum(s.length for s in r.spans) for r in R.dedup(df, "name").collect()} == {"a": 150, "b": 0}


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "STEP", 500)
    r = random.Random(4)
    base = bytes(r.randrange(97, 100) for _ in range(9_000))
    texts = [base, b"x" * 37 + base[100:8_000] + b"y", base[4_000:] + base[:3_000]]
    assert sorted(run(spark, list(enumerate(texts)))) == [(i, len(t), s, k) for i, (t, (s, k)) in enumerate(zip(texts, brute(texts, 100), strict=True))]


def test_transforms_merge_to_the_order_of_all_suffixes():
    r = np.random.default_rng(3)
    for _ in range(40):
        shards, strings = [], []
        extra = []
        for _ in range(3):
            mine = [r.integers(97, 99, r.integers(6, 30)).astype(np.uint8) for _ in range(r.integers(1, 5))]
            data = np.concatenate([*mine, np.zeros(8, np.uint8)])
            size = np.array([len(m) for m in mine])
            shards.append(R.transform(data, np.cumsum(size) - size, size))
            strings += [m.tobytes() for m in mine]
            extra += [len(m) - 5 for m in mine]
        block, string, place = R.repeated(shards, np.array(extra), 5)
        got = {}
        for b, s, p in zip(block.tolist(), string.tolist(), place.tolist(), strict=True):
            got.setdefault(b, set()).add((s, p))
        want = {}
        for s, t in enumerate(strings):
            for p in range(len(t) - 4):
                want.setdefault(t[p : p + 5], set()).add((s, p))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in R.query(spark, SMALL).collect()}
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    want = {k: (len(t), sum(n for _, n in s), len(s), hashlib.sha256(kept).hexdigest()) for (k, t), (s, kept) in zip(rows, brute([t for _, t in rows], 100), strict=True)}
    assert got == want
