import hashlib
import random
import re
import zlib

import numpy as np

from cairn.llm import periodic as P

from ..conftest import SMALL


def brute(w, least=2):
    """(start, length, smallest period) of all maximal runs, sorted by start and period."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in best.items() if b - a >= least), key=lambda x: (x[0], x[2]))


def words(r):
    n, letters = r.randint(0, 70), r.choice([2, 3, 6])
    w = [r.randrange(letters) for _ in range(n)]
    if n and r.random() < 0.6:
        a, old = r.randrange(n), w[:]
        p = r.randint(1, max(1, (n - a) // 3))
        for i in range(a, n):
            w[i] = old[a + (i - a) % p]
    return w


def test_all_repetitions():
    r = random.Random(5)
    for _ in range(600):
        w = words(r) or [0]
        _, ids = np.unique(w, return_inverse=True)
        assert [(a, b - a, q) for a, b, q in P.repetitions(ids.astype(np.int64)).tolist()] == brute(w), w


def test_runs_of_texts(spark):
    r = random.Random(6)
    texts = [" ".join(f"w{x}" for x in words(r)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for row in P.runs(df).collect():
        w = texts[row.doc_id].split()
        runs = brute(w, 12)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert ([tuple(x) for x in row.runs], row.n_words) == (runs, len(w))
        assert row.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a " * 20, 1), (None, "a " * 20, 1), (3, " \t\n", 2), (4, "x", 3)]
    got = P.runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == [(0, 20, [(0, 20, 1)], "a")] * 2 + [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 1, [], "x")]
    assert P.runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_runs_are_found_in_linear_space():
    assert P.repetitions(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]
    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    assert len(P.repetitions(np.array(b))) < len(b)


def test_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in P.query(spark, SMALL).collect()}
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        n, h = len(w), zlib.crc32(str(row.doc_id).encode())
        if n > 900:
            continue
        if h % 10 == 0 and n:
            g, old = h // 10, w[:]
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [*old[:a], *(old[a + (i - a) % p] for i in range(a, n))]
        runs = brute(w, 12)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
        assert got[row.doc_id] == want
