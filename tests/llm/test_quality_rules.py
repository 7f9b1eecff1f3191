import re
from collections import Counter

import numpy as np
import pyarrow as pa

from cairn.llm import quality_rules as Q

from ..conftest import SMALL


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_counts_and_verdicts(spark):
    docs = dict(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()))
    rows = Q.query(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        b = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.kept and r.base_failed)


def test_labels_agree(spark):
    kept = {r.doc_id: r.kept or r.base_failed for r in Q.query(spark, "/root/testdata/sf0.01").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    failed = {r.doc_id for r in Q.query(spark, "/root/testdata/sf0.01").where("base_failed").collect()}
    assert np.mean([(d not in failed and kept[d]) for d, q in labels if q == 1 and d not in failed]) > 0.99
    assert np.mean([not kept[d] for d, q in labels if q == 0 and d not in failed]) > 0.9


def test_kept_is_the_verdict_of_em_document_by_document(spark):
    """The same votes and prior, without the histogram, patterns or rounding tricks."""
    docs = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    got = [r for r in Q.query(spark, SMALL).orderBy("doc_id").collect()]
    votes = [v for d in docs for v in Q.votes({k: np.array(x) for k, x in Q.features(pa.array([d])).items()}).tolist()]
    anchor, good, table = max(10.0, 0.02 * len(docs)), 0.7, [[row[:] for row in Q.PRIOR] for _ in Q.RULES]
    for _ in range(3000):
        p = []
        for v in votes:
            bad, fine = 1 - good, good
            for r, x in enumerate(v):
                bad, fine = bad * table[r][0][x + 1], fine * table[r][1][x + 1]
            p.append(fine / (bad + fine))
        for r in range(len(Q.RULES)):
            for c in (0, 1):
                sums = [anchor * Q.PRIOR[c][k] + sum((w if c else 1 - w) for w, v in zip(p, votes, strict=True) if v[r] == k - 1) for k in range(3)]
                table[r][c] = [s / sum(sums) for s in sums]
        was, good = good, (sum(p) + 0.7 * anchor) / (len(p) + anchor)
        if abs(was - good) < 1e-12:
            break
    for r, w in zip(got, p, strict=True):
        assert abs(r.quality - w) < 1e-4 and (r.kept == (not r.base_failed and w >= 0.5) or abs(w - 0.5) < 1e-4)


def test_rules_vote_on_long_texts_too():
    r = np.random.default_rng(1)
    names = [x.split()[0] for x in Q.FEATURES.split(", ")]
    for n in (1999, 2000, 2001, 20_000):
        few, many = " ".join(f"w{i}" for i in r.integers(0, 6, n)), " ".join(f"w{i}" for i in (r.pareto(1.0, n) * 30).astype(int))
        v = Q.votes(Q.features(pa.array([few, many])))[:, Q.RULES.index("variety")]
        assert v.tolist() == [-1, 1], n
    assert set(names) == set(Q.features(pa.array(["a"])))


def test_em_finds_accuracies():
    """In the regime that the rules are written for: they seldom catch a good document and miss many bad ones."""
    r = np.random.default_rng(0)
    good, caught = r.random(20_000) < 0.8, (0.5, 0.4, 0.7, 0.45)
    votes = np.stack([-(r.random(len(good)) < np.where(good, 0.01, a)).astype(int) for a in caught], 1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, table = Q.fit(patterns, counts.astype(float))
    p = Q.posterior(patterns, share, table)[at.ravel()]
    assert abs(share - 0.8) < 0.08 and ((p > 0.5) == good).mean() > 0.93
    assert all(abs(table[i, 0, 0] - a) < 0.15 and table[i, 1, 0] < 0.03 for i, a in enumerate(caught))


def test_edge_cases(spark):
    schema = "doc_id long, text string, n_words string, lang string"
    assert Q.assess(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "x", None), (2, "", None, "en"), (2, "", None, "en"), (3, "a\n" * 30_000, None, None), (None, "é ü\nü", None, None), (5, "\n\n \n", None, None)]
    got = Q.assess(spark.createDataFrame(rows, schema))
    assert got.count() == 6 and got.where("kept").count() == 0 and "n_words" in got.columns
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].n_repeat_words == 30_000 and by[3].n_dup_lines == 29_999 and by[None].word_chars == 3 and by[5].n_words == 0
    assert Q.keep_good(spark.createDataFrame(rows, schema)).columns == ["doc_id", "text", "n_words", "lang"]


def test_keep_good_keeps_what_assess_keeps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a = {r.doc_id for r in Q.assess(docs).where("kept").collect()}
    assert {r.doc_id for r in Q.keep_good(docs).collect()} == a
