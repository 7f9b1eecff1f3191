import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.llm import ngram_join as N

from ..conftest import SMALL


def brute(docs):
    """(set size, smallest linked id) of each id, comparing every pair that shares a shingle."""
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for j, n in Counter(j for t in s for j in holders.get(t, ())).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for t in s:
            holders.setdefault(t, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def made(seed, n=220):
    r, docs = random.Random(seed), []
    for i in range(n):
        if docs and r.random() < 0.6:
            w = (r.choice(docs)[1] or "").split()
            for _ in range(r.randint(0, 4)):
                if w:
                    w[r.randrange(len(w))] = f"x{r.randint(0, 50)}"
            docs.append((i, " ".join(w)))
        else:
            docs.append((i, None if r.random() < 0.1 else " ".join(f"W{r.randint(0, 30)}" for _ in range(r.choice([0, 1, 3, 4, 5, 7, 8, 20, 60])))))
    return docs


@pytest.mark.parametrize("seed, bucket", [(1, 1000), (2, 10**6)])
def test_same_as_brute_force(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(N, "BUCKET", bucket)  # many token buckets and blocks of cells, or one
    docs = made(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert result(N.join(df)) == brute(docs)


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert result(N.query(spark, SMALL)) == brute(docs)


def test_hot_shingles_gather_in_no_task(spark, monkeypatch):
    """A passage in every document and a group of near copies of a third of them: no bucket gets more than its share."""
    import numpy as np

    monkeypatch.setattr(N, "BUCKET", 2000)
    r = random.Random(3)
    common, base = "this passage stands in every single document of the corpus", [f"b{i}" for i in range(40)]
    docs = [(i, " ".join([common, *(base[:39] if i % 3 == 0 else [f"w{r.randint(0, 10**6)}" for _ in range(30)]), f"own{i}"])) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6).cache()
    got = result(N.join(df))
    assert got == brute(docs) and len({c for i, (_, c) in got.items() if i % 3 == 0}) == 1
    of = N.K.cut(N.sets(df))
    hot = N.hot_tokens(of)
    assert 40 <= len(hot[0]) <= 60 and set(hot[1].tolist()) <= {300, 900}
    bits = int(np.ceil(np.log2(of.select(F.sum("n_shingles")).first()[0] / N.BUCKET)))
    load = [x.n for x in N._scattered(df, "text", 5, bits, hot).where("bucket >= 0").groupBy("bucket").agg(F.sum(F.octet_length("dfs") / 2).alias("n")).collect()]
    assert max(load) < 2 * N.BUCKET and sum(load) < of.select(F.sum("n_shingles")).first()[0] - 900 * 5
    # Each batch sends a prefix token once, whatever the number of its nodes.
    nodes = N.K.cut(N._prefixed(N._shared_tokens(df, "text", 5, bits, hot), 3, 4))
    sent = N._tied(nodes).where("bucket >= 0").select(F.sum(F.octet_length("own") / 8)).first()[0]
    assert sent <= 3 * 60 * max(1, nodes.rdd.getNumPartitions()) < nodes.select(F.sum("prefix")).first()[0]
    df.unpersist()


def test_hot_tokens_past_their_bound_go_the_usual_way(spark, monkeypatch):
    for most, share in ((0, 1024), (3, 1024), (1 << 20, 8)):
        monkeypatch.setattr(N, "HOT_TOKENS", most)
        monkeypatch.setattr(N, "HOT", share)
        docs = made(5, 150)
        assert result(N.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs), (most, share)


def test_a_large_group_needs_no_pair_rows(spark):
    base = [f"b{i}" for i in range(60)]
    docs = [(i, " ".join([*base[:59], f"own{i}"])) for i in range(300)] + [(1000 + i, " ".join(base)) for i in range(200)]
    got = result(N.join(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {c for _, c in got.values()} == {0} and len(got) == 500


def test_edge_cases(spark):
    schema = "doc_id long, text string, node long, component_id string"
    assert N.join(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b", 1, "x"), (1, "a b", 1, "x"), (2, "A  b\n", None, None), (3, "", 1, None), (4, None, 2, None), (5, " \t", 2, None), (6, "q " * 50_000, 3, None)]
    got = N.join(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6)]
    kept = N.keep_one(spark.createDataFrame(rows, schema))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 3, 4, 5, 6] and kept.columns == ["doc_id", "text", "node", "component_id"]


def test_keep_one_with_null_and_repeated_keys(spark):
    long = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    rows = [
        (None, long("a"), 1), (None, long("b"), 2), (None, long("b"), 3), (None, long("b") + " end", 4), (None, None, 5), (None, "", 6),  # null ids: one of the b's, all others
        (7, long("c"), 7), (7, long("c") + " end", 8), (7, long("d"), 9),  # one id: of the c's one, and d
        (3, long("e"), 10), (9, long("e"), 11), (9, long("f"), 12), (None, long("f"), 13), (4, None, 14), (4, None, 15),  # 9 goes as a copy of 3 and stays as f
    ]
    got = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    left = {r.n for r in got.collect()}
    assert got.count() == len(left) and got.columns == ["doc_id", "text", "n"]
    assert left - {2, 3, 4, 7, 8} == {1, 5, 6, 9, 10, 12, 14, 15} and len(left & {2, 3, 4}) == 1 and len(left & {7, 8}) == 1


def test_packed_arrays_round_trip():
    import numpy as np

    x = np.sort(np.random.default_rng(1).integers(0, 2**48, 1000).astype(np.uint64))
    assert (N._unplanes(N._planes(x)) == x).all() and (N._large(N._small(x)) == x).all()
    assert F is not None
