import math
import random
import re
from collections import Counter

from cairn.llm import search as S
from cairn.llm.entry import oracle_sql

from ..conftest import SMALL, same

TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, top=20):
    bags = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (key, _), bag, n in zip(docs, bags, sizes, strict=True):
            m = 100 - 25 + (25 * n * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if s > 0:
                scored.append((-s, key))
        out += [(item, k + 1, key, -s) for k, (s, key) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_equal_to_brute_force(spark, monkeypatch):
    r = random.Random(2)
    vocabulary = [f"Term{i}" for i in range(40)] + ["É", "x-y", "12", "ß"]
    text = lambda n: " ".join(vocabulary[min(len(vocabulary) - 1, int(r.expovariate(0.12)))] for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(80)] + [(80, None), (81, "...")]
    items = [(i, text(r.randint(0, 12))) for i in range(9)] + [(9, None), (10, "none of these")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted(tuple(x) for x in S.search(d, q).collect()) == want
    monkeypatch.setattr(S, "MAX_TERMS", 3)  # more terms than are held: all postings are made
    assert sorted(tuple(x) for x in S.search(d, q).collect()) == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, "a b", 7), (2, "c d e", 7), (3, None, 7)], "doc_id long, text string, score int")
    items = spark.createDataFrame([("p", "A", 1), ("p", "A", 1), ("q", None, 1), (None, "c", 1)], "item_id string, text string, rank int")
    got = [tuple(r) for r in S.search(docs, items).collect()]
    for_p = sorted((r[1], r[2]) for r in got if r[0] == "p")
    assert for_p == [(1, None)] * 2 + [(2, 1)] * 2 + [(3, 1)] * 2 and [(r[1], r[2]) for r in got if r[0] is None] == [(1, 2)]
    assert S.search(docs.limit(0), items).count() == 0 and S.search(docs, items.limit(0)).count() == 0


def test_postings_are_in_order_of_bucket_and_term(spark):
    index = S.index(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert index.where("bucket >= 0 AND bucket <> pmod(h, 256)").count() == 0
    assert index.groupBy("row", "term").count().where("count > 1").count() == 0


def test_query(spark, duck):
    same(S.query(spark, SMALL), duck.sql(oracle_sql()["op13_ranked_search"]))
