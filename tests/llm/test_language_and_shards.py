import zlib

import duckdb
import numpy as np

from cairn.llm import language_id as L, sharding as S

from ..conftest import SMALL, same


def test_held_out_accuracy(spark):
    lang = dict(map(tuple, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()))
    rows = L.query(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_spans_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs)
    mixed = "The and attion to thanedble the, anea. Eriner thanea. " * 5 + "Nicht aulich für sch erüver enau sch der. " * 5
    rows = [(1, mixed, "x"), (2, None, None), (3, "", None), (4, "123 € ...", None), (5, "the " * 30_000, None), (5, "the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = L.label(df, model).collect()
    assert [(s.first, s.last, s.lang) for s in got[0].spans] == [(0, 45, "en"), (45, 85, "de")]
    assert [r.lang_pred for r in got[1:4]] == ["und"] * 3 and got[4].lang_pred == "en" and got[2].score == 0
    assert {r.lang_pred for r in L.label(df, L.fit(docs.limit(0))).collect()} == {"und"} and L.label(df.limit(0), model).count() == 0


def test_scripts_narrow_languages():
    m = L.Model({"en": ["the cat and the dog"] * 20, "ru": ["кот и собака на столе"] * 20, "el": ["η γάτα και ο σκύλος"] * 20})
    import pyarrow as pa

    (_, _, _, _, state, _), = L.spans(pa.array(["the кот γάτα"]), m)
    assert [m.langs[s] for s in state] in (["ru", "ru", "el"], ["en", "ru", "el"])


def test_labels_same_as_plain_python(spark):
    """Words, trigrams, scripts and the best path, letter by letter and without arrays over texts."""
    import math

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    model = L.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, "The and кот 漢字 über, l'été!"), (-2, "x"), (-3, None)]
    got = {r.doc_id: r for r in L.label(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}

    def slot(a, b, c):
        return ((((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) % 2**32) * 0x27D4EB2F) % 2**32 >> 16

    for i, t in rows:
        words, word = [], b""
        for byte in (t or "").encode() + b" ":
            if byte >= 0x80 or chr(byte).isalpha():
                word += bytes([byte + 32 if 0x41 <= byte <= 0x5A else byte])
            elif word:
                words.append(word)
                word = b""
        best = [0.0] * len(model.langs)
        back = []
        for n, w in enumerate(words):
            padded = b" " + w + b" "
            score = [sum(float(model.logs[slot(*padded[k : k + 3]), j]) for k in range(len(w))) for j in range(len(model.langs))]
            scripts = {int(L._SCRIPT[np.searchsorted(L._FIRST, min(ord(c), 0x2000) if ord(c) > 0xFFFF else ord(c), side="right") - 1]) for c in w.decode("utf-8", "replace") if ord(c) > 127} - {0}
            for s in scripts:
                if model.has[s].any():
                    score = [x if model.has[s][j] else x - 1e4 for j, x in enumerate(score)]
            top = max(range(len(best)), key=best.__getitem__)
            jump = best[top] - (L.SWITCH if n else 0)
            back.append([j if best[j] >= jump else top for j in range(len(best))])
            best = [max(best[j], jump) + score[j] for j in range(len(best))]
        path, state = [], max(range(len(best)), key=best.__getitem__)
        for b in reversed(back):
            path.append(state)
            state = b[state]
        letters = [0] * len(best)
        for w, state in zip(words, reversed(path), strict=True):
            letters[state] += len([x for x in w if chr(x).isalpha() and x < 128 or x >= 0xC2])
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert got[i].lang_pred == model.langs[max(range(len(best)), key=letters.__getitem__)] and math.isclose(got[i].score, max(letters) / sum(letters), abs_tol=1e-6), (i, got[i])


def test_more_languages_than_a_byte_counts(spark):
    import random

    r = random.Random(2)
    own = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 9))) for _ in range(12)] for k in range(150)}
    text = lambda lang, n=60: " ".join(r.choice(own[lang]) for _ in range(n))
    rows = [(i, text(lang), lang) for i, lang in enumerate(list(own) * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert len(model.langs) == 150
    got = {x.doc_id: x.lang_pred for x in L.label(spark.createDataFrame([(i, text(lang), lang) for i, lang in enumerate(own)], "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i] == lang for i, lang in enumerate(own)) >= 148


def test_fit_counts_whole_texts_of_the_sample(spark):
    rows = [(i, "aaa " * 30_000 + ("zebra " * 50 if i % 2 else "quokka "), "xy"[i % 2]) for i in range(20)] + [(None, "xylophone", "y"), (99, None, "x"), (98, "lost", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, want = L.fit(df), L.Model({"x": [t for _, t, lang in rows if lang == "x" and t], "y": [t for _, t, lang in rows if lang == "y"]})
    assert got.langs == ["x", "y"] and np.allclose(got.logs, want.logs) and (got.has == want.has).all()
    few = L.fit(df, sample=3)
    first = sorted((zlib.crc32(str(i).encode()), t) for i, t, lang in rows if lang == "x" and t)[:3]
    assert np.allclose(few.logs[:, 0], L.Model({"x": [t for _, t in first]}).logs[:, 0])


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(4)
    for _ in range(20):
        n = r.integers(0, 6, 3)
        score = r.normal(0, 8, (n.sum(), 3)).astype(np.float32)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        got = L._viterbi(score, first, n)
        for a, k in zip(first, n, strict=True):
            value = lambda p: sum(score[a + i, s] for i, s in enumerate(p)) - L.SWITCH * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: E731, B023
            best = max((value(p) for p in np.ndindex(*[3] * k)), default=0)
            assert abs(value(tuple(got[a : a + k])) - best) < 1e-3


def test_shards_same_as_duckdb(spark, duck):
    same(S.query(spark, SMALL), duck.sql(S.SQL))


def test_small_limits(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = S.assign(docs, 20_000).collect()
    assert len(rows) == docs.count()
    size, depth = {}, {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        depth[r.shard] = r.depth
        assert len(r.shard) == r.depth
    assert all(b <= 20_000 for b in size.values()) and all(size[r.shard] == r.shard_bytes and not r.overflow for r in rows)
    assert not any(a != b and b.startswith(a) for a in size for b in size)
    for a in size:  # no split without need: both halves together exceed the limit
        assert a == "" or sum(b for s, b in size.items() if s.startswith(a[:-1])) > 20_000


def test_shard_edges(spark, tmp_path):
    rows = [(1, "x" * 100, 1), (1, "x" * 100, 2), (1, "y" * 100, 3), (None, None, 4), (2, "", 5), (3, "z" * 500, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, depth int")
    got = S.assign(df, 150).collect()
    assert len(got) == 6
    over = {r.doc_id for r in got if r.overflow}
    assert over == {1, 3} and len({r.shard for r in got if r.doc_id == 1}) == 2  # only equal rows and one long row exceed it
    assert S.assign(df.limit(0), 150).count() == 0
    S.write(df.where("doc_id = 3"), str(tmp_path / "out"), 10**6)
    assert duckdb.sql(f"select count(*) from '{tmp_path}/out/**/*.parquet'").fetchall()[0][0] == 1


def test_write_with_a_parted_key_and_null_keys(spark, tmp_path):
    rows = [(1, f"{i:03d}" + "x" * 97, i) for i in range(40)] + [(None, f"{i:03d}" + "y" * 97, 40 + i) for i in range(10)] + [(None, None, 50), (2, "", 51), (1, "000" + "x" * 97, 52)]
    S.write(spark.createDataFrame(rows, "doc_id long, text string, n int"), str(tmp_path / "out"), 600)
    got = duckdb.sql(f"select n, doc_id, text, filename from read_parquet('{tmp_path}/out/**/*.parquet', filename = true)").fetchall()
    assert sorted(r[0] for r in got) == list(range(53)) and {(r[1], r[2], r[0]) for r in got} == set(rows)
    size = {}
    for r in got:
        shard = r[3].rsplit("/", 2)[-2]
        size[shard] = size.get(shard, 0) + len(r[2] or "")
    assert max(size.values()) <= 600 and len(size) > 8
