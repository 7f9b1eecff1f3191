import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import browse as B, similar as S, storage as T

from .test_operators import files


@pytest.mark.parametrize("hot", [False, True])
def test_range_pairs_on_a_grid(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "SHARE", 20)
    r = random.Random(hot)
    rows = [(i, r.choice([5_000, 5_001, 60_000]) if hot else r.randint(0, 400_000), r.choice([100, 101, 105, 200]), r.choice([100, 95])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, duration long, w int, h int")
    joined = []
    monkeypatch.setattr(S, "small", lambda df: joined.append(df) or df)
    got = sorted(tuple(x) for x in S.range_pairs(df).collect())
    close = lambda x, y: abs(math.log(x[2] / x[3]) - math.log(y[2] / y[3])) <= 0.05
    assert got == sorted((x[0], y[0]) for x in rows for y in rows if (x[1], x[0]) < (y[1], y[0]) and y[1] <= x[1] * 1.15 + 2000 and close(x, y))
    # No side of a key has much more than its share of the rows.
    cells = joined[0].collect()
    assert max(c.parts_b for c in cells) > 1 if hot else cells


def test_range_pairs_copy_few_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "MEETINGS", 2_000)
    r = random.Random(2)
    rows = [(i, r.randint(630_000, 700_000), 600 + 10 * r.randint(1, 50), 400) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, duration long, w int, h int")
    a, b, squares = S.range_sides(df, 1.15, 2_000, 0.05)
    assert 100 < squares <= 2 * S.SQUARES and a.count() + b.count() <= 50 * len(rows)
    close = lambda x, y: abs(math.log(x[2] / x[3]) - math.log(y[2] / y[3])) <= 0.05
    assert S.range_pairs(df).count() == sum(close(x, y) for i, x in enumerate(rows) for y in rows[:i])


def test_layouts_of_all_folders_are_those_of_each(spark):
    r = random.Random(3)
    f = files(spark, [(f"{'/'.join(r.choice('ab') for _ in range(r.randint(0, 3)))}/f{i}.jpg".lstrip("/"), r.randint(0, 5_000)) for i in range(120)])
    tiles = T.all_tiles(f, 6)
    got = {}
    for x in T.layouts(tiles, 800.0, 500.0).collect():
        got.setdefault(x.folder, {})[x.kind, x.name] = (x.x, x.y, x.w, x.h)
    by = {}
    for x in tiles.collect():
        by.setdefault(x.folder, []).append(((x.kind, x.name), x.bytes))
    for folder, some in by.items():
        want = {n: box for n, *box in T.squarified(some, 800.0, 500.0)}
        assert set(got[folder]) == set(want)
        for n, box in want.items():
            assert got[folder][n] == pytest.approx(tuple(box), abs=1e-6), (folder, n)
    one = {(x.kind, x.name): (x.bytes, x.items) for x in T.tiles(f, "a", 6).collect()}
    assert {(x.kind, x.name): (x.bytes, x.items) for x in tiles.where("folder = 'a'").collect()} == one


def test_reasons_tell_what_differs(spark):
    media = [
        ("k", "a.heic", "p/a.heic", "heic", 900, 10, 40, 30, 9_000, True, True), ("m", "a copy.jpg", "p/a copy.jpg", "jpg", 500, 20, 20, 30, 8_000, False, False), ("n", "b.jpg", "tmp/b.jpg", "jpg", 500, 20, 40, 20, 8_400, False, False),
        ("x", "x.jpg", "p/x.jpg", "jpg", 900, 20, 40, 30, None, False, False), ("y", "y.jpg", "p/y.jpg", "jpg", 800, 20, 40, 30, None, False, False), ("z", "z.jpg", "p/z.jpg", "jpg", 10, 20, 4, 3, None, False, False),
        ("s", "s.jpg", "p/s.jpg", "jpg", 9, 5, None, None, None, None, None), ("t", "t.jpg", "p/t.jpg", "jpg", 9, 5, None, None, None, None, None),
    ]
    m = spark.createDataFrame(media, "id string, name string, path string, ext string, size long, modified_ms long, w int, h int, duration_ms long, exif boolean, live boolean")
    g = spark.createDataFrame([("k", "m"), ("k", "n"), ("x", "y"), ("x", "z"), ("s", "t")], "keeper string, member string")
    got = {r.keeper: r.reasons for r in S.reasons(g, m).collect()}
    assert got == {"k": ["resolution", "longest", "live", "heic", "camera-data", "original-name", "oldest"], "x": ["least-compressed"], "s": ["equivalent"]}
    few = m.select("id", "name", "path", "ext", "size", "modified_ms")
    assert {r.keeper: r.reasons for r in S.reasons(g, few).collect()}["x"] == ["least-compressed"]


def test_totals_of_a_drive(spark):
    f = files(spark, [("a/x.jpg", 5), ("a/shut/y.mp4", 7), ("z.pdf", 3)])
    df = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    row = B.drive_totals(f, B.folders_of(f), df("a", "a/x.jpg", "a/shut", "a/shut/y.mp4", "gone"), df("a/shut")).first()
    assert (row["files"], row.folders, row.favorites, row.photos, row.videos, row.documents, row.links, row.bytes) == (2, 2, 3, 1, 0, 1, 0, 8)
    none = B.drive_totals(f.limit(0), B.folders_of(f.limit(0)), df("a"), df("a/shut")).first()
    assert none["files"] == none.bytes == 0


def test_cleanup_shuffles_no_texts(spark, tmp_path):
    from cairn.plans.queries import QUERIES

    r = random.Random(7)
    texts = [r.randbytes(50_000).hex() for _ in range(8)]
    rows = [(i, texts[i % 8], "en", "src1", 100_000) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    def written():
        store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None))
        return sum(s.shuffleWriteBytes() for s in stages if s.stageId() > last), max(s.stageId() for s in stages)

    last = -1
    last = written()[1]
    got = {x.doc_id: x.outcome for x in QUERIES["cleanup_execution"](spark, str(tmp_path)).collect()}
    # Of the first copies 0 and 6 have changed, so theirs stay; 12 and 18 (units 4 and 2) have changed themselves.
    assert got == {i: "skipped" if i % 8 in (0, 6) else "changed" if i % 6 == 0 else "trash" for i in range(8, 24)}
    assert 0 < written()[0] < 1_000_000 < sum(len(x[1]) for x in rows)
