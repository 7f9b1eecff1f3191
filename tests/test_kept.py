import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import duplicates as D, similar as S, similar_index as I
from cairn.sources import catalog as C, ranges as G
from cairn.streaming import arrivals as A, jobs as J, reviews as R

# ---- arrivals


def snapshots(spark, path, rows):
    spark.createDataFrame(rows, "snapshot int, path string").write.mode("append").parquet(f"{path}/in")
    A.differences(spark.readStream.schema("snapshot int, path string").parquet(f"{path}/in"), path, known=spark.createDataFrame([("k",)], "path string"))
    return sorted(tuple(r) for r in A.differences_in(spark, path).collect())


def test_snapshots_tell_what_came_and_went_once(spark, tmp_path):
    path = str(tmp_path / "s")
    assert snapshots(spark, path, [(1, "a"), (1, "b"), (1, "b")]) == []
    first = [(2, "a", "removed"), (2, "c", "added"), (3, "b", "removed"), (3, "c", "removed")]
    # Known names come unannounced; snapshot 3 is empty.
    assert snapshots(spark, path, [(2, "b"), (2, "c"), (2, "k"), (3, None)]) == sorted([*first, (3, "k", "removed")])
    assert snapshots(spark, path, [(4, "a")]) == sorted([*first, (3, "k", "removed"), (4, "a", "added")])


def test_a_batch_that_failed_is_told_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    snapshots(spark, path, [(1, "a"), (1, "b")])
    between = A.between
    monkeypatch.setattr(A, "between", lambda *a: 1 / 0)
    with pytest.raises(Exception):  # noqa: B017
        snapshots(spark, path, [(2, "b"), (2, "c")])
    monkeypatch.setattr(A, "between", between)
    assert snapshots(spark, path, [(3, "c")]) == [(2, "a", "removed"), (2, "c", "added"), (3, "b", "removed")]


def test_listing_of_a_folder_goes_on_after_a_restart(spark, tmp_path):
    folder, log, out = tmp_path / "mounts", str(tmp_path / "log"), []
    folder.mkdir()
    for n in ("old", "here"):
        (folder / n).mkdir()
    (folder / "file").write_text("no folder")

    def run():
        q = A.watch(spark, str(folder), ["known"]).writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", log).start()
        try:
            q.processAllAvailable()
            yield
            q.processAllAvailable()
        finally:
            q.stop()

    for _ in run():
        (folder / "new").mkdir()
        (folder / "known").mkdir()
    assert out == [("new", "added")]
    (folder / "old").rmdir()  # while no stream runs
    (folder / "later").mkdir()
    for _ in run():
        pass
    assert sorted(out) == [("later", "added"), ("new", "added"), ("old", "removed")]


# ---- similarity kept up to date


def flipped(r, h, n):
    return h ^ sum(1 << i for i in r.sample(range(63), n))


def test_only_what_is_new_is_fingerprinted_and_probed(spark, tmp_path):
    r, path = random.Random(8), str(tmp_path / "index")
    base = [r.getrandbits(63) for _ in range(40)]
    items = {f"v{i}": base[i % 40] if i < 40 else flipped(r, base[i % 40], r.randint(0, 7)) for i in range(200)}
    asked = []

    def prints(v):
        asked.append(v.count())
        return v.select("key", "h")

    def versions(keys):
        return spark.createDataFrame([(k, items[k]) for k in keys], "key string, h long")

    def whole(keys):
        df = versions(keys).select(F.col("key").alias("id"), "h")
        return {tuple(x) for x in S.member_components(S.candidates(df, 6), S.members(df)).collect()}

    def now(keys, generation):
        return {tuple(x) for x in I.groups(spark, path, versions(keys), generation).collect()}

    first = [k for i, k in enumerate(items) if i % 100]
    told = I.update(spark, path, versions(first), prints, 6, 0)
    assert asked == [198] and told["printed"] == 198 and now(first, 0) == whole(first)
    told = I.update(spark, path, versions(items), prints, 6, 1)
    assert asked == [198, 2] and told["printed"] == 2 and told["probed"] <= 2 and now(items, 1) == whole(items)
    # A generation that runs again replaces itself; nothing new costs nothing.
    assert I.update(spark, path, versions(items), prints, 6, 1)["printed"] == 2 and now(items, 1) == whole(items)
    # What goes takes its links along; what comes again is printed again.
    few = [k for i, k in enumerate(items) if i % 3 and i >= 20]
    told = I.update(spark, path, versions(few), prints, 6, 2)
    assert told["printed"] == told["probed"] == 0 and told["gone"] > 0 and now(few, 2) == whole(few)
    told = I.update(spark, path, versions(items), prints, 6, 3)
    assert told["printed"] == 200 - len(few) and now(items, 3) == whole(items)


def test_a_wide_radius_is_kept_up_to_date_by_comparisons(spark, tmp_path):
    r, path = random.Random(9), str(tmp_path / "index")
    base = [r.getrandbits(63) for _ in range(30)]
    items = {f"v{i}": base[i % 30] if i < 30 else flipped(r, base[i % 30], r.randint(0, 20)) for i in range(150)}

    def versions(keys):
        return spark.createDataFrame([(k, items[k]) for k in keys], "key string, h long")

    few = [k for i, k in enumerate(items) if i % 10 and i > 5]
    for generation, keys in enumerate(([k for i, k in enumerate(items) if i % 10], items, few, items)):
        I.update(spark, path, versions(keys), lambda v: v.select("key", "h"), 18, generation)
        df = versions(keys).select(F.col("key").alias("id"), "h")
        want = {tuple(x) for x in S.member_components(S.candidates(df, 18), S.members(df)).collect()}
        assert {tuple(x) for x in I.groups(spark, path, versions(keys), generation).collect()} == want
    assert not os.path.exists(f"{path}/lookups")


def test_decisions_count_in_order_of_seq_whatever_piece_brings_them(spark, tmp_path):
    r = random.Random(6)
    said = {(seq % 5, seq): r.choice(["keep", "mark", "undo"]) for seq in range(300)}
    order = list(said)
    r.shuffle(order)
    for i in range(3):
        rows = [(*k, said[k]) for k in order[i::3]]
        spark.createDataFrame(rows, "item long, seq long, decision string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    want = {}
    for item in range(5):
        done = []
        for seq in range(item, 300, 5):
            done = done[:-1] if said[item, seq] == "undo" else [*done, said[item, seq]]
        want[item] = (done[-1] if done else None, len(done))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        e = J.source(spark, spark.read.parquet(str(tmp_path / "events.parquet")), f"{tmp_path}/event?.parquet")
        got = {x.item: (x.decision, x.moves) for x in J.collected(J.reduced(e), "update", ["item"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


# ---- reviews


def review(spark, tmp_path, batches, **more):
    with R.rocksdb(spark):
        for n, rows in enumerate(batches):
            spark.createDataFrame([(s, i, at, a, items, ix, g, rep) for s, i, at, a, items, ix, g, rep in rows], "session string, seq long, at_ms long, action string, items array<string>, index int, guarded boolean, repeat boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
            os.makedirs(f"{tmp_path}/all", exist_ok=True)
            for f in os.listdir(f"{tmp_path}/in{n}"):
                if f.endswith(".parquet"):
                    os.rename(f"{tmp_path}/in{n}/{f}", f"{tmp_path}/all/{n}-{f}")
        schema = "session string, seq long, at_ms long, action string, items array<string>, index int, guarded boolean, repeat boolean"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
        return {r.seq: (r.outcome, r.cursor, r.kept, r.marked) for r in J.collected(R.reviews(stream, **more), "append").collect()}


def e(seq, at, action, items=None, index=None, guarded=None, repeat=None):
    return ("s", seq, at, action, items, index, guarded, repeat)


def test_reviews(spark, tmp_path):
    first = [e(0, 0, "items", ["a", "b", "c"]), e(1, 100, "keep"), e(2, 120, "keep"), e(3, 200, "trash", guarded=True), e(4, 300, "trash", repeat=True), e(5, 400, "trash"), e(6, 500, "go", index=-1), e(7, 600, "keep"), e(8, 650, "undo")]
    second = [e(9, 700, "jump", index=99), e(10, 800, "keep"), e(11, 900, "undo"), e(12, 1000, "undo"), e(13, 1010, "undo"), e(14, 1100, "trash"), e(15, 1200, "trash"), e(16, 1300, "keep_all"), e(17, 1400, "hop")]
    # b goes, d comes: the cursor stays on c.
    third = [e(18, 2000, "items", ["d", "a", "c"]), e(19, 2100, "keep"), e(20, 2200, "undo"), e(21, 2300, "undo"), e(22, 2400, "undo")]
    got = review(spark, tmp_path, [first, second, third])
    assert got == {
        0: ("items", 0, 0, 0), 1: ("keep", 1, 1, 0), 2: ("bounce", 1, 1, 0), 3: ("protected", 1, 1, 0), 4: ("repeat", 1, 1, 0), 5: ("trash", 2, 1, 1), 6: ("go", 1, 1, 1), 7: ("keep", 2, 2, 0), 8: ("undo", 1, 1, 1),
        9: ("jump", 3, 1, 1), 10: ("finished", 3, 1, 1), 11: ("undo", 1, 1, 0), 12: ("undo", 0, 0, 0), 13: ("nothing", 0, 0, 0), 14: ("trash", 1, 0, 1), 15: ("trash", 2, 0, 2), 16: ("keep_all", 2, 2, 0), 17: ("unknown", 2, 2, 0),
        18: ("items", 2, 1, 0), 19: ("keep", 3, 2, 0), 20: ("undo", 2, 1, 0), 21: ("undo", 1, 0, 0), 22: ("nothing", 1, 0, 0),
    }


def test_the_oldest_steps_are_forgotten(spark, tmp_path):
    acts = [e(0, 0, "items", [str(i) for i in range(6)])] + [e(i, 100 * i, "keep") for i in range(1, 6)] + [e(10 + i, 1000 + i, "undo") for i in range(4)]
    got = review(spark, tmp_path, [acts], max_steps=3)
    assert got[12] == ("undo", 2, 2, 0) and got[13] == ("nothing", 2, 2, 0)


# ---- files on disk


def test_only_the_parts_asked_for_are_read(spark, tmp_path):
    r = np.random.default_rng(2)
    files = {"a/small": r.bytes(100), "a/copy": None, "head": r.bytes(300_000), "big": r.bytes(1_000_000), "big2": None, "other": None, "empty": b""}
    files["a/copy"], files["big2"] = files["a/small"], files["big"]
    files["other"] = files["big"][:70_000] + b"#" + files["big"][70_001:]
    for p, data in files.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(data)
    df = spark.createDataFrame([(p, len(d)) for p, d in files.items()] + [("gone", 5), ("gone2", 100)], "path string, size long")
    ends = {x.path: x for x in G.head_and_tail(df, str(tmp_path)).collect()}
    for p, d in files.items():
        assert (bytes(ends[p].head), bytes(ends[p].tail)) == (d[: G.HEAD], d[-G.TAIL :] if d else b"")
        assert ends[p].bytes_read == (len(d) if len(d) <= G.HEAD else G.HEAD + G.TAIL)
    assert ends["gone"].head is None and ends["gone"].bytes_read == 0
    got = {x.path: (x.hash, x.part_bytes) for x in D.hashed_on_disk(df, str(tmp_path)).collect()}
    content = spark.createDataFrame([(p, len(d), bytearray(d)) for p, d in files.items()], "path string, size long, content binary")
    assert {p: h for p, (h, _) in got.items()} == {x.path: x.hash for x in D.hashed(content, "content").collect()}
    assert {n for _, n in got.values()} == {100, 3 * G.WINDOW}


def test_results_come_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "BATCH_BYTES", 1_000)
    for i in range(30):
        (tmp_path / f"f{i}").write_bytes(bytes([i]) * 400)
    df = spark.createDataFrame([(f"f{i}", 400) for i in range(30)], "path string, size long")
    assert {x.path: bytes(x.head)[:1] for x in G.head_and_tail(df, str(tmp_path)).collect()} == {f"f{i}": bytes([i]) for i in range(30)}


def test_a_wide_and_a_deep_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "FOLDERS", 10)
    monkeypatch.setattr(C, "ROWS", 7)
    monkeypatch.setattr(C, "MAX_DEPTH", 6)
    for i in range(120):
        (tmp_path / "wide" / f"d{i}").mkdir(parents=True)
        (tmp_path / "wide" / f"d{i}" / "x.txt").write_text("1")
    deep = tmp_path.joinpath(*["n"] * (C.MAX_DEPTH + 3))
    deep.mkdir(parents=True)
    rows = [r.path for r in C.tree(spark, str(tmp_path)).collect()]
    assert sorted(rows) == sorted(["wide", *(f"wide/d{i}" for i in range(120)), *(f"wide/d{i}/x.txt" for i in range(120)), *("/".join("n" * k) for k in range(1, C.MAX_DEPTH + 1))])
