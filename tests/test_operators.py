import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import kinds, paths, values
from cairn.operators import browse as B, duplicates as D, findings as X, integrity as I, metadata as M, organize as O, plan as P, similar as S, storage as T
from cairn.sources import catalog as C
from cairn.streaming import jobs as J


def files(spark, names):
    rows = [x if isinstance(x, tuple) else (x, 1) for x in names]
    return C.described(spark.createDataFrame(rows, "path string, size long").withColumn("modified_ms", F.lit(0).cast("long")).withColumn("created_ms", F.lit(None).cast("long")))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def names(df, column="path"):
    return [r[column] for r in df.collect()]


def test_browse_order_search_and_scope(spark):
    f = files(spark, ["a/IMG_10.png", "a/IMG_2.png", "a/Cámara.jpg", "a/b/IMG_3.png", "z.txt"])
    assert names(B.browse(f, B.Query(folder="a"))) == ["a/Cámara.jpg", "a/IMG_2.png", "a/IMG_10.png"]
    assert names(B.browse(f, B.Query(folder="a", recursive=True, search="camara"))) == ["a/Cámara.jpg"]
    assert names(B.browse(f, B.Query(folder="a", recursive=True, search="a/img"))) == []
    assert names(B.browse(f, B.Query(scope="library", search="img png", desc=True))) == ["a/IMG_10.png", "a/b/IMG_3.png", "a/IMG_2.png"]
    assert names(B.browse(f, B.Query(folder="nowhere"))) == []


def test_folders_first_and_hidden_by_kind(spark):
    f = files(spark, ["a/x.png", "b.png"]).withColumn("is_dir", F.lit(False))
    d = B.folders_of(f).withColumn("is_dir", F.lit(True)).withColumn("kind", F.lit("folder"))
    rows = f.unionByName(d, allowMissingColumns=True)
    assert names(B.browse(rows, B.Query())) == ["a", "b.png"]
    assert names(B.browse(rows, B.Query(recursive=True))) == ["b.png", "a/x.png"]
    assert names(B.browse(rows, B.Query(search="a", kind="photo", everywhere=True))) == ["a/x.png"]


def test_boundaries(spark):
    f = files(spark, ["p/a", "p/q/b", "c", "pp/d"])
    got = {r.path: r.boundary for r in B.boundaries(f, spark.createDataFrame([("p",), ("p/q",)], "folder string")).collect()}
    assert got == {"p/a": 1, "p/q/b": 3, "c": 0, "pp/d": 0}


def test_listable_and_paths(spark):
    rows = [("a/.git/x", False), ("a/My.app/x", False), ("$RECYCLE.BIN/x", False), ("a/Thumbs.db", False), ("a/b.txt", True), ("My.app.txt", True), ("x" * 5000, False)]
    df = spark.createDataFrame(rows, "path string, ok boolean")
    assert df.where(paths.listable("path") != F.col("ok")).count() == 0
    assert one(spark, paths.ext_of(F.lit(".hidden"))) == "" and one(spark, paths.ext_of(F.lit("a.B.JPG"))) == "jpg"
    assert one(spark, paths.link_escapes(F.lit("a/l"), F.lit("../../x"))) and not one(spark, paths.link_escapes(F.lit("a/l"), F.lit("../x")))
    assert one(spark, paths.link_escapes(F.lit("l"), F.lit("/etc")))
    assert one(spark, paths.numbered(F.lit("photo 2.jpg"), F.lit(3))) == "photo 3.jpg"
    assert one(spark, paths.sanitized_names(F.lit("a.jpg"), 2)) == ["a-sanitized.jpg", "a-sanitized-2.jpg"]
    assert one(spark, paths.display_safe(F.lit("a‮b\tc"))) == "a�b�c"
    assert one(spark, paths.location(F.lit("a/b/c"), "a")) == "b"


def test_scan_tree(spark, tmp_path):
    for p, data in {"a/x.jpg": "1", "a/.h": "2", "b/Thing.app/y": "3", "c.txt": "4"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(data)
    (tmp_path / "link").symlink_to("../out")
    (tmp_path / "hard.txt").hardlink_to(tmp_path / "c.txt")
    rows = {r.path: r for r in C.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "a/x.jpg", "b", "c.txt", "link", "hard.txt"} | ({"b/Thing.app"} & set(rows))
    assert rows["link"].kind == "link" and rows["link"].link_outside and rows["a"].kind == "folder"
    assert set(names(C.one_per_file(C.scan(spark, str(tmp_path)).where("NOT is_dir AND link IS NULL")))) == {"a/x.jpg", "c.txt"}
    assert C.contents(spark, str(tmp_path), "*.jpg").count() == 1


def test_storage(spark):
    f = files(spark, [("2024/a.jpg", 3000), ("2024/b.jpg", 5000), ("b.mp4", 100)])
    assert {r.folder: (r.bytes, r.files) for r in T.rollup(f).collect()} == {"2024": (8000, 2)}
    assert [(r.kind, r.name, r.bytes) for r in T.tiles(f, "").collect()] == [("folder", "2024", 8000), ("file", "b.mp4", 100)]
    boxes = T.squarified([("a", 6), ("b", 6), ("c", 4), ("d", 3), ("e", 2), ("f", 2), ("g", 1)], 6, 4)
    assert sum(w * h for *_, w, h in boxes) == pytest.approx(24) and all(max(w / h, h / w) < 4 for *_, w, h in boxes)
    for ms, y in ((0, 1970), (1_704_067_199_000, 2023), (1_704_067_200_000, 2024)):
        assert one(spark, values.year_of(F.lit(ms))) == y
    d = spark.createDataFrame([("e",), ("e/f",), ("e/f/g",), ("2024",), ("2024/h",)], "path string")
    assert {r.path: r.nested for r in T.empty_folders(d, f).collect()} == {"e": 2, "2024/h": 0}


def test_copies(spark):
    rows = [("Downloads/a.jpg", "same"), ("Photos/a.jpg", "same"), ("x/a copy.jpg", "same"), ("y", "diff"), ("z", "dif2"), ("e1", ""), ("e2", "")]
    f = C.described(spark.createDataFrame(rows, "path string, content string").withColumn("size", F.length("content").cast("long")).withColumn("modified_ms", F.lit(5)).withColumn("created_ms", F.lit(None).cast("long")))
    h = D.hashed(f, "content")
    assert [(g.members, g.recoverable) for g in D.groups(h).collect()] == [(3, 8)]
    kept = D.with_keeper(D.members(h), ["size", "hash"])
    assert names(kept.where("keep")) == ["Photos/a.jpg"]
    assert D.reasons(kept, ["size", "hash"]).first().reasons == ["others-temporary", "others-copy-named", "in-media-folder"]


def test_partial_hash_sees_only_its_windows(spark):
    big = bytearray(b"a" * (4 * D.PART))
    other = big.copy()
    other[D.PART + 10] = 98
    df = spark.createDataFrame([(bytes(big),), (bytes(other),)], "content binary").withColumn("size", F.octet_length("content"))
    assert df.select(D.partial_hash("content")).distinct().count() == 1
    assert D.hashed(df, "content").select("hash").distinct().count() == 2


def test_live_groups_lock_lone_halves(spark):
    rows = [("a/1.jpg", "S"), ("a/1.mov", "M"), ("b/2.jpg", "S"), ("b/2.mov", "M"), ("c/3.jpg", "T"), ("c/3.mov", "N"), ("d/t.jpg", "T")]
    f = C.described(spark.createDataFrame(rows, "path string, hash string").withColumn("size", F.lit(1).cast("long")))
    got = D.live_groups(f, D.live_pairs(f, ["jpg"], ["mov"]))
    by = {r.path: (r.unit, r.locked) for r in got.collect()}
    assert by["a/1.jpg"][0] == by["b/2.mov"][0] and by["c/3.jpg"] == ("T", True) and by["d/t.jpg"] == ("T", False)


def test_plan_violations(spark):
    m = spark.createDataFrame([("u", "a", False), ("u", "b", False), ("v", "c", True), ("v", "d", False)], "unit string, path string, locked boolean")
    p = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "c"), ("w", "z"), ("v", "c")], "unit string, path string")
    assert {tuple(r) for r in D.plan_violations(p, m).collect()} == {("u", "all-copies"), ("v", "locked"), ("w", "no-member"), ("v", "repeated")}


def test_snapshots(spark, tmp_path):
    a = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("k", 2, "z")], "rel string, size long, sha256 string")
    b = spark.createDataFrame([("a", 1, "w"), ("new", 1, "y"), ("k", 2, "z")], "rel string, size long, sha256 string")
    assert {tuple(r) for r in I.diff(a, b).collect()} == {("a", "changed"), ("b", "missing"), ("new", "added"), ("k", "unchanged")}
    s = I.Snapshots(spark, str(tmp_path / "s"))
    s.save("01", a)
    s.save("02", b)
    assert [r.snapshot_id for r in s.all().collect()] == ["02", "01"] and s.load("01").count() == 3
    with pytest.raises(Exception):
        s.save("01", a)
    assert one(spark, I.sha256(F.lit("abc"))) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_types(spark):
    rows = [(b"RIFF\0\0\0\0WEBPxxxx", "webp"), (b"\0\0\0\x18ftypheic", "heif"), (b"\0\0\0\x18ftypisom", "mp4"), (b"\0\0\0\x08moov", "mov"), (b"OggS" + b"\0" * 24 + b"OpusHead", "opus"), (b"\x1aE\xdf\xa3....webm", "webm"), (b"PK\x03\x04" + b"\0" * 22 + b"\x08\0\0\0mimetypeapplication/epub+zip", "epub"),
            (b"PK\x03\x04" + b"\0" * 26, "zip"), (b"\xca\xfe\xba\xbe\0\0\0\x02", "macho"), (b"\xca\xfe\xba\xbe\0\0\0\x34", "javaclass"), (b"#!/bin/sh", "shebang"), (b"  <?xml version='1'?><svg/>", "svg"), (b"<?xml ?><a/>", "xml"), (b"hello", "text"), (b"\x00\x01\x02\xff", "unknown"), (b"", "empty"), (b"\xff\xfb\x90\0", "mp3"), (b"\xff\xf1P", "aac"), (b"x" * 257 + b"ustar", "tar")]
    got = [r.t for r in spark.createDataFrame(rows, "content binary, want string").select(kinds.type_of("content").alias("t")).collect()]
    assert got == [w for _, w in rows]


def test_brands_cut_texts_and_far_marks(spark):
    ftyp = lambda brand: b"\0\0\0\x18ftyp" + brand + b"\0\0\0\0"
    rows = [(ftyp(b"M4V "), "m4v"), (ftyp(b"M4VH"), "m4v"), (ftyp(b"M4A "), "m4a"), (ftyp(b"M4B "), "m4a"), (ftyp(b"M4XX"), "mp4"), (b"wOFF\0", "woff"), (b"wOFx\0", "unknown"), (b"wOF2", "text"), (b"\0\0\1\0\1\0", "unknown"), (b"\0\0\1\0\1\0\0", "ico"),
            ("é".encode() * 3000, "text"), ("aé漢😀".encode()[:-1], "text"), ("aé漢😀".encode()[:-2], "text"), ("aé漢😀".encode()[:-4] + b"\xff", "unknown"), (b"a\xe0\x80", "unknown"), (b"a\x0b", "unknown"), (b"a\x0c\r\n\t", "text"), (b"PK\x03\x04" + b"\0" * 200_000 + b"[Content_Types].xml", "ooxml"),
            (b"\xef\xbb\xbf \n<!DOCTYPE HTML>", "html"), (b"<?xml?>" + b" " * 900 + b"<svg", "svg"), (b"<?xml?><plist", "plist"), (b"MM\0*\0\0\0\0CR", "cr2"), (b"BM" + b"\0" * 23, "unknown"), (b"BM" + b"\0" * 24, "bmp"), (b"\xca\xfe\xba\xbe\0\0\0\x14", "javaclass"), (b"\xca\xfe\xba\xbe\0\0\0\x13", "macho")]
    rows[7] = (b"wOF2", "woff")
    df = spark.createDataFrame(rows, "content binary, want string").select("want", kinds.type_of("content").alias("t"))
    assert [(r.want, r.t) for r in df.collect() if r.want != r.t] == []


def test_narrow_classes(spark):
    rows = [(b"\0\0\0\x18ftypqt  ", "mov", "mov"), (b"\0\0\0\x18ftypheic", "heic", "heif"), (b"\0\0\0\x18ftypavif", "avif", "unknown"), (b"\0\0\0\x18ftypM4V ", "m4v", "mp4"), (b"\0\0\0\x08moov", "mov", "mov"), (b"\0\0\0\x08moov", "mp4", "unknown"),
            (b"\x1aE\xdf\xa3.webm", "webm", "webm"), (b"\x1aE\xdf\xa3.matroska", "mkv", "unknown"), (b"MZ", "txt", "executable"), (b"plain", "txt", "text"), (b"plain", "doc", "unknown"), (b"%PDF-1", "x", "pdf"), (b"RIFF\0\0\0\0WEBP", "jpg", "webp")]
    df = spark.createDataFrame(rows, "content binary, ext string, want string").withColumn("got", kinds.sniff("content", "ext"))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []
    got = {(r.ext, r.got): (r.c, r.o) for r in df.select("ext", "got", kinds.claimed_classes("ext").alias("c"), kinds.may_open("ext", "got").alias("o")).collect()}
    assert got["mov", "mov"] == (["mp4", "mov"], True) and got["txt", "executable"] == (["text"], False) and got["txt", "text"] == (["text"], True) and got["x", "pdf"] == (None, False)


def test_header_dimensions(spark):
    jpeg = b"\xff\xd8\xff\xe0\0\x10" + b"J" * 14 + b"\xff\xff\xc4\0\x04ab\xff\xc2\0\x11\x08" + (300).to_bytes(2, "big") + (500).to_bytes(2, "big") + b"\0" * 9
    riff = b"RIFF\0\0\0\0WEBP"
    rows = [("jpeg", jpeg, (500, 300)), ("jpeg", jpeg[:24], None), ("jpeg", b"\xff\xd8\xff\xe0\0\x01" + b"\0" * 20, None), ("webp", riff + b"VP8X" + b"\0" * 8 + b"\xff\x01\0\x2b\x01\0", (512, 300)), ("webp", riff + b"VP8 " + b"\0" * 10 + b"\x40\x41\xf0\x80", (320, 240)),
            ("webp", riff + b"VP8L" + b"\0" * 4 + b"\x2f" + (99 | 49 << 14).to_bytes(4, "little"), (100, 50)), ("bmp", b"BM" + b"\0" * 16 + (7).to_bytes(4, "little") + (-9).to_bytes(4, "little", signed=True), (7, 9)), ("gif", b"GIF89a\x05\0\x06\0", (5, 6)), ("png", b"\x89PNG", None), ("text", b"x", None)]
    df = spark.createDataFrame([(k, c) for k, c, _ in rows], "kind string, c binary")
    assert [None if r.d is None else tuple(r.d) for r in df.select(X.dimensions("c", F.col("kind")).alias("d")).collect()] == [w for *_, w in rows]


def test_facts_report_and_health(spark):
    rows = [("a.jpg", b"\xff\xd8\xff\xd9", True, True, False, False, False), ("b.mp4", b"\0\0\0\x18ftypisom", False, False, True, True, False), ("c.mkv", b"\x1aE\xdf\xa3..", False, False, False, False, True), ("d.mkv", b"\x1aE\xdf\xa3..", False, False, False, False, False), ("e.txt", b"hi", False, False, False, False, False), ("f.mp4", b"\0\0\0\x18ftypisom", False, False, False, False, False)]
    f = C.described(spark.createDataFrame(rows, "path string, content binary, executable_bit boolean, quarantined boolean, decode_failed boolean, media_blocked boolean, broken_container boolean").withColumn("size", F.octet_length("content").cast("long")))
    done = X.assess(f).withColumn("status", F.when(F.col("path") == "f.mp4", "no-video"))
    assert {r.path: [x.code for x in r.findings] for r in done.collect()} == {"a.jpg": ["executable-bit", "quarantine"], "b.mp4": ["media-engine-failure", "decode-failed"], "c.mkv": ["broken-container"], "d.mkv": [], "e.txt": [], "f.mp4": []}
    assert {r.path: (r.category, r.reason) for r in X.health(done, "content", "status").collect()} == {"b.mp4": ("risk", "media-engine-failure"), "c.mkv": ("broken", "broken-container"), "d.mkv": ("unsupported", "mkv"), "f.mp4": ("broken", "no-video")}
    got = {r.path: r for r in X.report(f).collect()}
    assert (got["a.jpg"].summary, got["d.mkv"].summary, got["e.txt"].may_open, got["a.jpg"].sniffed, got["e.txt"].ext_matches) == ("anomalies", "match", True, "jpeg", True)


def test_findings(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (40_000).to_bytes(4, "big") + (10).to_bytes(4, "big") + b"IEND"
    rows = [("a.jpg", b"MZ\x90", None, None), ("b.png", png, None, None), ("l", b"", "../x", True), ("c.zip", b"PK\x03\x04" + b"\0" * 30, None, None)]
    f = C.described(spark.createDataFrame(rows, "path string, content binary, link string, link_outside boolean").withColumn("size", F.octet_length("content").cast("long")))
    got = {r.path: [x.code for x in r.findings] for r in X.assess(f).collect()}
    assert got == {"a.jpg": ["disguised-executable", "runs-code"], "b.png": ["extreme-dimensions"], "l": ["symlink-outside", "symlink"], "c.zip": ["archive"]}


def test_values(spark):
    order = ["a", "a0", "hermana_c.JPG", "IMG_2.png", "img_2a", "IMG_002b", "IMG_10.png", "Z1"]
    df = spark.createDataFrame([(n,) for n in reversed(order)], "name string")
    assert names(df.orderBy(values.natural_key("name")), "name") == order
    assert one(spark, values.iso6709(F.lit("+48.8577+002.295/"))).lat == 48.8577 and one(spark, values.iso6709(F.lit("+00+000/"))) is None
    assert one(spark, values.xmp_coordinate(F.lit("48,30.0S"))) == -48.5
    assert one(spark, values.exif_millis(F.lit("1970:01:02 00:00:01"))) == 86_401_000 and one(spark, values.exif_millis(F.lit("1970:13:02 00:00:01"))) is None
    assert one(spark, values.human_size(F.lit(1536))) == "1.5 KB" and one(spark, values.human_size(F.lit(20 << 20))) == "20 MB" and one(spark, values.human_size(F.lit(5))) == "5 B"
    assert one(spark, values.similarity(F.lit(0.0))) == 99 and one(spark, values.sample_times(F.lit(12.0), 3)) == [2.0, 6.0, 10.0]
    assert one(spark, values.fnv1a(F.lit("a"))) == "af63dc4c8601ec8c"
    assert one(spark, values.clean_tag(F.lit(" a‮\t "))) == "a" and one(spark, values.clean_tag(F.lit("x" * 61))) is None
    assert one(spark, values.format_unix(F.lit(0))) == "1970-01-01 00:00:00 UTC"


def test_planes(spark):
    r = np.random.default_rng(1)
    a = np.kron(r.integers(0, 200, (16, 16)), np.ones((4, 4)))
    b = np.kron(r.integers(0, 200, (16, 16)), np.ones((4, 4)))
    local = a.copy()
    local[:8, :8] += 50
    df = spark.createDataFrame([(x.ravel().tolist(),) for x in (a, a + 20, b, local, np.full((64, 64), 9.0))], "p array<double>")
    h = [np.uint64(x.h & (2**64 - 1)) for x in df.select(values.phash("p").alias("h")).collect()]
    assert np.bitwise_count(h[0] ^ h[1]) <= 4 and np.bitwise_count(h[0] ^ h[2]) > 16
    z = [x.n for x in df.select(values.normalized("p").alias("n")).collect()]
    assert z[4] is None and abs(np.mean(z[0])) < 1e-9
    d = spark.createDataFrame([(a.ravel().tolist(), local.ravel().tolist())], "a array<double>, b array<double>").select(values.plane_difference("a", "b").alias("d")).first().d
    assert d.block > 3 * d.mad > 0
    assert len(df.select(values.blurred("p").alias("b")).first().b) == 4096


def test_hamming_pairs_are_all_found(spark):
    r = np.random.default_rng(7)
    h = r.integers(-(2**63), 2**63, 300)
    for k in range(60):
        bits = r.choice(64, k % 14, replace=False)
        h = np.append(h, h[k] ^ np.int64(np.uint64(sum(1 << int(b) for b in bits)).view(np.int64)))
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(h)], "id long, h long")
    d = np.bitwise_count(h.view(np.uint64)[:, None] ^ h.view(np.uint64)[None])
    want = {(i, j, int(d[i, j])) for i in range(len(h)) for j in range(i + 1, len(h)) if 0 < d[i, j] <= 13}
    got = {tuple(x) for x in S.candidates(df, 13).collect()}
    first = {int(v): i for i, v in reversed(list(enumerate(h)))}
    assert got == {(min(first[int(h[i])], first[int(h[j])]), max(first[int(h[i])], first[int(h[j])]), k) for i, j, k in want}


def test_equal_hashes_count_as_members(spark, tmp_path):
    import duckdb

    from cairn.plans.queries import QUERIES, SQL

    from .conftest import same

    r = np.random.default_rng(3)
    v = [r.normal(size=64).round(3) for _ in range(12)]
    v += [v[0], v[0], v[1], v[11], v[11], v[11]]  # copies of a hash that has near ones, and of one that has none
    for k in (0, 0, 1, 2):  # near ones: one element moves over the median
        x, order = v[k].copy(), np.argsort(v[k])
        x[order[3 + len(v) % 5]], x[order[50]] = x[order[50]], x[order[3 + len(v) % 5]]
        v += [x, x] if k == 1 else [x]
    rows = [(i, [float(y) for y in x], i % 4) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("hash_candidates", "similar_components", "dismissed_anti"):
        same(QUERIES[name](spark, str(tmp_path)), duck.sql(SQL[name]))
    # All pairs, equal hashes included, given to the plain grouping.
    prints = spark.read.parquet(str(tmp_path / "embeddings.parquet")).select(F.col("vec_id").alias("id"), S.fingerprint("embedding").alias("h"))
    h = {x.id: x.h & (2**64 - 1) for x in prints.collect()}
    near = [(a, b, 100 - (h[a] ^ h[b]).bit_count()) for a in h for b in h if a < b and (h[a] ^ h[b]).bit_count() <= 18]
    quality = spark.createDataFrame([(i, float(i % 4), i, str(i)) for i in h], "id long, q double, modified_ms long, path string")
    want = S.keeper_groups(spark.createDataFrame(near, "a long, b long, similarity int"), quality)
    got = sorted(map(tuple, QUERIES["similar_groups"](spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, want.collect())) and {x[2] for x in got} > {100} and len({n[:2] for n in near if n[2] == 100}) >= 8


def test_bursts_and_groups(spark):
    shots = spark.createDataFrame([("c", i, t) for i, t in enumerate([0, 400, 900, 5000, 6500, 8001])], "camera string, id long, time_ms long")
    assert [(b.frames, b.span_ms) for b in S.bursts(shots, ["camera"]).collect()] == [(3, 900)]
    e = spark.createDataFrame([(1, 2, 90), (2, 3, 80), (3, 4, 95)], "a long, b long, similarity int")
    q = spark.createDataFrame([(i, float(i == 2), 0, str(i)) for i in range(1, 5)], "id long, q double, modified_ms long, path string")
    assert sorted(map(tuple, S.keeper_groups(e, q).collect())) == [(2, 1, 90), (2, 3, 80)]
    assert S.longest_chain([(0, 5), (1, 1), (2, 2), (3, 3), (3, 9)]) == 3
    f = spark.createDataFrame([([1, 2, 3], [1, 2, 3], 0)], "a array<long>, b array<long>, m int")
    assert f.select(S.matching_frames("a", "b", "m")).first()[0] == 3


def test_keepers_on_random_graphs(spark):
    """The same as taking items one by one, best first."""
    import random

    r = random.Random(4)
    for n, m in ((1, 0), (12, 14), (60, 90), (40, 39)):
        pairs = {(i, i + 1) for i in range(n - 1)} if m == 39 else {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}  # 39: one long chain
        q = {i: (float(r.randint(0, 3)) if m != 39 else float(-i), r.randint(0, 2), str(i)) for i in range(n)}
        near = {i: {a + b - i for a, b in pairs if i in (a, b)} for i in range(n)}
        left, want = set(range(n)), set()
        for i in sorted(range(n), key=lambda i: (-q[i][0], q[i][1], q[i][2], i)):
            if i in left and (got := near[i] & left):
                want |= {(i, x, min(i, x) + max(i, x)) for x in got}
                left -= got | {i}
        e = spark.createDataFrame([(a, b, a + b) for a, b in pairs], "a long, b long, similarity int")
        got = S.keeper_groups(e, spark.createDataFrame([(i, *x) for i, x in q.items()], "id long, q double, modified_ms long, path string"))
        assert {tuple(x) for x in got.collect()} == want


def test_components_of_a_long_chain(spark):
    e = spark.range(150).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(500, 501)], "a long, b long"))
    assert {(x.id, x.root) for x in S.components(e).collect()} == {(i, 0) for i in range(151)} | {(500, 500), (501, 500)}


def test_free_names_beyond_any_number(spark):
    taken = [("a.jpg",), ("b",), ("b 2",), ("b 4",), ("c 2.txt",), ("d.tar.gz",), ("d.tar 02.gz",)] + [(f"a {i}.jpg",) for i in range(2, 12_002)]
    wanted = [(1, "a.jpg"), (2, "a 5.jpg"), (3, "b"), (4, "c.txt"), (5, "c 2.txt"), (6, "d.tar.gz"), (7, "new"), (8, "a.png")]
    got = P.free_names(spark.createDataFrame(wanted, "id long, name string"), spark.createDataFrame(taken, "name string"))
    assert {r.id: r.name for r in got.collect()} == {1: "a 12002.jpg", 2: "a 12002.jpg", 3: "b 3", 4: "c.txt", 5: "c 3.txt", 6: "d.tar 2.gz", 7: "new", 8: "a.png"}


def test_numbered_by_ranges(spark):
    from cairn.session import numbered

    df = spark.range(1000, numPartitions=7).selectExpr("id", "id * 7919 % 1000 AS k")
    got = numbered(df, [F.col("k").desc()])
    assert {(r.k, r["rank"]) for r in got.collect()} == {(k, 1000 - k) for k in range(1000)} and numbered(df.limit(0), [F.col("k")]).count() == 0


def test_quality_prefers_originals(spark):
    rows = [("a.jpg", 4000, 3000, 10**6, True), ("a copy.jpg", 4000, 3000, 10**6, True), ("a.jpg", 400, 300, 10**6, True)]
    df = C.described(spark.createDataFrame(rows, "path string, w int, h int, size long, exif boolean").withColumn("duration_ms", F.lit(None).cast("long")))
    q = [r.q for r in df.select(S.quality().alias("q")).collect()]
    assert q[0] > q[1] > q[2]


def test_metadata(spark):
    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + b"\0\0\0\0"

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"Author\0Ann") + chunk(b"tEXt", b"Software\0x\x01y")
    df = spark.createDataFrame([("a", png), ("b", b"junk"), ("c", png[:25])], "path string, content binary")
    got = {r.path: (r.categories, [f.value for f in r.fields]) for r in M.sensitive(M.extract(df)).collect()}
    assert got == {"a": (["person", "software"], ["Ann", "x y"])}
    fields = spark.createDataFrame([([("DateTimeOriginal", "2020:01:01 00:00:00"), ("SubSecTimeOriginal", "5"), ("Make", "A"), ("Model", "B")],)], "f array<struct<name: string, value: string>>")
    c = fields.select(M.capture("f").alias("c")).first().c
    assert (c.time_ms, c.camera) == (1_577_836_800_500, "A B")


def test_organising(spark):
    f = files(spark, ["a/x", "a/y", "b"])
    t = O.with_tags(f, spark.createDataFrame([("a/x", 2), ("a/x", 1), ("a/x", 1)], "path string, tag int"))
    assert {r.path: r.tags for r in t.collect()} == {"a/x": [1, 2], "a/y": [], "b": []}
    tags = spark.createDataFrame([(1, "One"), (2, "Two")], "id int, name string")
    assert names(O.rename_tag(tags, 2, "ONE"), "name") == ["One", "Two"] and names(O.rename_tag(tags, 2, "Three"), "name") == ["One", "Three"]
    assert names(O.follow_rename(f, "a", "c/d")) == ["c/d/x", "c/d/y", "b"] and names(O.remove(f, "a")) == ["b"]
    r = O.refusal(f, spark.createDataFrame([("a",)], "folder string"))
    assert {x.path: x.refusal for x in r.collect()} == {"a/x": "protected", "a/y": "protected", "b": None}
    assert names(O.hide_below(f, "a")) == ["b"] and names(O.hide_below(f, "a", "a/x")) == ["a/x", "a/y", "b"]
    cap = files(spark, ["Screenshot 1.png", "n.png"])
    fixed = O.with_capture(cap, spark.createDataFrame([("n.png", 1)], "path string, capture int"), spark.createDataFrame([("Screenshot 1.png",)], "path string"))
    assert {x.path: x.capture for x in fixed.collect()} == {"Screenshot 1.png": 0, "n.png": 1}


def test_transfer(spark):
    b = spark.createDataFrame([(1, "a.txt"), (2, "Á.txt"), (3, "b.txt")], "seq long, name string")
    got = {r.seq: r.conflict for r in P.transfer(b, spark.createDataFrame([("B.txt",)], "name string")).collect()}
    assert got == {1: None, 2: "batch", 3: "exists"}


def test_reducer_stream(spark, tmp_path):
    rows = [(1, 1, "keep"), (1, 2, "mark"), (1, 3, "undo"), (2, 1, "mark"), (2, 2, "undo")]
    df = spark.createDataFrame(rows, "item long, seq long, decision string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = J.collected(J.reduced(J.source(spark, df, str(tmp_path / "in"))), "update")
    assert {(r.item, r.decision, r.moves) for r in got.collect()} == {(1, "keep", 1), (2, None, 0)}


def test_photos_are_verified(spark):
    """Against the same rules in plain numpy, over all pairs."""
    r = np.random.default_rng(5)
    base = [np.kron(r.integers(0, 200, (16, 16)), np.ones((4, 4))) for _ in range(4)]
    pics = [*base, base[0] + 10, base[0] + r.normal(0, 3, (64, 64)), np.clip(base[1] * 1.1, 0, 255), np.full((64, 64), 9.0), base[2].copy()]
    local = base[3].copy()
    local[:24, :24] += 120
    pics.append(local)
    rows = [(i, 400 if i != 6 else 900, 300, [p.ravel().tolist(), p[3:61, 3:61].repeat(2, 0)[:64].repeat(2, 1)[:, :64].ravel().tolist()]) for i, p in enumerate(pics)]
    df = spark.createDataFrame(rows, "id long, w int, h int, planes array<array<double>>")
    whole, middle = (values.phash(F.get("planes", F.lit(i))) for i in (0, 1))
    flat = F.array_max(F.get("planes", F.lit(0))) == F.array_min(F.get("planes", F.lit(0)))
    photos = df.withColumn("hashes", F.array(F.when(~flat, whole), F.when(~flat, middle)))
    h = {x.id: x.hashes for x in photos.collect()}

    def prepared(p):
        p = np.asarray(p).reshape(64, 64)
        if p.std() < 6:
            return None
        z = (p - p.mean()) / p.std()
        return np.array([[z[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].mean() for j in range(64)] for i in range(64)])

    for level, (most, mad, block) in S.LEVELS.items():
        want = set()
        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                four = sorted(((h[i][a] ^ h[j][b]) & (2**64 - 1)).bit_count() * 100 + a * 10 + b for a in (0, 1) for b in (0, 1) if h[i][a] is not None and h[j][b] is not None)
                if not four or four[0] // 100 > most or abs(np.log(rows[i][1] / 300) - np.log(rows[j][1] / 300)) > 0.12:
                    continue
                x, y = prepared(rows[i][3][four[0] // 10 % 10]), prepared(rows[j][3][four[0] % 10])
                d = np.abs(x - y)
                if d.mean() <= mad and max(d[a : a + 8, b : b + 8].mean() for a in range(0, 64, 8) for b in range(0, 64, 8)) <= block:
                    want.add((i, j, min(99, round(100 * max(0, 1 - d.mean() / 1.13)))))
        got = {tuple(x) for x in S.verified_photos(S.photo_pairs(photos, most), photos, level).collect()}
        assert got == want and len(want) >= 3, level


def test_videos_match_in_order(spark):
    r = np.random.default_rng(6)
    frames = [np.kron(r.integers(0, 200, (16, 16)), np.ones((4, 4))) for _ in range(24)]

    def video(i, which):
        which = list(which)
        return i, [None if k is None else int(r.integers(0, 2**63)) if k < 0 else hashes[k] for k in which], [None if k is None else frames[abs(k)].ravel().tolist() for k in which]

    hashes = [x.h for x in spark.createDataFrame([(k, f.ravel().tolist()) for k, f in enumerate(frames)], "k int, p array<double>").orderBy("k").select(values.phash("p").alias("h")).collect()]
    rows = [video(0, range(12)), video(1, range(12)), video(2, [0, 1, 2, 3, *range(12, 20)]), video(3, reversed(range(12))), video(4, [0, 1, 2, None, None, None, None, None, None, None, None, None]), video(5, [12, *range(11)])]
    v = spark.createDataFrame(rows, "id long, hashes array<long>, planes array<array<double>>")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 6)], "a long, b long")
    assert {(x.b, x.similarity) for x in S.verified_videos(pairs, v).collect()} == {(1, 99), (5, 99)}


def test_archives_broken_nested_and_hostile(spark):
    import gzip
    import io
    import tarfile
    import zipfile

    from cairn.sources import archives as A

    def zipped(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, v in files.items():
                z.writestr(k, v)
        return out.getvalue()

    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc"
        t.addfile(link)
        one = tarfile.TarInfo("C:/x")
        one.size = 3
        t.addfile(one, io.BytesIO(b"abc"))
    deep = zipped(**{"1.zip": zipped(**{"2.zip": zipped(**{"3.zip": zipped(**{"4.zip": zipped(x="y")})})})})
    zeros = zipped(big=b"\0" * (150 << 20))
    rows = [("deep.zip", deep), ("t.tar", tar.getvalue()), ("t.tgz", gzip.compress(tar.getvalue())), ("cut.zip", deep[:-30]), ("cut.gz", gzip.compress(b"x" * 1000)[:-12]), ("zeros.zip", zeros), ("none.txt", b"hello"), ("null", None)]
    entries = A.entries(spark.createDataFrame(rows, "path string, content binary")).persist()
    got = {r.archive: r for r in X.archive_report(entries).collect()}
    assert {k: r.codes for k, r in got.items()} == {
        "deep.zip": ["archive-nesting"], "t.tar": ["archive-absolute", "archive-symlinks"], "t.tgz": ["archive-absolute", "archive-symlinks"], "cut.zip": ["archive-partial"], "cut.gz": ["archive-partial"], "zeros.zip": ["archive-ratio"],
    }
    assert max(r.depth for r in entries.collect()) == A.MAX_DEPTH and got["t.tgz"].entries == 2 and got["zeros.zip"].bytes == 150 << 20
    entries.unpersist()


def test_webm_probe(spark):
    from cairn.operators import media as V

    el = lambda key, body: bytes.fromhex(key) + bytes([0x40 | len(body) >> 8, len(body) & 255]) + body
    track = el("AE", el("83", b"\1") + el("86", b"V_VP9") + el("E0", el("B0", b"\2\x80") + el("BA", b"\1\x68")))
    segment = el("1549A966", el("2AD7B1", b"\x0f\x42\x40") + el("4489", __import__("struct").pack(">d", 1500.0))) + el("1654AE6B", track)
    raw = el("1A45DFA3", el("4282", b"webm")) + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + segment
    rows = [("a.webm", raw), ("b.webm", raw[:30]), ("c.txt", b"x"), ("d.mp4", b"\0\0\0\x18ftypisom")]
    df = C.described(spark.createDataFrame(rows, "path string, content binary"))
    got = {r.path: (r.container, r.video_status, r.video, r.w, r.h, r.duration_ms) for r in V.probe(df).collect()}
    assert got["a.webm"] == ("WebM", "playable", "V_VP9", 640, 360, 1500) and got["b.webm"][1] == got["c.txt"][1] == got["d.mp4"][1] == "damaged" and got["c.txt"][0] is None


def test_saved_catalogs_and_snapshots(spark, tmp_path):
    f = files(spark, ["a/x", "b"])
    C.save(f, str(tmp_path / "c"), "/root1")
    assert names(C.load(spark, str(tmp_path / "c"), "/root1").orderBy("path")) == ["a/x", "b"] and C.load(spark, str(tmp_path / "c"), "/other").count() == 0
    s = I.Snapshots(spark, str(tmp_path / "s"))
    items = spark.createDataFrame([("a", 1, "x")], "rel string, size long, sha256 string")
    s.save("zz", items)
    s.save("aa", items)
    assert [r.snapshot_id for r in s.all().collect()] == ["aa", "zz"] and s.delete("zz") and not s.delete("zz") and [r.snapshot_id for r in s.all().collect()] == ["aa"]


def test_drags_and_orders(spark):
    from cairn.operators import selection as L

    some = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {tuple(r) for r in L.dragged(some, "b").collect()} == {("a", False), ("b", False)} and [tuple(r) for r in L.dragged(some, "c").collect()] == [("c", True)]
    assert L.sort_of("largest", ("name", False)) == ("size", True) and L.sort_of("name", ("type", True)) == ("type", True)
    listing = spark.createDataFrame([(i, c) for i, c in enumerate("abcde")], "pos long, id string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(L.span(listing, "d", "b")) == ["b", "c", "d"] and ids(L.span(listing, "gone", "b")) == ["b"] and ids(L.span(listing, "a", "gone")) == []
    assert ids(L.click(some, listing, "e")) == ["e"] and ids(L.click(some, listing, "b", toggled=True)) == ["a"] and ids(L.in_order(some, listing)) == ["a", "b"]
    fav = O.set_favorite(O.set_favorite(spark.createDataFrame([("p",)], "path string"), "q", True), "p", False)
    assert names(fav) == ["q"]


def test_grey_planes_of_a_decoded_image(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = 100, 160
    pixels = np.zeros((h, w, 3), np.uint8)
    pixels[:, : w // 2] = (255, 0, 0)
    pixels[:, w // 2 :] = (0, 0, 255)
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    image = spark.read.format("image").load(str(tmp_path)).select("image.*")
    whole, middle = (np.array(p).reshape(64, 64) for p in image.select(values.grey_planes("width", "height", "nChannels", "data").alias("p")).first().p)
    assert abs(whole[:, :31].mean() - 255 * 0.299) < 1 and abs(whole[:, 33:].mean() - 255 * 0.114) < 1 and middle.shape == (64, 64)
    clear = spark.createDataFrame([(2, 1, 4, bytes([0, 0, 0, 0, 0, 0, 0, 255])), (0, 0, 0, None)], "w int, h int, n int, d binary")
    got = clear.select(values.grey_planes("w", "h", "n", "d").alias("p")).collect()
    assert got[0].p[0][0] > 200 and got[0].p[0][63] < 50 and got[1].p is None
    d = spark.createDataFrame([([0, 0, 0, 10, 10, 10], [0, 0, 0, 40, 40, 40])], "a array<int>, b array<int>").select(values.pixel_difference("a", "b").alias("d")).first().d
    assert (d["mean"], d.changed) == (15.0, 0.5)


def test_progress_and_generations(spark, tmp_path):
    import time

    df = spark.range(50).selectExpr("id", "id % 3 AS k")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = J.Progress()
    spark.streams.addListener(seen)
    assert J.collected(J.totals(J.source(spark, df, str(tmp_path / "in")), "k"), "complete").count() == 3
    for _ in range(50):
        if seen.ended and sum(seen.rows.values()) == 50:
            break
        time.sleep(0.1)
    spark.streams.removeListener(seen)
    assert sum(seen.rows.values()) == 50 and len(seen.ended) == 1
    assert J.publish(df, str(tmp_path / "out"), 2) and not J.publish(df, str(tmp_path / "out"), 1) and J.publish(df.limit(7), str(tmp_path / "out"), 3)
    assert J.published(spark, str(tmp_path / "out")).count() == 7
