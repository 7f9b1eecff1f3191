"""Registered queries of organising, planning, grouping and container operators, each with SQL written independently of it."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import values
from ..operators import browse as B, duplicates as D, findings as X, integrity as I, media as V, metadata as M, organize as O, plan as P, selection as L, similar as S, storage as T
from ..session import cut, numbered, spread_join
from ..sources import archives as A, catalog as C
from ..sources.catalog import CATALOG_SQL as CAT, of_documents, table
from ..streaming import jobs as J
from .queries import NATURAL, query


def _paths(spark, names, column="path"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


@query(f"WITH {CAT} SELECT doc_id, CASE WHEN doc_id % 10 IN (1, 2) THEN 0 WHEN doc_id % 10 = 3 THEN 2 WHEN kind = 'photo' AND name LIKE 'Screenshot%' THEN 1 WHEN kind = 'video' AND name LIKE 'Screenshot%' THEN 2 ELSE 0 END AS capture FROM catalog")
def capture_corrections(spark, d):
    c = of_documents(spark, d)
    return O.with_capture(c, c.where("doc_id % 10 IN (1, 3)").select("path", F.lit(2).alias("capture")), c.where("doc_id % 10 IN (1, 2)")).select("doc_id", "capture")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")
def unread_items(spark, d):
    c = of_documents(spark, d)
    return I.unread(c, c.where("doc_id % 3 > 0").withColumn("modified_ms", F.col("modified_ms") + (F.col("doc_id") % 7 == 0).cast("long"))).select("doc_id")


@query(f"""WITH {CAT}, f AS (SELECT '/a/' || path AS path, doc_id, CASE WHEN doc_id % 4 < 2 THEN 2 ELSE 1 END AS links, doc_id // 2 * 2 AS ino FROM catalog WHERE NOT starts_with(path, 'src1/en/') AND NOT starts_with(path, 'src7/de/2023/') AND (starts_with(path, 'src1/') OR starts_with(path, 'src2/') OR starts_with(path, 'src7/')))
SELECT path FROM f WHERE links = 1 UNION SELECT min(path) FROM f WHERE links = 2 GROUP BY ino""")
def overlapping_roots(spark, d):
    c = of_documents(spark, d).select(F.concat(F.lit("/a/"), "path").alias("path"), F.lit(1).alias("dev"), (F.floor(F.col("doc_id") / 2) * 2).alias("ino"), F.when(F.col("doc_id") % 4 < 2, 2).otherwise(1).alias("links"))
    root = lambda *r: c.where(" OR ".join(f"startswith(path, '/a/{x}/')" for x in r))
    return C.collected([root("src1", "src2"), root("src2"), root("src2", "src7")], _paths(spark, ["/a/src1/en", "/a/src7/de/2023"])).select("path")


@query(f"""WITH {CAT}, f AS (SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'x' END AS link, doc_id % 5 > 0 AS readable, size, starts_with(path, 'src2/') AS hidden FROM catalog) SELECT count(*) FILTER (link IS NOT NULL) AS links, count(*) FILTER (link IS NULL AND hidden) AS private, count(*) FILTER (link IS NULL AND NOT hidden AND NOT readable) AS unreadable FROM f""")
def snapshot_skipped(spark, d):
    files = of_documents(spark, d).withColumns({"link": F.when(F.col("doc_id") % 9 == 0, "x"), "readable": F.col("doc_id") % 5 > 0})
    return C.snapshot_items(files, _paths(spark, ["src2"]))[1]


@query(f"""WITH {CAT}, p AS (SELECT parent || '/' || (doc_id // 4) AS stem, doc_id, doc_id % 4 AS r, 'h' || (doc_id // 4 % 7) || (doc_id % 4 // 2) AS hash FROM catalog WHERE doc_id % 4 < 3), s AS (SELECT DISTINCT doc_id // 4 AS g, 'h' || (doc_id // 4 % 7) AS u FROM catalog WHERE doc_id % 4 = 3),
files AS (SELECT doc_id, doc_id // 4 AS g, doc_id % 4 AS r, doc_id // 4 % 7 AS c FROM catalog WHERE doc_id % 4 < 3), pairs AS (SELECT g, any_value(c) AS c FROM files WHERE r < 2 GROUP BY g HAVING count(*) = 2), units AS (SELECT c FROM pairs GROUP BY c HAVING count(*) > 1),
inu AS (SELECT doc_id, 'p' || f.c AS unit, false AS locked FROM files f JOIN pairs USING (g) JOIN units u ON u.c = f.c WHERE r < 2), rest AS (SELECT f.doc_id, CASE WHEN r = 1 THEN 'm' ELSE 's' END || f.c AS hash, r < 2 AND f.g IN (SELECT g FROM pairs) AS half FROM files f WHERE doc_id NOT IN (SELECT doc_id FROM inu)), many AS (SELECT hash FROM rest GROUP BY hash HAVING count(*) > 1)
SELECT doc_id, hash AS unit, half AS locked FROM rest JOIN many USING (hash) UNION ALL SELECT doc_id, unit, locked FROM inu""")
def live_units(spark, d):
    """Of each four documents two are a still and its motion, one is a copy of the still; contents repeat every 28."""
    k = F.col("doc_id")
    kind = F.when(k % 4 == 1, "m").otherwise("s")
    rows = of_documents(spark, d).where("doc_id % 4 < 3").withColumn("c", F.floor(k / 4) % 7)
    name = F.concat(F.when(k % 4 == 2, "copy").otherwise("x"), F.floor(k / 4).cast("string"), F.when(k % 4 == 1, ".mov").otherwise(".jpg"))
    files = C.described(rows.select("doc_id", "c", F.concat(F.lit("all/"), name).alias("path"), F.lit(1).cast("long").alias("size"), F.concat(kind, F.col("c").cast("string")).alias("hash")))
    got = D.live_groups(files, D.live_pairs(files, ["jpg"], ["mov"])).join(files.select("path", "doc_id", "c", "hash"), "path")
    return got.select("doc_id", F.when(F.col("unit") == F.col("hash"), F.col("hash")).otherwise(F.concat(F.lit("p"), F.col("c").cast("string"))).alias("unit"), "locked")


_W4 = """ln(greatest((doc_id % 90 + 10) * (doc_id % 70 + 10), 1)::DOUBLE) * 10 - (CASE WHEN contains(lower(name), 'copy') THEN 4.0 ELSE 0.0 END + CASE WHEN contains(lower(name), 'screenshot') THEN 4.0 ELSE 0.0 END) + CASE WHEN ext = 'mp4' THEN ln(greatest((doc_id % 50)::DOUBLE, 0.1)) * 8 + ln(greatest(size / greatest((doc_id % 50)::DOUBLE, 0.1), 1.0)) ELSE ln(greatest(size::DOUBLE / ((doc_id % 90 + 10) * (doc_id % 70 + 10)), 1e-6)) + CASE WHEN doc_id % 3 = 0 THEN 3.0 ELSE 0.0 END + CASE WHEN ext = 'jpg' THEN 1.0 ELSE 0.0 END END"""


@query(f"WITH {CAT} SELECT doc_id, round({_W4}, 6) AS q FROM catalog WHERE kind IN ('photo', 'video')")
def item_quality(spark, d):
    k = F.col("doc_id")
    rows = of_documents(spark, d).where("kind IN ('photo', 'video')").withColumns({"w": k % 90 + 10, "h": k % 70 + 10, "exif": k % 3 == 0, "duration_ms": F.when(F.col("kind") == "video", k % 50 * 1000)})
    return rows.select("doc_id", F.round(S.quality(), 6).alias("q"))


@query(f"WITH {CAT} SELECT 'out' AS from_root, count(*) FILTER (NOT starts_with(path, 'src3/en/')) AS n FROM catalog UNION ALL SELECT 'in', count(*) FROM catalog")
def hidden_results(spark, d):
    c = of_documents(spark, d)
    n = lambda root, name: O.hide_below(c, "src3/en", root).agg(F.count("*").alias("n")).select(F.lit(name).alias("from_root"), "n")
    return n("", "out").union(n("src3/en/2023", "in"))


@query(f"""WITH {CAT}, f AS (SELECT DISTINCT 'src3/' || split_part(path, '/', 2) AS path FROM catalog WHERE path LIKE 'src3/%'), a AS (SELECT path, split_part(path, '/', 2) AS name, true AS is_dir, NULL::BIGINT AS m FROM f UNION ALL SELECT path, name, false, modified_ms FROM catalog WHERE parent = 'src3')
SELECT path, is_dir, row_number() OVER (ORDER BY is_dir DESC, {NATURAL.format('name')} DESC, path DESC) AS rank FROM a""")
def listing_with_folders(spark, d):
    files = of_documents(spark, d).withColumn("is_dir", F.lit(False))
    folders = B.folders_of(files).withColumns({"is_dir": F.lit(True), "kind": F.lit("folder")})
    q = B.Query(folder="src3", desc=True)
    rows = B.browse(files.unionByName(folders, allowMissingColumns=True), q, limit=None).select("path", "name", "is_dir", "modified_ms", "created_ms", "size", "ext")
    return numbered(rows, [F.col("is_dir").desc(), *B.order_keys(q)]).select("path", "is_dir", "rank")


@query(f"""WITH {CAT}, f AS (SELECT DISTINCT parent AS path FROM catalog UNION SELECT DISTINCT split_part(parent, '/', 1) || '/' || split_part(parent, '/', 2) FROM catalog UNION SELECT DISTINCT split_part(parent, '/', 1) FROM catalog) SELECT path, true AS is_dir FROM f WHERE contains(path, 'src3') AND contains(path, 'en') UNION ALL SELECT path, false FROM catalog WHERE contains(strip_accents(lower(path)), 'src3') AND contains(strip_accents(lower(path)), 'en')""")
def search_with_folders(spark, d):
    files = of_documents(spark, d).withColumn("is_dir", F.lit(False))
    folders = B.folders_of(files).withColumns({"is_dir": F.lit(True), "kind": F.lit("folder")})
    return B.browse(files.unionByName(folders, allowMissingColumns=True), B.Query(search="EN src3", everywhere=True), limit=None).select("path", "is_dir")


@query("""WITH RECURSIVE m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type WHEN 'click' THEN 'keep' WHEN 'purchase' THEN 'mark' ELSE 'undo' END AS decision FROM events WHERE event_type IN ('click', 'purchase', 'error')),
r(user_id, n, done) AS (SELECT DISTINCT user_id, 0::BIGINT, []::VARCHAR[] FROM m UNION ALL SELECT m.user_id, m.n, CASE WHEN decision = 'undo' THEN done[:-2] ELSE list_append(done, decision) END FROM r JOIN m ON m.user_id = r.user_id AND m.n = r.n + 1)
SELECT user_id AS item, arg_max(done[-1], n) AS decision, arg_max(len(done), n) AS moves FROM (SELECT user_id, n, done, CASE WHEN len(done) > 0 THEN done[-1] ELSE NULL END AS top FROM r) GROUP BY user_id""".replace("arg_max(done[-1], n) AS decision", "nullif(arg_max(coalesce(top, ''), n), '') AS decision"))
def decision_stream(spark, d):
    e = J.source(spark, table(spark, d, "events"), f"{d}/event?.parquet").where("event_type IN ('click', 'purchase', 'error')")
    said = F.when(F.col("event_type") == "click", "keep").when(F.col("event_type") == "purchase", "mark").otherwise("undo")
    return J.collected(J.reduced(e.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), said.alias("decision"))), "update", ["item"])


# ---- selections and queues


@query(f"WITH {CAT}, l AS (SELECT path AS id, row_number() OVER (ORDER BY path) AS pos FROM catalog), r AS (SELECT id FROM l WHERE pos BETWEEN 11 AND 30 UNION SELECT id FROM l WHERE pos % 50 = 0 AND pos <= 150) SELECT id FROM r WHERE id NOT IN (SELECT id FROM l WHERE pos = 20)")
def selected_range(spark, d):
    listing = numbered(of_documents(spark, d).select(F.col("path").alias("id")), [F.col("id")], "pos")
    at = {r.pos: r.id for r in listing.where("pos IN (11, 20, 30)").collect()}  # three rows
    some = listing.where("pos % 50 = 0 AND pos <= 150").select("id").union(_paths(spark, ["gone"], "id"))
    made = L.click(some, listing, at[11], at[30], ranged=True, toggled=True)
    return L.reconciled(L.toggle(made, at[20]), listing)


@query("SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN 'keep' WHEN doc_id % 5 = 0 THEN 'keep' WHEN doc_id % 7 = 0 THEN 'mark' END AS decision FROM documents")
def queue_resumed(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"))
    k = F.col("id").cast("long")
    saved = items.union(spark.createDataFrame([(-1, "gone")], "pos long, id string")).select("id", F.when(F.col("pos") % 3 == 0, "keep").when(F.col("pos") % 35 == 0, "mark").when(F.col("pos") % 5 == 0, "mark").when(F.col("pos") % 7 == 0, "mark").alias("decision")).where("decision IS NOT NULL")
    return L.resumed(items, L.kept_instead(saved, items.where(k % 5 == 0))).select("pos", "decision")


@query("SELECT least(max(doc_id) + 1, 40, coalesce(min(doc_id) FILTER (doc_id % 25 = 24), max(doc_id) + 1)) AS cursor FROM documents")
def queue_cursor(spark, d):
    return L.first_open(table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 25 < 24, "keep").alias("decision")), 40)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'a')")
def command_search(spark, d):
    return L.commands(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("section"), F.col("p_type").alias("words")), " BRAND a ").select("p_partkey")


@query("""WITH s AS (SELECT user_id, count(*) AS sessions, count(*) FILTER (event_type = 'purchase') AS successes, max(event_id) FILTER (event_type = 'error') AS problem, max(event_id) FILTER (event_type = 'signup') AS asked, sum(event_id % 100000) AS used FROM events GROUP BY 1)
SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'rated' WHEN sessions < 2 THEN 'first-session' WHEN 700000 - problem * 60 < 600000 THEN 'recent-error' WHEN asked IS NOT NULL AND user_id % 2 = 0 THEN 'asked-recently' WHEN asked IS NOT NULL AND successes < 5 THEN 'few-tasks' WHEN asked IS NULL AND successes < 3 AND used < 600000 THEN 'little-use' END AS refusal FROM s""")
def review_gate(spark, d):
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("event_id")))
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("event_type") == "purchase").alias("successes"), at("error").alias("e"), at("signup").alias("a"), F.sum(F.col("event_id") % 100_000).alias("usage_ms"))
    asked = F.when(F.col("a").isNotNull(), F.when(F.col("user_id") % 2 == 0, F.lit(700_000)).otherwise(F.lit(-3_000_000_000)))
    return L.may_ask(s.select("user_id", F.when(F.col("user_id") % 7 == 0, "1.0").alias("rated_version"), "sessions", (F.col("e") * 60).alias("last_problem_at"), asked.alias("last_asked_at"), F.col("successes").alias("successes_since"), "successes", "usage_ms"), 700_000, "1.0").select("user_id", "refusal")


# ---- plans


@query("SELECT * FROM (VALUES ('nothing', 'nothing'), ('not-a-folder', 'not-a-folder'), ('read-only', 'read-only'), ('target-protected', 'target-protected'), ('itself', 'itself'), ('inside', 'inside'), ('item-protected', 'item-protected'), ('already-here', 'already-here'), ('fine', NULL)) v(wanted, refusal)")
def drop_checks(spark, d):
    c = of_documents(spark, d).where("parent = 'src3/en'").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), "path", F.lit("file").alias("kind"), F.lit(False).alias("guarded"))
    folder = spark.createDataFrame([(-1, "f", "src3", "folder", False)], c.schema)
    guarded = spark.createDataFrame([(-2, "g", "src9/x", "file", True)], c.schema)
    to = {"id": "t", "path": "src3/en/2023", "kind": "folder", "guarded": False}
    cases = {
        "nothing": (c.limit(0), to, True), "not-a-folder": (c, to | {"kind": "file"}, True), "read-only": (c, to | {"guarded": True}, True), "target-protected": (c, to | {"guarded": True}, False), "itself": (c.union(folder), to | {"id": "f"}, False),
        "inside": (c.union(folder), to, False), "item-protected": (c.union(guarded), to, False), "already-here": (c, to | {"path": "src3/en"}, False), "fine": (c, to, False),
    }
    rows = [P.drop_check(items, target, ro).select(F.lit(k).alias("wanted"), "refusal") for k, (items, target, ro) in cases.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@query(f"""WITH {CAT}, b AS (SELECT doc_id AS seq, path, name, parent, size FROM catalog WHERE starts_with(path, 'src4/') OR starts_with(path, 'src5/')), t AS (SELECT name, CASE WHEN doc_id % 3 = 0 THEN 'folder' WHEN doc_id % 3 = 1 THEN 'file' ELSE 'link' END AS kind FROM catalog WHERE starts_with(path, 'src5/') AND doc_id % 2 = 0),
k AS (SELECT b.*, t.kind AS there, CASE WHEN parent = 'src5/fr' THEN 'already-here' WHEN starts_with(path, 'src4/de/') OR starts_with(path, 'src5/en/2023/') THEN 'protected' END AS blocked FROM b LEFT JOIN t USING (name))
SELECT seq, size::BIGINT AS bytes, blocked, CASE WHEN blocked IS NULL THEN there END AS conflict, coalesce(blocked IS NULL AND there = 'file', false) AS replaceable, blocked IS NULL AND seq % 2 = 1 AS crosses FROM k""")
def transfer_dry_run(spark, d):
    c = of_documents(spark, d)
    batch = c.where("startswith(path, 'src4/') OR startswith(path, 'src5/')").select(F.col("doc_id").alias("seq"), "path", F.lit("file").alias("kind"), F.when(F.col("doc_id") % 2 == 0, "v1").otherwise("v2").alias("volume"))
    there = c.where("startswith(path, 'src5/') AND doc_id % 2 = 0").select("name", F.element_at(F.array(F.lit("folder"), F.lit("file"), F.lit("link")), (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"))
    plan = P.transfer_plan(batch, c, there, "src5/fr", "v1", _paths(spark, ["src4/de", "src5/en/2023"], "folder"), moving=True)
    return plan.select("seq", "bytes", "blocked", "conflict", "replaceable", "crosses")


@query("""WITH m AS (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE strlen(text) > 0), x AS (SELECT *, doc_id % 6 = 0 AS changed FROM m WHERE n > 1), b AS (SELECT text FROM x WHERE r = 1 AND changed)
SELECT doc_id, CASE WHEN text IN (SELECT text FROM b) THEN 'skipped' WHEN changed THEN 'changed' ELSE 'trash' END AS outcome FROM x WHERE r > 1""")
def cleanup_execution(spark, d):
    # Written once without texts: the plan, its members and what is there now are all made of it.
    m = cut(D.members(cut(D.hashed(of_documents(spark, d), "text").select("doc_id", "path", "size", "hash"))).withColumn("unit", F.col("hash")))
    first = m.groupBy("unit").agg(F.min("doc_id").alias("first"))
    plan = spread_join(m, first, ["unit"]).where("doc_id > first").select("unit", "path")
    now = m.where("doc_id % 12 > 0").select("path", "size", F.when(F.col("doc_id") % 6 == 0, "other").otherwise(F.col("hash")).alias("hash"))
    return P.executable(plan, m, now).join(m.select("path", "doc_id"), "path").select("doc_id", "outcome")


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'deleted' WHEN event_id % 7 = 0 THEN 'by-hand' END AS note, event_id % 3 > 0 AND event_id % 5 > 0 AND event_id % 7 > 0 AS undoable FROM events WHERE event_id % 11 > 0")
def undo_notes(spark, d):
    k = F.col("event_id")
    change = lambda kind, trashed: F.struct(F.lit(kind).alias("kind"), trashed.alias("trashed"))
    yes, no = F.lit("bin"), F.lit(None).cast("string")
    changes = F.when(k % 11 == 0, F.array().cast("array<struct<kind: string, trashed: string>>")).otherwise(F.array(change("renamed", no), F.when(k % 5 == 0, change("deleted", no)).when(k % 7 == 0, change("trashed", no)).otherwise(change("cross-moved", yes))))
    return O.history(table(spark, d, "events").select(k.alias("id"), F.col("ts").alias("at"), changes.alias("changes"), (k % 3 == 0).alias("undone"))).select("id", "note", "undoable")


_FS = "['apfs', 'ext4', 'nfs', 'zfs', 'ntfs', 'odd']"


@query(f"WITH v AS (SELECT c_custkey, {_FS}[(c_custkey % 6)::INT + 1] AS f, ['rotational', 'solid-state', 'x'][(c_custkey % 5 % 3)::INT + 1] AS m FROM customer) SELECT c_custkey, CASE WHEN f IN ('apfs', 'zfs') THEN 'copy-on-write' WHEN f = 'nfs' THEN 'network' WHEN f = 'odd' THEN 'unknown-system' WHEN m = 'solid-state' THEN 'solid-state' WHEN m = 'x' THEN 'unknown-medium' END AS refusal FROM v")
def overwrite_rules(spark, d):
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    k = F.col("c_custkey")
    v = table(spark, d, "customer").select("c_custkey", pick(["apfs", "ext4", "nfs", "zfs", "ntfs", "odd"], k % 6).alias("fs_type"), pick(["rotational", "solid-state", "x"], k % 5 % 3).alias("medium"))
    return v.select("c_custkey", O.overwrite_refusal().alias("refusal"))


@query("SELECT id, name FROM (VALUES (1, 'One'), (2, 'two'), (3, 'Neu')) v(id, name)")
def tags_ensured(spark, d):
    tags = spark.createDataFrame([(1, "One"), (2, "two")], "id int, name string")
    for name in ("ONE", " Neu ", "‮", "x" * 61, "neu"):
        tags = O.ensure_tag(tags, name)
    return tags


@query(f"WITH {CAT} SELECT path, 1 AS tag FROM catalog WHERE doc_id % 4 = 0 AND doc_id % 8 > 0 UNION SELECT path, 2 FROM catalog WHERE doc_id % 3 = 0")
def tags_assigned(spark, d):
    c = of_documents(spark, d)
    none = spark.createDataFrame([], "path string, tag int")
    both = O.assign_tag(O.assign_tag(none, c.where("doc_id % 4 = 0"), 1), c.where("doc_id % 3 = 0"), 2)
    return O.assign_tag(both, c.where("doc_id % 8 = 0"), 1, on=False)


@query(f"WITH {CAT} SELECT doc_id, 'vol/x/' || path AS there, CASE WHEN starts_with(path, 'src3/') THEN path[6:] END AS back FROM catalog")
def volume_paths(spark, d):
    return of_documents(spark, d).select("doc_id", O.to_volume("path", "vol/x").alias("there"), O.from_volume("path", "src3").alias("back"))


@query(f"WITH {CAT} SELECT doc_id, CASE WHEN path LIKE 'src3/%' THEN 'new.mp4' || path[5:] ELSE path END AS path, ext, kind FROM catalog WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, path || '.gif', 'gif', 'gif' FROM catalog WHERE doc_id % 10 = 1")
def catalog_updated(spark, d):
    c = of_documents(spark, d)
    more = C.described(c.where("doc_id % 10 = 1").withColumn("path", F.concat("path", F.lit(".gif"))))
    return O.added(O.renamed(c.where("doc_id % 2 = 0"), "src3", "new.mp4"), more).select("doc_id", "path", "ext", "kind")


# ---- groups and containers


@query("""WITH g AS (SELECT doc_id AS member, doc_id // 10 * 10 AS keeper FROM documents WHERE doc_id % 10 IN (1, 2, 3)), k AS (SELECT g.*, d.text = e.text AS exact, strlen(d.text) AS size FROM g JOIN documents d ON d.doc_id = member JOIN documents e ON e.doc_id = keeper)
SELECT keeper, keeper % 20 = 0 AS video, count(*) + 1 AS items, min(CASE WHEN exact THEN 100 ELSE 60 + member % 30 END)::INT AS similarity, sum(size)::BIGINT AS recoverable, row_number() OVER (ORDER BY keeper % 20 = 0, min(CASE WHEN exact THEN 100 ELSE 60 + member % 30 END) DESC, count(*), keeper) AS rank FROM k GROUP BY keeper""")
def group_overview(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size"), I.sha256("text").alias("hash"), (F.col("doc_id") % 20 == 0).alias("video"))
    made = docs.where("id % 10 IN (1, 2, 3)").select((F.floor(F.col("id") / 10) * 10).alias("keeper"), F.col("id").alias("member"), (60 + F.col("id") % 30).cast("int").alias("similarity"))
    return S.group_list(S.confirmed(made, docs), docs)


@F.pandas_udf(BinaryType())
def _packed(key: pd.Series, text: pd.Series) -> pd.Series:
    """Test archives: a zip with two entries and, for every third, one in it; for every fourth a gzip."""
    def one(k: int, t: str) -> bytes:
        if k % 4 == 3:
            return gzip.compress(t.encode())
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr("a.txt", t)
            z.writestr(("../" if k % 5 == 0 else "/" if k % 5 == 1 else "") + "b.txt", str(k))
            if k % 3 == 0:
                inner = io.BytesIO()
                with zipfile.ZipFile(inner, "w") as y:
                    y.writestr("deep.txt", "x" * (k % 100))
                z.writestr("in.zip", inner.getvalue())
        return out.getvalue()

    return pd.Series([one(k, t) for k, t in zip(key, text, strict=True)])


def _archives(spark, d):
    return table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".gz")).alias("path"), _packed("doc_id", F.coalesce("text", F.lit(""))).alias("content"))


@query("""WITH k AS (SELECT doc_id, strlen(text) AS n FROM documents) SELECT doc_id || '.gz' AS archive, doc_id::VARCHAR AS path, 0 AS depth, n AS size FROM k WHERE doc_id % 4 = 3 UNION ALL SELECT doc_id || '.gz', 'a.txt', 0, n FROM k WHERE doc_id % 4 < 3
UNION ALL SELECT doc_id || '.gz', CASE doc_id % 5 WHEN 0 THEN '../' WHEN 1 THEN '/' ELSE '' END || 'b.txt', 0, length(doc_id::VARCHAR) FROM k WHERE doc_id % 4 < 3 UNION ALL SELECT doc_id || '.gz', 'deep.txt', 1, doc_id % 100 FROM k WHERE doc_id % 4 < 3 AND doc_id % 3 = 0""")
def archive_entries(spark, d):
    return A.entries(_archives(spark, d)).where("NOT nested").select("archive", "path", "depth", "size")


@query("""SELECT doc_id || '.gz' AS archive, CASE WHEN doc_id % 4 = 3 THEN 1 WHEN doc_id % 3 = 0 THEN 4 ELSE 2 END::BIGINT AS entries, CASE WHEN doc_id % 4 < 3 AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS depth, CASE WHEN doc_id % 4 = 3 THEN '' ELSE concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'archive-traversal' WHEN doc_id % 5 = 1 THEN 'archive-absolute' END, CASE WHEN doc_id % 3 = 0 THEN 'archive-nested' END) END AS codes FROM documents""")
def archive_reports(spark, d):
    return X.archive_report(A.entries(_archives(spark, d))).select("archive", "entries", "depth", F.array_join("codes", ",").alias("codes"))


@F.pandas_udf(BinaryType())
def _filmed(key: pd.Series) -> pd.Series:
    """Test videos: an MP4 whose codec, size, length and damage follow the key."""
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body

    def one(k: int) -> bytes:
        entry = box(b"avc1" if k % 3 else b"hev1", bytes(24) + struct.pack(">HH", 0 if k % 11 == 0 else 640 + k % 100, 360) + bytes(50))
        stbl = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1) + entry))
        handler = b"soun" if k % 5 == 0 else b"vide"
        matrix = (0, 1 << 16, 0, -(1 << 16), 0, 0, 0, 0, 1 << 30) if k % 2 else (1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
        trak = box(b"trak", box(b"tkhd", bytes(40) + struct.pack(">9i", *matrix) + bytes(8)) + box(b"mdia", box(b"hdlr", bytes(8) + handler + bytes(12)) + box(b"minf", stbl)))
        raw = box(b"ftyp", b"isom\0\0\2\0") + box(b"moov", box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 500 + k) + bytes(80)) + trak)
        return raw[:-9] if k % 7 == 0 else raw

    return pd.Series([one(k) for k in key])


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'damaged' WHEN doc_id % 5 = 0 THEN 'no-video' WHEN doc_id % 3 = 0 THEN 'unsupported-codec' WHEN doc_id % 11 = 0 THEN 'damaged' ELSE 'playable' END AS video_status, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'hev1' ELSE 'avc1' END AS video,
CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 0 WHEN doc_id % 2 = 1 THEN 360 WHEN doc_id % 11 = 0 THEN 0 ELSE 640 + doc_id % 100 END::INT AS w, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 500 + doc_id END::BIGINT AS duration_ms FROM documents""")
def video_probes(spark, d):
    rows = table(spark, d, "documents").select("doc_id", _filmed("doc_id").alias("content"), F.lit("mp4").alias("ext"))
    return V.probe(rows).select("doc_id", "video_status", "video", "w", "duration_ms")




# ---- further options


@query(f"""WITH {CAT}, b AS (SELECT doc_id, encode('r' || doc_id % 3 || chr(0) || path) AS raw FROM catalog), l AS (SELECT doc_id, list_transform(range(0, octet_length(raw)), lambda i: ('0x' || substr(hex(raw), (2 * i + 1)::INT, 2))::HUGEINT) AS bytes FROM b)
SELECT doc_id, 'x' || lower(lpad(to_hex(list_reduce(bytes, lambda h, x: xor(h, x) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)::UBIGINT), 16, '0')) AS id FROM l""")
def scoped_ids(spark, d):
    return of_documents(spark, d).select("doc_id", values.scoped_id("x", F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")), "path").alias("id"))


@query(f"WITH {CAT} SELECT doc_id FROM catalog WHERE kind IN ('photo', 'gif', 'audio') OR (doc_id % 7 = 2 AND doc_id % 2 = 0)")
def analysed_kinds(spark, d):
    c = of_documents(spark, d)
    half = c.where("doc_id % 7 = 2 AND doc_id % 2 = 0").select("doc_id", F.col("path").alias("motion"))
    photos = c.where("kind = 'photo'").groupBy("kind").agg(F.min("path").alias("still")).select("still")
    return D.of_options(c, ["images", "audio"], half.join(F.broadcast(photos)).select("still", "motion")).select("doc_id")


@query("SELECT sha256(text) AS unit, count(*) AS members, strlen(text) * (count(*) - greatest(count(*) FILTER (doc_id % 3 = 0), 1)) AS recoverable FROM documents WHERE strlen(text) > 0 GROUP BY text HAVING count(*) > 1")
def locked_recoverable(spark, d):
    m = D.members(D.hashed(of_documents(spark, d), "text"))
    return D.recoverable(m.select(F.col("hash").alias("unit"), "size", (F.col("doc_id") % 3 == 0).alias("locked")))


@query(f"WITH {CAT}, f AS (SELECT path, doc_id, row_number() OVER (ORDER BY path) AS n FROM catalog WHERE doc_id % 2 = 0) SELECT path, doc_id FROM f WHERE n BETWEEN 21 AND 70 AND doc_id % 3 > 0")
def health_pages(spark, d):
    c = of_documents(spark, d)
    return X.health_page(c.where("doc_id % 2 = 0").select("path"), c.where("doc_id % 3 > 0").select("path", "doc_id"), 20, 50)


@query("WITH b AS (SELECT doc_id, doc_id::VARCHAR AS rel, doc_id % 10 AS r FROM documents), x AS (SELECT rel, CASE WHEN r = 3 THEN 'added' WHEN r = 4 THEN 'missing' WHEN r = 7 THEN 'unreadable' WHEN r = 5 THEN 'changed' ELSE 'unchanged' END AS status FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY rel) AS k FROM x) SELECT status, count(*) AS n, coalesce(string_agg(rel, ',' ORDER BY rel) FILTER (status <> 'unchanged' AND k <= 5), '') AS names FROM n GROUP BY status")
def verification_report(spark, d):
    from .queries import _snapshots

    return I.verification(I.diff(*_snapshots(spark, d)), 5).withColumn("names", F.array_join("names", ","))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name, row_number() OVER (ORDER BY lower(n_name)) AS rank FROM nation")
def tags_listed(spark, d):
    n = table(spark, d, "nation")
    return O.listed_tags(n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name")))


@query("SELECT 'e' || i AS path, CASE WHEN i % 3 = 1 THEN 0 ELSE 2 END AS nested FROM range(20) t(i) WHERE i % 3 < 2")
def empty_public_folders(spark, d):
    k = F.col("id")
    made = spark.range(20).select(k, F.explode(F.array(*[F.concat(F.lit("e"), k.cast("string"), F.lit(s)) for s in ("", "/a", "/a/b")])).alias("path"))
    private = made.where("(id % 3 = 1 AND path LIKE '%/a') OR (id % 3 = 2 AND path NOT LIKE '%/%')").select("path")
    return T.empty_folders(made.select("path"), of_documents(spark, d), private)


@query(f"""WITH {CAT}, x AS (SELECT path[6:] AS rel, size FROM catalog WHERE path LIKE 'src3/%') SELECT 'folder' AS kind, split_part(rel, '/', 1) AS name, sum(size)::BIGINT AS bytes, count(*) AS items FROM x WHERE NOT starts_with(rel, 'en/') GROUP BY 2 UNION ALL SELECT 'private', '', sum(size)::BIGINT, count(*) FROM x WHERE starts_with(rel, 'en/') HAVING count(*) > 0""")
def treemap_private(spark, d):
    return T.tiles(B.boundaries(of_documents(spark, d), _paths(spark, ["src3/en", "src4"], "folder")), "src3", 10)


@query("SELECT doc_id, doc_id % 3 = 0 OR doc_id % 5 = 0 AS exif, CASE WHEN doc_id % 2 = 0 THEN left(text, 262144) END AS preview FROM documents")
def content_previews(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(k % 2 == 0, "txt").otherwise("bin").alias("ext"))
    mark = F.when(k % 3 == 0, F.lit(b"Exif\0\0")).when(k % 5 == 0, F.lit(b"\xff\xd8\xff\xe1Exif")).when(k % 7 == 0, F.lit(b"Exif")).otherwise(F.lit(b""))
    rest = F.when(k % 3 == 0, F.lit(b"x")).when(k % 5 == 0, F.lit(b"x")).when(k % 7 == 0, F.lit(b"x")).otherwise(F.lit(b"plain"))
    found = X.preview(rows.withColumn("content", F.col("text").cast("binary")))
    return found.select("doc_id", values.has_exif(F.concat(mark, rest)).alias("exif"), "preview")


@query("""WITH k AS (SELECT doc_id, doc_id % 2 = 0 AS person, doc_id % 3 = 0 AS place, doc_id % 5 = 0 AS device, doc_id % 7 = 0 AS png FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN device THEN 'device' END, CASE WHEN place THEN 'location' END, CASE WHEN person THEN 'person' END, CASE WHEN png THEN 'software' END) AS categories,
(CASE WHEN person THEN 1 ELSE 0 END + CASE WHEN place THEN 2 ELSE 0 END + CASE WHEN device THEN 1 ELSE 0 END + CASE WHEN png THEN 1 ELSE 0 END)::INT AS fields, CASE WHEN place THEN round(doc_id % 80 + 0.5, 5)::DOUBLE END AS lat, CASE WHEN place THEN round(-(doc_id % 170 + 0.25), 5)::DOUBLE END AS lon FROM k WHERE person OR place OR device OR png""")
def sensitive_metadata(spark, d):
    k = F.col("doc_id")
    some = lambda n, text: F.when(k % n == 0, text).otherwise(F.lit(""))
    place = F.concat(F.format_string(' exif:GPSLatitude="%d,30.0N" exif:GPSLongitude="%d,15,0W"', k % 80, k % 170))
    packet = F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="r"><rdf:Description xmlns:dc="d"'), some(3, place), some(5, F.lit(' tiff:Model="M1"')), F.lit(">"), some(2, F.lit("<dc:creator><rdf:Seq><rdf:li>Ann</rdf:li></rdf:Seq></dc:creator>")), F.lit("<dc:other> </dc:other></rdf:Description></rdf:RDF></x:xmpmeta>"))
    png = F.when(k % 7 == 0, F.unhex(F.lit("89504E470D0A1A0A0000000A74455874" + b"Software\0x".hex() + "00000000"))).otherwise(F.lit(b"\xff\xfe"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(png, packet.cast("binary"), F.lit(b"\xff\0tail")).alias("content"))
    found = M.sensitive(M.extract(rows)).withColumn("at", M.position("fields"))
    return found.select("doc_id", F.array_join("categories", ",").alias("categories"), F.size("fields").alias("fields"), F.round("at.lat", 5).alias("lat"), F.round("at.lon", 5).alias("lon"))
