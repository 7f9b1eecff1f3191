"""The registered queries of the catalog operators, each with SQL written independently of it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import kinds, paths, values
from ..operators import browse as B, duplicates as D, findings as X, integrity as I, metadata as M, organize as O, plan as P, similar as S, storage as T
from ..session import cut, numbered, small
from ..sources.catalog import CATALOG_SQL as CAT, of_documents, of_pages, table
from ..streaming import jobs as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PRIVATE = ["src1/en", "src2", "src2/fr/2023", "src7/de/2023"]
PROTECTED = ["src3", "src4/de", "src5/en/2023"]
PAGES = "pages_catalog AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, strlen(html) AS size FROM pages)"
#: DuckDB: a name by digits' value, as natural_key.
NATURAL = "list_aggregate(list_transform(regexp_extract_all(lower({0}), '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN x[1] BETWEEN '0' AND '9' THEN lpad(length(ltrim(x, '0'))::VARCHAR, 4, '0') || ltrim(x, '0') ELSE x END), 'string_agg', '')"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _folders(spark: SparkSession, names: list[str], column: str = "folder") -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def _whole(rows: DataFrame, q: B.Query) -> DataFrame:
    """All rows of the listing: the SQL of these queries has no limit."""
    return B.browse(rows, q, limit=None)


def _values(names: list[str]) -> str:
    return ", ".join(f"('{n}')" for n in names)


# ---- browsing


@query(f"WITH {PAGES} SELECT page_id, path, size FROM pages_catalog WHERE strip_accents(lower(path)) LIKE '%example%' AND strip_accents(lower(path)) LIKE '%html%'")
def browse_search_pages(spark, d):
    return _whole(of_pages(spark, d), B.Query(scope="library", search="EXAMPLE html")).select("page_id", "path", "size")


@query(f"WITH {CAT} SELECT doc_id, path, row_number() OVER (ORDER BY {NATURAL.format('name')}, path) AS rank FROM catalog WHERE path LIKE 'src3/%'")
def browse_recursive_sorted(spark, d):
    rows = _whole(of_documents(spark, d), B.Query(folder="src3", recursive=True)).select("doc_id", "name", "path")
    return numbered(rows, [values.natural_key("name"), F.col("path")]).select("doc_id", "path", "rank")


@query(f"WITH {CAT} SELECT doc_id, name, coalesce(created_ms, modified_ms) AS made, row_number() OVER (ORDER BY coalesce(created_ms, modified_ms) DESC, {NATURAL.format('name')} DESC, path DESC) AS rank FROM catalog WHERE parent = 'src3/en'")
def browse_folder_by_created(spark, d):
    q = B.Query(folder="src3/en", sort="created", desc=True)
    rows = _whole(of_documents(spark, d), q).select("doc_id", "name", "path", "created_ms", "modified_ms")
    return numbered(rows, B.order_keys(q)).select("doc_id", "name", F.coalesce("created_ms", "modified_ms").alias("made"), "rank")


@query(f"WITH {CAT} SELECT doc_id, kind FROM catalog WHERE kind = 'photo' AND contains(strip_accents(lower(path)), 'resume')")
def browse_kind_search(spark, d):
    return _whole(of_documents(spark, d), B.Query(scope="library", kind="photo", search="RESUME")).select("doc_id", "kind")


@query(f"WITH {CAT}, c AS (SELECT doc_id, CASE WHEN kind = 'photo' AND name LIKE 'Screenshot%' THEN 1 WHEN kind = 'video' AND name LIKE 'Screenshot%' THEN 2 ELSE 0 END AS capture FROM catalog) SELECT doc_id, capture FROM c WHERE capture > 0")
def capture_classes(spark, d):
    c = of_documents(spark, d)
    shots = _whole(c, B.Query(scope="library", kind="screenshot"))
    return shots.union(_whole(c, B.Query(scope="library", kind="recording"))).select("doc_id", "capture")


@query(f"WITH {CAT} SELECT count(*) AS total, count(*) > 300 AS truncated FROM catalog WHERE kind = 'photo' OR kind = 'gif' OR kind = 'video'")
def browse_total_truncated(spark, d):
    return B.page_summary(of_documents(spark, d).where("kind IN ('photo', 'gif', 'video')"), 300)


@query(f"WITH {CAT} SELECT doc_id, path FROM (SELECT doc_id, path, row_number() OVER (ORDER BY size DESC, path) AS n FROM catalog) WHERE n BETWEEN 51 AND 150")
def browse_page(spark, d):
    return B.page(of_documents(spark, d), [F.desc("size"), F.col("path")], 50, 100).select("doc_id", "path")


@query(f"WITH {CAT}, s AS (SELECT path, string_split(path, '/') AS seg FROM catalog), n AS (SELECT path, seg, unnest(range(1, len(seg) + 1)) AS k FROM s) SELECT path, (k - 1)::INT AS depth, array_to_string(seg[1:k], '/') AS crumb FROM n")
def breadcrumbs(spark, d):
    return B.breadcrumbs(of_documents(spark, d))


@query(f"WITH {CAT}, f AS (SELECT DISTINCT parent AS path FROM catalog), a AS (SELECT path FROM f UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM f WHERE contains(path, '/')), b AS (SELECT path FROM a UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM a WHERE contains(path, '/')) SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, row_number() OVER (ORDER BY {NATURAL.format('path')}) AS rank FROM b WHERE NOT contains(path, '/')")
def subfolders(spark, d):
    top = B.subfolders(B.folders_of(of_documents(spark, d)), "")
    return numbered(top.select("path", "name"), [values.natural_key("name"), F.col("path")])


@query(f"WITH {CAT} SELECT count(*) FILTER (kind = 'audio') AS audios, count(*) FILTER (kind = 'document') AS documents, count(*) FILTER (kind = 'gif') AS gifs, count(*) FILTER (kind = 'other') AS others, count(*) FILTER (kind = 'photo') AS photos, count(*) FILTER (kind = 'video') AS videos, count(*) FILTER (kind = 'photo' AND name LIKE 'Screenshot%') AS screenshots, count(*) FILTER (kind = 'video' AND name LIKE 'Screenshot%') AS recordings, 0::BIGINT AS favorites, sum(size)::BIGINT AS bytes FROM catalog")
def drive_stats(spark, d):
    return B.stats(of_documents(spark, d))


@query(f"WITH {CAT}, p(folder) AS (VALUES {_values(PRIVATE)}) SELECT doc_id, coalesce(max(length(folder)), 0)::INT AS boundary FROM catalog LEFT JOIN p ON starts_with(path, folder || '/') GROUP BY doc_id")
def private_boundaries(spark, d):
    return B.boundaries(of_documents(spark, d), _folders(spark, PRIVATE)).select("doc_id", "boundary")


@query(f"WITH {CAT}, p(folder) AS (VALUES {_values(PRIVATE)}), b AS (SELECT doc_id, parent, path, coalesce(max(length(folder)), 0) AS boundary FROM catalog LEFT JOIN p ON starts_with(path, folder || '/') GROUP BY ALL) SELECT doc_id FROM b WHERE path LIKE 'src2/%' AND (boundary = 0 OR boundary <= 4)")
def visible_from_scope(spark, d):
    rows = B.boundaries(of_documents(spark, d), _folders(spark, PRIVATE))
    return _whole(rows, B.Query(folder="src2", recursive=True)).select("doc_id")


@query(f"WITH {CAT} SELECT doc_id, path FROM catalog WHERE contains(strip_accents(lower(path)), 'resume') AND contains(strip_accents(lower(path)), '7')")
def fold_search(spark, d):
    return of_documents(spark, d).where(B.matches(B.Query(scope="library", search="résumé 7"))).select("doc_id", "path")


@query(f"WITH {CAT} SELECT doc_id, row_number() OVER (ORDER BY {NATURAL.format('name')}, doc_id) AS rank FROM catalog")
def natural_sort_rank(spark, d):
    return numbered(of_documents(spark, d).select("doc_id", "name"), [values.natural_key("name"), F.col("doc_id")]).select("doc_id", "rank")


# ---- storage


@query(f"WITH {CAT} SELECT kind, sum(size)::BIGINT AS bytes, count(*) AS files FROM catalog GROUP BY kind")
def storage_by_kind(spark, d):
    return T.by_kind(of_documents(spark, d))


@query(f"WITH {CAT} SELECT strftime(make_timestamp(least(coalesce(created_ms, modified_ms), greatest(modified_ms, 1)) * 1000), '%Y') AS year, sum(size)::BIGINT AS bytes, count(*) AS files FROM catalog GROUP BY 1")
def storage_by_year(spark, d):
    return T.by_year(of_documents(spark, d))


@query(f"WITH {CAT}, s AS (SELECT size, string_split(parent, '/') AS seg FROM catalog), n AS (SELECT size, seg, unnest(range(1, len(seg) + 1)) AS k FROM s) SELECT array_to_string(seg[1:k], '/') AS folder, sum(size)::BIGINT AS bytes, count(*) AS files FROM n GROUP BY 1")
def folder_rollup(spark, d):
    return T.rollup(of_documents(spark, d))


@query(f"WITH {CAT} SELECT doc_id, path, size::BIGINT AS size FROM catalog ORDER BY size DESC, path LIMIT 100")
def largest_topk(spark, d):
    return T.largest(of_documents(spark, d), 100).select("doc_id", "path", "size")


@query(f"WITH {CAT} SELECT kind, path, rank FROM (SELECT kind, path, row_number() OVER (PARTITION BY kind ORDER BY size DESC, path)::INT AS rank FROM catalog) WHERE rank <= 50")
def largest_by_kind(spark, d):
    return T.ranked(of_documents(spark, d), "kind", F.desc("size"), F.col("path")).where("rank <= 50").select("kind", "path", "rank")


@query(f"""WITH {CAT}, r AS (SELECT path[6:] AS rel, size, path FROM catalog WHERE path LIKE 'src3/%'), x AS (SELECT rel[4:] AS rel, size, path FROM r WHERE rel LIKE 'en/%'),
own AS (SELECT rel, size, row_number() OVER (ORDER BY size DESC, path) AS n FROM x WHERE NOT contains(rel, '/'))
SELECT 'folder' AS kind, split_part(rel, '/', 1) AS name, sum(size)::BIGINT AS bytes, count(*) AS items FROM x WHERE contains(rel, '/') GROUP BY 2
UNION ALL SELECT 'file', rel, size::BIGINT, 1 FROM own WHERE n <= 10 UNION ALL SELECT 'rest', '', sum(size)::BIGINT, count(*) FROM own WHERE n > 10 HAVING count(*) > 0""")
def treemap_tiles(spark, d):
    return T.tiles(of_documents(spark, d), "src3/en", 10)


@query(f"""WITH {CAT}, e(path) AS (SELECT 'empty' || i || s FROM range(20) t(i), (VALUES (''), ('/a'), ('/a/b')) v(s)), f AS (SELECT path FROM e UNION ALL SELECT DISTINCT parent FROM catalog),
x AS (SELECT path FROM f WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE starts_with(c.path, f.path || '/')))
SELECT path, (SELECT count(*) FROM x y WHERE starts_with(y.path, x.path || '/')) AS nested FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.path = regexp_replace(x.path, '/[^/]*$', '') AND contains(x.path, '/'))""")
def empty_folders(spark, d):
    files = of_documents(spark, d)
    made = spark.range(20).select(F.explode(F.array(*[F.concat(F.lit("empty"), F.col("id").cast("string"), F.lit(s)) for s in ("", "/a", "/a/b")])).alias("path"))
    return T.empty_folders(made.union(files.select(paths.parent_of("path")).distinct()), files)


# ---- exact copies


@query("SELECT strlen(text) AS size, sha256(text) AS hash, count(*) AS members, strlen(text) * (count(*) - 1) AS recoverable FROM documents WHERE strlen(text) > 0 GROUP BY 1, 2 HAVING count(*) > 1")
def dup_groups(spark, d):
    return D.groups(D.hashed(of_documents(spark, d), "text"))


@query("WITH g AS (SELECT strlen(text) AS size, count(*) AS n FROM documents WHERE strlen(text) > 0 GROUP BY text HAVING count(*) > 1) SELECT count(*) AS groups, sum(n)::BIGINT AS files, sum(size * (n - 1))::BIGINT AS recoverable FROM g")
def dup_recoverable(spark, d):
    return D.groups(D.hashed(of_documents(spark, d), "text")).agg(F.count("*").alias("groups"), F.sum("members").alias("files"), F.sum("recoverable").alias("recoverable"))


@query(f"""WITH {CAT}, g AS (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM catalog WHERE size > 0)
SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY CASE WHEN name LIKE '% copy%' OR name LIKE '%copy of%' THEN 30 ELSE 0 END, coalesce(created_ms, modified_ms), strlen(path), path) = 1 AS keep FROM g WHERE n > 1""")
def dup_keeper(spark, d):
    return D.with_keeper(D.members(D.hashed(of_documents(spark, d), "text")), ["size", "hash"]).select("doc_id", "keep")


@query(f"""WITH {CAT}, g AS (SELECT *, count(*) OVER (PARTITION BY text) AS n, name LIKE '% copy%' AS cp, coalesce(created_ms, modified_ms) AS made,
row_number() OVER (PARTITION BY text ORDER BY CASE WHEN name LIKE '% copy%' THEN 30 ELSE 0 END, coalesce(created_ms, modified_ms), strlen(path), path) AS r FROM catalog WHERE size > 0)
SELECT sha256(text) AS hash, coalesce(nullif(concat_ws(',', CASE WHEN NOT bool_or(cp) FILTER (r = 1) AND bool_or(cp) FILTER (r > 1) THEN 'others-copy-named' END, CASE WHEN max(made) FILTER (r = 1) < min(made) FILTER (r > 1) THEN 'oldest' END), ''), 'shortest-path') AS reasons FROM g WHERE n > 1 GROUP BY text""")
def dup_reasons(spark, d):
    kept = D.with_keeper(D.members(D.hashed(of_documents(spark, d), "text")), ["size", "hash"])
    return D.reasons(kept, ["size", "hash"]).select("hash", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {CAT}, m AS (SELECT text, path, doc_id, count(*) OVER (PARTITION BY text) AS n, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM catalog WHERE size > 0), p AS (SELECT * FROM m WHERE n > 1 AND (r > 1 OR doc_id % 2 = 0)),
a AS (SELECT text, count(*) AS c, any_value(n) AS n FROM p GROUP BY text)
SELECT sha256(text) AS unit, 'all-copies' AS problem FROM a WHERE c >= n UNION SELECT sha256(text), 'locked' FROM p WHERE doc_id % 5 = 0 UNION SELECT 'none', 'no-member'""")
def dup_plan_violations(spark, d):
    m = D.members(D.hashed(of_documents(spark, d), "text"))
    members = m.select(F.col("hash").alias("unit"), "path", (F.col("doc_id") % 5 == 0).alias("locked"))
    first = F.row_number().over(Window.partitionBy("size", "hash").orderBy("doc_id"))
    plan = m.withColumn("r", first).where((F.col("r") > 1) | (F.col("doc_id") % 2 == 0)).select(F.col("hash").alias("unit"), "path")
    return D.plan_violations(plan.union(spark.createDataFrame([("none", "nowhere")], "unit string, path string")), members)


@query(f"""WITH {CAT}, h AS (SELECT parent, 'x' || (doc_id % 40) AS stem, path, ext FROM catalog WHERE ext IN ('jpg', 'png', 'mp4'))
SELECT parent, stem, max(path) FILTER (ext <> 'mp4') AS still, max(path) FILTER (ext = 'mp4') AS motion FROM h GROUP BY parent, stem HAVING count(*) FILTER (ext <> 'mp4') = 1 AND count(*) FILTER (ext = 'mp4') = 1""")
def live_pairs(spark, d):
    files = of_documents(spark, d).withColumn("name", F.concat(F.lit("X"), (F.col("doc_id") % 40).cast("string"), F.lit("."), "ext"))
    return D.live_pairs(files, ["jpg", "png"], ["mp4"])


@query(f"""WITH {CAT}, m AS (SELECT text, path, doc_id, count(*) OVER (PARTITION BY text) AS n FROM catalog WHERE size > 0 AND doc_id % 4 > 0) SELECT doc_id FROM m WHERE n > 1""")
def dup_forgotten(spark, d):
    m = D.members(D.hashed(of_documents(spark, d), "text"))
    return D.forget(m, m.where("doc_id % 4 = 0"), ["size", "hash"]).select("doc_id")


# ---- integrity

_BEFORE = "b AS (SELECT doc_id::VARCHAR AS rel, strlen(text) AS size, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3)"
_NOW = "n AS (SELECT doc_id::VARCHAR AS rel, strlen(text || CASE WHEN doc_id % 10 = 5 THEN '!' ELSE '' END) AS size, CASE WHEN doc_id % 10 <> 7 THEN sha256(text || CASE WHEN doc_id % 10 = 5 THEN '!' ELSE '' END) END AS h FROM documents WHERE doc_id % 10 <> 4)"
_DIFF = "x AS (SELECT coalesce(b.rel, n.rel) AS rel, CASE WHEN n.rel IS NULL THEN 'missing' WHEN b.rel IS NULL THEN 'added' WHEN n.h IS NULL THEN 'unreadable' WHEN b.size = n.size AND b.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM b FULL JOIN n ON b.rel = n.rel)"


def _snapshots(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("rel"), F.col("doc_id").alias("k"), "text")
    of = lambda x: x.select("rel", F.octet_length("text").alias("size"), F.when(F.col("ok"), I.sha256("text")).alias("sha256"))
    now = t.where("k % 10 <> 4").withColumn("text", F.concat("text", F.when(F.col("k") % 10 == 5, F.lit("!")).otherwise(F.lit("")))).withColumn("ok", F.col("k") % 10 != 7)
    return of(t.where("k % 10 <> 3").withColumn("ok", F.lit(True))), of(now)


@query(f"WITH {_BEFORE}, {_NOW}, {_DIFF} SELECT rel, status FROM x")
def snapshot_diff(spark, d):
    return I.diff(*_snapshots(spark, d))


@query(f"WITH {_BEFORE}, {_NOW}, {_DIFF} SELECT status, count(*) AS n FROM x GROUP BY status")
def snapshot_counts(spark, d):
    return I.counts(I.diff(*_snapshots(spark, d)))


@query("SELECT doc_id, strlen(text) AS size, sha256(text) AS sha256 FROM documents")
def checksum_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), I.sha256("text").alias("sha256"))


@query(f"WITH {_BEFORE}, {_NOW} SELECT b.rel, b.size = n.size AND b.h = n.h AS same FROM b JOIN n USING (rel)")
def compare_files(spark, d):
    return I.same_content(*_snapshots(spark, d), "rel")


# ---- findings


@query(f"""WITH {CAT}, n AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN name || '.exe' WHEN 1 THEN 'a' || chr(8238) || name WHEN 2 THEN 'x     ' || name WHEN 3 THEN name || ' ' ELSE name END AS name, ext FROM catalog)
SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 6 = 1 THEN 'bidi-control' END, CASE WHEN doc_id % 6 = 0 AND ext <> '' THEN 'double-extension' END, CASE WHEN doc_id % 6 IN (2, 3) THEN 'padded-name' END) AS codes FROM n""")
def name_findings(spark, d):
    k = F.col("doc_id") % 6
    name = F.when(k == 0, F.concat("name", F.lit(".exe"))).when(k == 1, F.concat(F.lit("a‮"), "name")).when(k == 2, F.concat(F.lit("x     "), "name")).when(k == 3, F.concat("name", F.lit(" "))).otherwise(F.col("name"))
    rows = of_documents(spark, d).withColumn("name", name)
    return rows.select("doc_id", F.array_join(F.transform(X.name_findings(), lambda f: f["code"]), ",").alias("codes"))


_ENTRY = "CASE doc_id % 5 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN 'C:' WHEN 3 THEN 'a/../' ELSE '' END || path"


@query(f"WITH {CAT} SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'absolute' END, CASE WHEN doc_id % 5 = 2 THEN 'drive-letter' END, CASE WHEN doc_id % 5 IN (1, 3) THEN 'traversal' END) AS flags FROM catalog")
def path_flags(spark, d):
    return of_documents(spark, d).select("doc_id", F.array_join(paths.path_flags(F.expr(_ENTRY)), ",").alias("flags"))


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '..' WHEN 2 THEN repeat('x', 256) WHEN 3 THEN '.a' WHEN 4 THEN 'a:b' WHEN 5 THEN 'a.' WHEN 6 THEN 'com7.txt' WHEN 7 THEN 'fine.txt' ELSE 'a' || chr(8206) END AS name FROM documents)
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'empty' WHEN 1 THEN 'dots' WHEN 2 THEN 'long' WHEN 3 THEN 'hidden' WHEN 4 THEN 'characters' WHEN 5 THEN 'ending' WHEN 6 THEN 'reserved' WHEN 8 THEN 'characters' END AS problem FROM n""")
def name_problems(spark, d):
    made = F.element_at(F.array(*map(F.lit, ["", "..", "x" * 256, ".a", "a:b", "a.", "com7.txt", "fine.txt", "a‎"])), (F.col("doc_id") % 9 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", paths.name_problem(made).alias("problem"))


@query("SELECT page_id, CASE WHEN lower(ltrim(html)) LIKE '<!doctype html%' OR lower(ltrim(html)) LIKE '<html%' THEN 'html' ELSE 'text' END AS type FROM pages")
def page_types(spark, d):
    return table(spark, d, "pages").select("page_id", kinds.type_of(F.col("html").cast("binary")).alias("type"))


#: Heads of six kinds, by doc_id: what they are is known, so the SQL needs no signatures.
_HEADS = ["FFD8FFE000104A464946", "89504E470D0A1A0A0000000D4948445200000000000000100806", "4D5A9000", "255044462D312E34", "474946383961", "68656C6C6F"]
_BYTES = ("jpeg", "png", "pe", "pdf", "gif", "text")


def _samples(spark, d):
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % 6 + 1).cast("int")))
    rows = of_documents(spark, d)
    return X.assess(rows.withColumn("content", head).withColumn("size", F.octet_length("content").cast("long")))


@query("SELECT doc_id, ['jpeg', 'png', 'pe', 'pdf', 'gif', 'text'][(doc_id % 6)::INT + 1] AS type, ['image', 'image', 'executable', 'document', 'image', 'text'][(doc_id % 6)::INT + 1] AS family FROM documents")
def file_types(spark, d):
    return _samples(spark, d).select("doc_id", "type", kinds.family_of("type").alias("family"))


_EXPECT = "CASE ext WHEN 'jpg' THEN 'jpeg' WHEN 'png' THEN 'png' WHEN 'mp4' THEN 'mp4' WHEN 'gif' THEN 'gif' WHEN 'pdf' THEN 'pdf' WHEN 'mp3' THEN 'mp3' END"
_RISK = f"""t AS (SELECT *, ['jpeg', 'png', 'pe', 'pdf', 'gif', 'text'][(doc_id % 6)::INT + 1] AS type FROM catalog),
r AS (SELECT *, {_EXPECT} IS NOT NULL AND {_EXPECT} <> type AS wrong FROM t)"""


@query(f"""WITH {CAT}, {_RISK} SELECT doc_id, concat_ws(',', CASE WHEN wrong AND type = 'pe' THEN 'disguised-executable' END, CASE WHEN wrong AND type <> 'pe' THEN 'extension-mismatch' END,
CASE WHEN ext = '' AND type = 'pe' THEN 'unexpected-executable' END, CASE WHEN type = 'png' THEN 'invalid-dimensions' END, CASE WHEN type IN ('jpeg', 'png', 'gif', 'pdf') THEN 'truncated' END, CASE WHEN type = 'pe' THEN 'runs-code' END) AS codes FROM r""")
def risk_findings(spark, d):
    return _samples(spark, d).select("doc_id", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))


@query(f"""WITH {CAT}, {_RISK}, h AS (SELECT path, CASE WHEN wrong THEN 'risk' ELSE 'broken' END AS category, CASE WHEN wrong AND type = 'pe' THEN 'disguised-executable' WHEN wrong THEN 'extension-mismatch' ELSE 'truncated' END AS reason FROM r WHERE kind IN ('photo', 'gif', 'video', 'audio')) SELECT * FROM h""")
def health_priority(spark, d):
    return X.health(_samples(spark, d))


@query(f"WITH {CAT}, {_RISK}, h AS (SELECT CASE WHEN wrong THEN 'risk' ELSE 'broken' END AS category FROM r WHERE kind IN ('photo', 'gif', 'video', 'audio')) SELECT category, count(*) AS files FROM h GROUP BY 1")
def health_counts(spark, d):
    return X.health(_samples(spark, d)).groupBy("category").agg(F.count("*").alias("files"))


@query("""SELECT o_custkey AS archive, count(*) AS entries, sum((o_totalprice * 1000)::BIGINT)::BIGINT AS bytes, sum((o_orderkey % 97)::BIGINT)::BIGINT AS packed, max(o_orderkey % 5)::INT AS depth,
sum(CASE WHEN o_orderkey % 4 IN (0, 1) THEN 1 ELSE 0 END)::BIGINT AS flags, concat_ws(',', CASE WHEN sum((o_totalprice * 1000)::BIGINT) > 1000.0 * greatest(sum(o_orderkey % 97), 1) AND sum((o_totalprice * 1000)::BIGINT) > 1073741824 THEN 'bomb' END,
CASE WHEN sum((o_totalprice * 1000)::BIGINT) > 100.0 * greatest(sum(o_orderkey % 97), 1) AND sum((o_totalprice * 1000)::BIGINT) > 104857600 THEN 'high-ratio' END, CASE WHEN max(o_orderkey % 5) > 3 THEN 'deep' END) AS codes FROM orders GROUP BY 1""")
def archive_findings(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    path = F.concat(F.when(k == 0, "/").when(k == 1, "../").otherwise(""), F.col("o_orderkey").cast("string"))
    rows = o.select(F.col("o_custkey").alias("archive"), path.alias("path"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("size"), (F.col("o_orderkey") % 97).alias("packed"), (F.col("o_orderkey") % 5).cast("int").alias("depth"))
    return X.archive_findings(rows).withColumn("codes", F.array_join("codes", ","))


# ---- metadata

_CLASS = {k: v.replace("'", "''") for k, v in M.TEXT_CLASSES.items()}
_HAS = ", ".join(f"CASE WHEN regexp_matches(text, '{v}') THEN '{k}' END" for k, v in sorted(_CLASS.items()))


@query(f"WITH c AS (SELECT doc_id, list_filter([{_HAS}], lambda x: x IS NOT NULL) AS cs FROM documents) SELECT x AS category, count(*) AS files FROM (SELECT unnest(cs) AS x FROM c) GROUP BY 1")
def sensitive_category_counts(spark, d):
    return M.category_counts(table(spark, d, "documents").select(M.classes_of("text").alias("categories")))


@query(f"WITH c AS (SELECT doc_id, concat_ws(',', {_HAS}) AS categories FROM documents), h AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM c WHERE categories <> '') SELECT doc_id, categories FROM h WHERE n BETWEEN 11 AND 60")
def sensitive_hits_page(spark, d):
    h = M.hits(table(spark, d, "documents").select("doc_id", M.classes_of("text").alias("categories")))
    return B.page(h, [F.col("doc_id")], 10, 50).select("doc_id", F.array_join("categories", ",").alias("categories"))


@query("SELECT floor(s_acctbal / 500)::BIGINT AS cx, floor(s_suppkey / 10.0)::BIGINT AS cy, count(*) AS members, round(avg(s_suppkey::DOUBLE), 6) AS y FROM supplier GROUP BY 1, 2")
def grid_clusters(spark, d):
    g = M.grid(table(spark, d, "supplier").select((F.col("s_acctbal") / 50).alias("x"), F.col("s_suppkey").cast("double").alias("y")), 10.0)
    return g.select("cx", "cy", "members", F.round("y", 6).alias("y"))


@query("SELECT min(s_acctbal) AS x0, max(s_acctbal) AS x1, min(s_suppkey) AS y0, max(s_suppkey) AS y1 FROM supplier")
def bounding_box(spark, d):
    return M.bounds(table(spark, d, "supplier"), "s_acctbal", "s_suppkey")


@query("SELECT c_custkey AS id, round(c_acctbal / 100, 5) AS lat, round((c_custkey % 400 - 200)::DOUBLE, 5) AS lon FROM customer WHERE abs(c_acctbal / 100) <= 90 AND abs(c_custkey % 400 - 200) <= 180 AND NOT (c_acctbal = 0 AND c_custkey % 400 = 200)")
def places(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("lat"), (F.col("c_custkey") % 400 - 200).cast("double").alias("lon"))
    return M.places(c)


@query("WITH s AS (SELECT event_id, value, (SELECT count(*) FROM events) AS n FROM events) SELECT least(event_id // greatest(1, n // 600), 599) AS bin, max(abs(value)) AS peak FROM s GROUP BY 1")
def waveform_peaks(spark, d):
    e = table(spark, d, "events")
    return M.peaks(e, "event_id", "value", e.count())


# ---- near copies

_FP = "f AS (SELECT vec_id, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > list_sort(embedding)[33] THEN (1::HUGEINT << i) ELSE 0::HUGEINT END), lambda a, b: a + b) AS u FROM embeddings), h AS (SELECT vec_id, (u::UHUGEINT::BIT) AS b FROM f)"


def _prints(spark, d):
    """Written once: the median of a vector costs more than reading it again, and all queries read prints several times."""
    return cut(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), S.fingerprint("embedding").alias("h")))


_NEAR = f"{_FP}, e AS (SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.b, y.b))::INT AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.b, y.b)) <= 18)"


def _near(prints):
    return S.expand(S.candidates(prints, 18), S.members(prints))


@query(f"WITH {_NEAR} SELECT a, b, distance FROM e WHERE distance > 0")
def hash_candidates(spark, d):
    return _near(_prints(spark, d))


@query(f"WITH RECURSIVE {_NEAR}, w(id, r) AS (SELECT a, a FROM (SELECT a FROM e UNION SELECT b FROM e) UNION SELECT y.n, w.r FROM w JOIN (SELECT a AS v, b AS n FROM e UNION ALL SELECT b, a FROM e) y ON y.v = w.id) SELECT id, min(r) AS root FROM w GROUP BY id")
def similar_components(spark, d):
    prints = _prints(spark, d)
    return S.member_components(S.candidates(prints, 18), S.members(prints))


@query(f"""WITH RECURSIVE {_NEAR}, y AS (SELECT a AS v, b AS n, 100 - distance AS s FROM e UNION ALL SELECT b, a, 100 - distance FROM e),
o AS (SELECT v, list(n) AS near, row_number() OVER (ORDER BY any_value(label)::DOUBLE DESC, v) AS place FROM y JOIN embeddings ON vec_id = v GROUP BY v),
g(place, keepers, gone) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT o.place, CASE WHEN list_contains(gone, v) THEN keepers ELSE list_append(keepers, v) END, CASE WHEN list_contains(gone, v) THEN gone ELSE list_concat(gone, near) END FROM g JOIN o ON o.place = g.place + 1),
all_k AS (SELECT unnest((SELECT keepers FROM g ORDER BY place DESC LIMIT 1)) AS keeper)
SELECT arg_min(n, o.place) AS keeper, y.v AS member, arg_min(s, o.place)::INT AS similarity FROM y JOIN all_k ON n = keeper JOIN o ON o.v = n WHERE y.v NOT IN (SELECT keeper FROM all_k) GROUP BY y.v""")
def similar_groups(spark, d):
    prints = _prints(spark, d)
    e = S.candidates(prints, 18).select("a", "b", (F.lit(100) - F.col("distance")).cast("int").alias("similarity"))
    quality = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("q"), F.col("vec_id").alias("modified_ms"), F.col("vec_id").cast("string").alias("path"))
    return S.member_groups(e, S.members(prints), quality)


@query(f"WITH {_NEAR} SELECT a, b FROM e WHERE distance > 0 AND (a + b) % 3 <> 0")
def dismissed_anti(spark, d):
    e = _near(_prints(spark, d))
    return S.without_dismissed(e, e.where((F.col("a") + F.col("b")) % 3 == 0).select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a", "b")


_VIDEOS = "v AS (SELECT p_partkey AS id, (p_retailprice * 100)::BIGINT * 7 AS dur, 600 + p_size * 10 AS w, 400 AS h FROM part)"


@query(f"WITH {_VIDEOS} SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON (x.dur < y.dur OR (x.dur = y.dur AND x.id < y.id)) AND y.dur <= x.dur * 1.15::DOUBLE + 2000 AND abs(ln(x.w::DOUBLE / x.h) - ln(y.w::DOUBLE / y.h)) <= 0.05::DOUBLE")
def range_candidates(spark, d):
    v = table(spark, d, "part")
    return S.range_pairs(v.select(F.col("p_partkey").alias("id"), (F.round(F.col("p_retailprice") * 100).cast("long") * 7).alias("duration"), (F.lit(600) + F.col("p_size") * 10).alias("w"), F.lit(400).alias("h")))


@query("""WITH g AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w <= 3600000 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id) AS burst FROM g)
SELECT user_id, burst::BIGINT AS burst, count(*) AS frames, max(t) - min(t) AS span_ms FROM r GROUP BY 1, 2 HAVING count(*) >= 3""")
def bursts(spark, d):
    shots = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"))
    return S.bursts(shots, ["user_id"], gap_ms=3_600_000)


# ---- organising

_TAGGED = "t AS (SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 1 END, CASE WHEN doc_id % 3 = 0 THEN 2 END, CASE WHEN doc_id % 7 = 0 THEN 3 END], lambda x: x IS NOT NULL) AS tags FROM documents)"


def _tagged(spark, d):
    files = of_documents(spark, d)
    k = F.col("doc_id")
    tags = F.array_compact(F.array(*[F.when(k % n == 0, F.lit(i)) for i, n in ((1, 2), (2, 3), (3, 7))]))
    return O.with_tags(files, files.select("path", F.explode(tags).alias("tag")))


@query(f"WITH {_TAGGED}, c AS (SELECT x, count(*) AS n FROM (SELECT unnest(tags) AS x FROM t) GROUP BY x) SELECT v.id, v.name, coalesce(c.n, 0) AS items FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd')) v(id, name) LEFT JOIN c ON c.x = v.id")
def tag_counts(spark, d):
    return O.tag_counts(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, name string"), _tagged(spark, d))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def tag_filter(spark, d):
    return _whole(_tagged(spark, d), B.Query(scope="library", kind="tag:2")).select("doc_id")


@query("SELECT l.doc_id FROM labels l JOIN documents USING (doc_id) WHERE quality = 1 AND toxic = 0")
def favorites(spark, d):
    files = of_documents(spark, d)
    chosen = files.join(table(spark, d, "labels").where("quality = 1 AND toxic = 0"), "doc_id", "left_semi")
    return _whole(O.with_favorites(files, chosen), B.Query(scope="library", kind="favorites")).select("doc_id")


@query(f"WITH {CAT}, p(folder) AS (VALUES {_values(PROTECTED)}) SELECT doc_id, EXISTS (SELECT 1 FROM p WHERE path = folder OR starts_with(path, folder || '/')) AS protected FROM catalog")
def protected_guard(spark, d):
    return B.covered(of_documents(spark, d), _folders(spark, PROTECTED), "protected").select("doc_id", "protected")


@query(f"""WITH {CAT}, f AS (SELECT DISTINCT parent AS path FROM catalog UNION SELECT DISTINCT source FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents), p(folder) AS (VALUES {_values(PROTECTED)})
SELECT path, CASE WHEN EXISTS (SELECT 1 FROM p WHERE path = folder OR starts_with(path, folder || '/')) THEN 'protected' WHEN EXISTS (SELECT 1 FROM p WHERE starts_with(folder, path || '/')) THEN 'contains-protected' END AS refusal FROM f""")
def mutation_policy(spark, d):
    return O.refusal(B.folders_of(of_documents(spark, d)).select("path"), _folders(spark, PROTECTED))


@query("SELECT 'old/' || c_custkey AS path, 'new/' || c_custkey AS now FROM customer WHERE c_custkey % 5 = 0")
def followed_private(spark, d):
    c = table(spark, d, "customer")
    gone = F.col("c_custkey") % 5 == 0
    private = c.select(F.concat(F.lit("old/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").alias("ino"))
    now = c.select(F.concat(F.when(gone, "new/").otherwise("old/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").alias("ino"))
    return O.follow_private(private, now)


@query(f"WITH {CAT} SELECT doc_id, CASE WHEN path LIKE 'src3/%' THEN 'moved/here' || path[5:] ELSE path END AS path FROM catalog")
def rename_follow(spark, d):
    return O.follow_rename(of_documents(spark, d), "src3", "moved/here").select("doc_id", "path")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS id FROM events WHERE event_type <> 'error' GROUP BY user_id")
def last_undoable(spark, d):
    return O.last_undoable(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "user_id", (F.col("event_type") == "error").alias("undone")), "user_id")


@query("SELECT user_id, event_id AS id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def history_trimmed(spark, d):
    return O.trimmed(table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at")), "user_id", 20).select("user_id", "id")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS DISTINCT FROM 'click' GROUP BY 1")
def forget_volume(spark, d):
    return O.forget_volume(table(spark, d, "events").withColumnRenamed("event_type", "volume"), "click").groupBy(F.col("volume").alias("event_type")).agg(F.count("*").alias("n"))


_LAST = "d AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS decision FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1)"


@query(f"WITH {_LAST} SELECT user_id, CASE decision WHEN 'click' THEN 'keep' ELSE 'mark' END AS decision FROM d")
def cleanup_decisions(spark, d):
    e = table(spark, d, "events").where("event_type IN ('click', 'purchase')")
    return O.latest_decisions(e.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "click", "keep").otherwise("mark").alias("decision")), "user_id", ["ts", "event_id"])


@query(f"WITH {_LAST} SELECT count(*) FILTER (decision = 'click') AS kept, count(*) FILTER (decision = 'purchase') AS marked, count(*) FILTER (decision IS NULL) AS undecided, coalesce(sum(c_nationkey) FILTER (decision = 'purchase'), 0)::BIGINT AS marked_bytes FROM customer LEFT JOIN d ON user_id = c_custkey")
def cleanup_counts(spark, d):
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("size"))
    return O.decision_counts(items, cleanup_decisions(spark, d), "user_id")


# ---- plans


@query(f"WITH {CAT}, s(item) AS (VALUES ('src3'), ('src4/en'), ('src4/en/2023'), ('nowhere')) SELECT item, count(path) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM s LEFT JOIN catalog ON path = item OR starts_with(path, item || '/') GROUP BY item")
def selection_rollup(spark, d):
    return P.roll_up(of_documents(spark, d), _folders(spark, ["src3", "src4/en", "src4/en/2023", "nowhere"], "item"))


@query(f"WITH {CAT}, s(item) AS (VALUES ('src3'), ('src4/en')), r AS (SELECT item, count(path) AS n, coalesce(sum(size), 0) AS b FROM s LEFT JOIN catalog ON starts_with(path, item || '/') GROUP BY item) SELECT count(*) AS entries, sum(n)::BIGINT AS files, sum(b)::BIGINT AS bytes, true AS typed FROM r")
def plan_totals(spark, d):
    return P.totals(P.roll_up(of_documents(spark, d), _folders(spark, ["src3", "src4/en"], "item")), folders=2)


@query(f"""WITH {CAT}, b AS (SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN upper(stem) ELSE stem END AS name, strip_accents(lower(stem)) AS f FROM (SELECT doc_id, regexp_replace(stem, '[0-9]+$', '') || (doc_id // 50) AS stem FROM catalog WHERE doc_id % 2 = 0)),
t AS (SELECT DISTINCT lower(regexp_replace(stem, '[0-9]+$', '') || (doc_id // 50)) AS f FROM catalog WHERE doc_id % 20 = 1)
SELECT seq, CASE WHEN lower(name) IN (SELECT f FROM t) THEN 'exists' WHEN row_number() OVER (PARTITION BY f ORDER BY seq) > 1 THEN 'batch' END AS conflict FROM b""")
def transfer_conflicts(spark, d):
    stem = F.concat(F.regexp_replace(paths.stem_of("name"), "[0-9]+$", ""), F.floor(F.col("doc_id") / 50).cast("string"))
    rows = of_documents(spark, d).withColumn("stem", stem)
    batch = rows.where("doc_id % 2 = 0").select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, F.upper("stem")).otherwise(F.col("stem")).alias("name"))
    return P.transfer(batch, rows.where("doc_id % 20 = 1").select(F.col("stem").alias("name"))).select("seq", "conflict")


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'photo 4.jpg' WHEN 1 THEN 'photo 4.jpg' ELSE 'new.txt' END AS name FROM documents")
def free_names(spark, d):
    docs = table(spark, d, "documents")
    wanted = docs.select(F.col("doc_id").alias("id"), F.element_at(F.array(F.lit("photo.jpg"), F.lit("photo 2.jpg"), F.lit("new.txt")), (F.col("doc_id") % 3 + 1).cast("int")).alias("name"))
    return P.free_names(wanted, spark.createDataFrame([("photo.jpg",), ("photo 2.jpg",), ("photo 3.jpg",)], "name string"))


@query(f"WITH {CAT} SELECT doc_id, CASE WHEN parent = 'src3/en' THEN 'parent' WHEN doc_id % 9 = 0 AND false THEN 'same' END AS refusal FROM catalog WHERE path LIKE 'src3/%'")
def drop_targets(spark, d):
    rows = of_documents(spark, d).where("path LIKE 'src3/%'").withColumn("moved", F.col("path")).withColumn("target", F.lit("src3/en"))
    return rows.select("doc_id", P.drop_refusal().alias("refusal"))


@query("SELECT CASE source WHEN 'src0' THEN 'index' WHEN 'src1' THEN 'thumbnails' ELSE 'other' END AS category, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def local_inventory(spark, d):
    return P.inventory(of_documents(spark, d), {"src0": "index", "src1": "thumbnails"})


@query(f"WITH {CAT}, l AS (SELECT path, row_number() OVER (ORDER BY path) AS pos FROM catalog), k AS (SELECT pos FROM l WHERE pos NOT BETWEEN 40 AND 60) SELECT coalesce((SELECT min(pos) FROM k WHERE pos >= 50), (SELECT max(pos) FROM k WHERE pos < 50))::INT AS pos")
def selection_neighbour(spark, d):
    rows = numbered(of_documents(spark, d).select("path"), [F.col("path")], "pos")
    return P.neighbour(rows, rows.where("pos BETWEEN 40 AND 60"), 50)


@query(f"WITH {CAT}, b AS (SELECT doc_id, path FROM catalog WHERE doc_id % 2 = 0), n AS (SELECT doc_id, path FROM catalog WHERE doc_id % 3 = 0) SELECT path FROM (SELECT path FROM n EXCEPT SELECT path FROM b)")
def arrivals(spark, d):
    c = of_documents(spark, d)
    return c.where("doc_id % 3 = 0").select("path").exceptAll(c.where("doc_id % 2 = 0").select("path"))


# ---- streams, run to the end of what is there


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, d):
    e = table(spark, d, "events")
    return J.collected(J.windowed(J.source(spark, e, f"{d}/event?.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "1 hour", "30 days"), "update", ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_totals(spark, d):
    return J.collected(J.totals(J.source(spark, table(spark, d, "events"), f"{d}/event?.parquet"), "event_type"), "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n FROM r GROUP BY user_id, s""")
def stream_sessions(spark, d):
    e = J.source(spark, table(spark, d, "events"), f"{d}/event?.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.collected(J.sessions(e, "user_id", "2 hours", "30 days"), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


# The other modules of this package register theirs.
from . import disk as disk_queries, kept as kept_queries, media as media_queries, more as more_queries, overview as overview_queries, values as value_queries  # noqa: E402

__all__ = ["QUERIES", "SQL", "disk_queries", "kept_queries", "media_queries", "more_queries", "overview_queries", "small", "value_queries"]
