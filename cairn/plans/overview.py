"""Registered queries of totals, layouts, visible health and reasons, each with SQL written independently of it."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import browse as B, findings as X, similar as S, storage as T
from ..sources.catalog import CATALOG_SQL as CAT, of_documents
from .queries import _RISK, PRIVATE, _folders, _samples, _values, query

_SHUT = f"p(folder) AS (VALUES {_values(PRIVATE)})"
_OPEN = "NOT EXISTS (SELECT 1 FROM p WHERE starts_with({0}.path, p.folder || '/'))"


@query(f"""WITH {CAT}, {_SHUT}, f AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'link' ELSE kind END AS k FROM catalog c WHERE {_OPEN.format('c')}), all_d AS (SELECT source AS path FROM documents UNION SELECT source || '/' || lang FROM documents UNION SELECT source || '/' || lang || '/2023' FROM documents WHERE doc_id % 3 = 0),
d AS (SELECT * FROM all_d WHERE {_OPEN.format('all_d')})
SELECT count(*) AS files, (SELECT count(*) FROM d) AS folders, count(*) FILTER (doc_id % 10 = 1) + (SELECT count(*) FROM d WHERE path IN ('src2', 'src3/de', 'src2/fr')) AS favorites, count(*) FILTER (k = 'audio') AS audios, count(*) FILTER (k = 'document') AS documents, count(*) FILTER (k = 'gif') AS gifs, count(*) FILTER (k = 'link') AS links,
count(*) FILTER (k = 'other') AS others, count(*) FILTER (k = 'photo') AS photos, count(*) FILTER (k = 'video') AS videos, count(*) FILTER (kind = 'photo' AND name LIKE 'Screenshot%') AS screenshots, count(*) FILTER (kind = 'video' AND name LIKE 'Screenshot%') AS recordings, coalesce(sum(size), 0)::BIGINT AS bytes FROM f""")
def drive_totals(spark, d):
    """Each ninth file is a link; each tenth and three folders, two of them not to be seen, are favourites."""
    files = of_documents(spark, d).withColumn("kind", F.when(F.col("doc_id") % 9 == 0, "link").otherwise(F.col("kind")))
    loved = files.where("doc_id % 10 = 1").select("path").union(_folders(spark, ["src2", "src3/de", "src2/fr"], "path"))
    return B.drive_totals(files, B.folders_of(files), loved, _folders(spark, PRIVATE, "path"))


@query(f"WITH {CAT}, {_RISK}, {_SHUT}, h AS (SELECT CASE WHEN wrong THEN 'risk' ELSE 'broken' END AS category FROM r WHERE kind IN ('photo', 'gif', 'video', 'audio') AND {_OPEN.format('r')}) SELECT category, count(*) AS files FROM h GROUP BY 1")
def health_visible(spark, d):
    return X.visible_health(_samples(spark, d), _folders(spark, PRIVATE, "path")).groupBy("category").agg(F.count("*").alias("files"))


@query(f"""WITH {CAT}, own AS (SELECT parent AS folder, name, coalesce(size, 0) AS size, row_number() OVER (PARTITION BY parent ORDER BY coalesce(size, 0) DESC, path) AS n FROM catalog),
up AS (SELECT '' AS folder, split_part(parent, '/', 1) AS name, size FROM catalog UNION ALL SELECT split_part(parent, '/', 1), split_part(parent, '/', 2), size FROM catalog UNION ALL SELECT split_part(parent, '/', 1) || '/' || split_part(parent, '/', 2), split_part(parent, '/', 3), size FROM catalog WHERE split_part(parent, '/', 3) <> ''),
t AS (SELECT folder, 'folder' AS kind, name, coalesce(sum(size), 0)::BIGINT AS bytes FROM up GROUP BY ALL UNION ALL SELECT folder, 'file', name, size FROM own WHERE n <= 10 UNION ALL SELECT folder, 'rest', '', sum(size)::BIGINT FROM own WHERE n > 10 GROUP BY folder)
SELECT folder, kind, name, round(bytes / sum(bytes) OVER (PARTITION BY folder), 6) AS share, true AS inside, 1.0::DOUBLE AS filled FROM t WHERE bytes > 0""")
def folder_layouts(spark, d):
    """Of every folder's tiles: the share of its rectangle, whether that lies within the screen, and how much of the screen all of the folder's fill."""
    w, h, slack = 1600.0, 900.0, 1e-6
    r = T.layouts(T.all_tiles(of_documents(spark, d), 10), w, h)
    inside = (F.col("x") >= -slack) & (F.col("y") >= -slack) & (F.col("x") + F.col("w") <= w + slack) & (F.col("y") + F.col("h") <= h + slack)
    filled = F.round(F.sum(F.col("w") * F.col("h")).over(Window.partitionBy("folder")) / (w * h), 6)
    return r.select("folder", "kind", "name", F.round(F.col("w") * F.col("h") / (w * h), 6).alias("share"), inside.alias("inside"), filled.alias("filled"))


_PENALTY = "(CASE WHEN contains(lower(name), 'copy') THEN 4 ELSE 0 END + CASE WHEN contains(lower(name), 'screenshot') THEN 4 ELSE 0 END)"
_MEDIA = f"""m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper, (doc_id % 90 + 10) * (doc_id % 70 + 10) AS px, CASE WHEN doc_id % 4 = 0 THEN doc_id % 50 * 1000 END AS ms, doc_id % 3 = 0 AS exif, doc_id % 5 = 0 AS live, ext, size + doc_id % 13 AS size, modified_ms, {_PENALTY} AS penalty FROM catalog WHERE size > 0)"""


@query(f"""WITH {CAT}, {_MEDIA}, j AS (SELECT k.doc_id AS keeper, k.px AS kpx, o.px, k.ms AS kms, o.ms, k.exif AS kexif, o.exif, k.live AS klive, o.live, k.ext AS kext, o.ext, k.size AS ksize, o.size, k.modified_ms AS kmod, o.modified_ms AS mod, k.penalty AS kpen, o.penalty AS pen FROM m k JOIN m o ON o.keeper = k.doc_id AND o.doc_id <> k.doc_id)
SELECT keeper, coalesce(nullif(concat_ws(',', CASE WHEN bool_and(kpx > px) THEN 'resolution' END, CASE WHEN bool_and(coalesce(ms + 500 < kms, false)) THEN 'longest' END, CASE WHEN bool_and(klive AND NOT live) THEN 'live' END, CASE WHEN bool_or(kexif AND NOT exif) THEN 'camera-data' END,
CASE WHEN any_value(kms) IS NULL AND bool_or(px = kpx) AND coalesce(bool_and(size < ksize) FILTER (px = kpx), false) THEN 'least-compressed' END, CASE WHEN bool_or(kpen = 0 AND pen > 0) THEN 'original-name' END, CASE WHEN bool_and(kmod < mod) THEN 'oldest' END), ''), 'equivalent') AS reasons FROM j GROUP BY keeper""")
def similar_reasons(spark, d):
    """Equal texts are groups, led by the smallest id."""
    k = F.col("doc_id")
    files = of_documents(spark, d).where("size > 0")
    media = files.select(k.alias("id"), "name", "path", "ext", (F.col("size") + k % 13).alias("size"), "modified_ms", (k % 90 + 10).alias("w"), (k % 70 + 10).alias("h"), F.when(k % 4 == 0, k % 50 * 1000).alias("duration_ms"), (k % 3 == 0).alias("exif"), (k % 5 == 0).alias("live"))
    leads = files.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("keeper"))
    groups = files.select(F.sha2("text", 256).alias("h"), k.alias("member")).join(leads, "h").where("keeper <> member").select("keeper", "member")
    return S.reasons(groups, media).select("keeper", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {CAT} SELECT doc_id, round(ln(((doc_id % 90 + 10) * (doc_id % 70 + 10))::DOUBLE) * 10 - {_PENALTY} + ln(greatest(size::DOUBLE / ((doc_id % 90 + 10) * (doc_id % 70 + 10)), 1e-6)) + CASE WHEN doc_id % 3 = 0 THEN 3.0 ELSE 0.0 END + CASE WHEN ext = 'jpg' THEN 1.0 ELSE 0.0 END + CASE WHEN doc_id % 5 = 0 THEN 5.0 ELSE 0.0 END, 6) AS q FROM catalog WHERE kind = 'photo'")
def live_quality(spark, d):
    """Photos; each fifth has its motion beside it."""
    k = F.col("doc_id")
    rows = of_documents(spark, d).where("kind = 'photo'").withColumns({"w": k % 90 + 10, "h": k % 70 + 10, "exif": k % 3 == 0, "duration_ms": F.lit(None).cast("long")})
    return rows.select("doc_id", F.round(S.quality(k % 5 == 0), 6).alias("q"))
