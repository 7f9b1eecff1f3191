"""Catalogs: frames with a row per file or folder, from tables or from a folder tree."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import kinds, paths
from ..session import cut, small

MAX_DEPTH = 64
SCAN_SCHEMA = "path string, is_dir boolean, size long, modified_ms long, created_ms long, dev long, ino long, links int, link string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def described(files: DataFrame) -> DataFrame:
    """Adds what follows from ``path``: name, parent, ext, kind, capture class."""
    name = paths.name_of("path")
    out = files.withColumn("name", name).withColumn("parent", paths.parent_of("path")).withColumn("ext", paths.ext_of(name))
    return out.withColumn("kind", kinds.kind_of_ext("ext")).withColumn("capture", kinds.capture_of("name", "kind"))


def of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: a fixed rule names them; sizes are their bytes."""
    d = table(spark, sf_dir, "documents")
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    stem = F.concat(pick(5, ["IMG_", "Screenshot ", "vid-", "Résumé ", "note copy"]), F.col("doc_id").cast("string"))
    folder = F.concat_ws("/", "source", "lang", F.when(F.col("doc_id") % 3 == 0, F.lit("2023")))
    path = F.concat(folder, F.lit("/"), stem, pick(7, [".jpg", ".PNG", ".mp4", ".gif", ".pdf", ".mp3", ""]))
    modified = F.lit(1_672_531_200_000) + F.col("doc_id") * 40_000_000
    rows = d.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), modified.alias("modified_ms"), F.when(F.col("doc_id") % 4 > 0, modified - F.col("doc_id") % 11 * 3_600_000).alias("created_ms"), "text")
    return described(rows)


#: The same catalog in DuckDB's SQL, written on its own.
CATALOG_SQL = """
base AS (SELECT doc_id, text, strlen(text) AS size, source || '/' || lang || CASE WHEN doc_id % 3 = 0 THEN '/2023' ELSE '' END AS parent,
   CASE doc_id % 5 WHEN 0 THEN 'IMG_' WHEN 1 THEN 'Screenshot ' WHEN 2 THEN 'vid-' WHEN 3 THEN 'Résumé ' ELSE 'note copy' END || doc_id AS stem,
   CASE doc_id % 7 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'mp4' WHEN 3 THEN 'gif' WHEN 4 THEN 'pdf' WHEN 5 THEN 'mp3' ELSE '' END AS ext,
   1672531200000 + doc_id * 40000000 AS modified_ms FROM documents),
catalog AS (SELECT *, stem || CASE WHEN ext = '' THEN '' WHEN ext = 'png' THEN '.PNG' ELSE '.' || ext END AS name, parent || '/' || stem || CASE WHEN ext = '' THEN '' WHEN ext = 'png' THEN '.PNG' ELSE '.' || ext END AS path,
   CASE WHEN doc_id % 4 > 0 THEN modified_ms - doc_id % 11 * 3600000 END AS created_ms,
   CASE ext WHEN 'jpg' THEN 'photo' WHEN 'png' THEN 'photo' WHEN 'mp4' THEN 'video' WHEN 'gif' THEN 'gif' WHEN 'pdf' THEN 'document' WHEN 'mp3' THEN 'audio' ELSE 'other' END AS kind FROM base)"""


def of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the address without scheme, query and fragment is the path."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return described(table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.octet_length("html").cast("long").alias("size")))


#: Folders that a task lists, and rows of a batch.
FOLDERS, ROWS = 256, 10_000


def entries(root: str, folder: str, device: int) -> Iterator[tuple]:
    """Files, folders and links directly in ``folder`` below ``root``. Links are listed and never followed, other file systems are left out."""
    try:
        found = os.scandir(os.path.join(root, folder))
    except OSError:
        return
    with found:
        for e in found:
            if e.name.startswith("."):
                continue
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                s = e.stat(follow_symlinks=False)
                link = os.readlink(e.path) if stat.S_ISLNK(s.st_mode) else None
            except OSError:  # it has gone meanwhile
                continue
            known = None, s.st_dev, s.st_ino, s.st_nlink, link
            if link is not None:
                yield path, False, 0, s.st_mtime_ns // 1_000_000, *known
            elif stat.S_ISDIR(s.st_mode) and s.st_dev == device:
                yield path, True, 0, s.st_mtime_ns // 1_000_000, *known
            elif stat.S_ISREG(s.st_mode):
                yield path, False, s.st_size, s.st_mtime_ns // 1_000_000, *known


def tree(spark: SparkSession, root: str) -> DataFrame:
    """The tree below a folder that driver and executors see, level by level: each round lists the folders that the last one found,
    dealt evenly by their paths, and is written before the next; a wide folder's folders are listed by all tasks. A task that is
    lost lists its own folders again. At most MAX_DEPTH levels."""
    names, device = SCAN_SCHEMA.replace(",", "").split()[::2], os.stat(root).st_dev

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = (x for folder in pdf["path"] for x in entries(root, folder, device))
            while rows := list(islice(found, ROWS)):
                yield pd.DataFrame(rows, columns=names)

    folders, rounds = spark.createDataFrame([("",)], "path string"), []
    while len(rounds) < MAX_DEPTH and (n := folders.count()):
        rounds.append(cut(folders.repartition(-(-n // FOLDERS), "path").mapInPandas(listed, SCAN_SCHEMA)))
        folders = rounds[-1].where("is_dir").select("path")
    return reduce(DataFrame.union, rounds)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The tree below a folder without hidden, package, system and junk entries."""
    shown = paths.listable(F.when(F.col("is_dir"), F.concat("path", F.lit("/x"))).otherwise(F.col("path")))
    kind = F.when(F.col("link").isNotNull(), "link").when(F.col("is_dir"), "folder").otherwise(F.col("kind"))
    rows = described(tree(spark, root).where(shown)).withColumn("kind", kind)
    return rows.withColumn("link_outside", F.coalesce(paths.link_escapes("path", F.col("link")), F.lit(False)))


def contents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files with their bytes from any store that Spark reads; select ``content`` only where it is needed."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def one_per_file(files: DataFrame) -> DataFrame:
    """Overlapping roots give a path once, and hard links (same device and inode, more than one link) one of their paths."""
    once = files.dropDuplicates(["path"])
    single, linked = once.where("links <= 1 OR ino IS NULL"), once.where("links > 1 AND ino IS NOT NULL")
    kept = linked.groupBy("dev", "ino").agg(F.min("path").alias("path")).select("path")
    return single.unionByName(linked.join(kept, "path", "left_semi").select(*single.columns))


def outside(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Without the paths at or below one of ``folders`` (path)."""
    above = rows.select("path", F.explode(paths.ancestors("path", itself=True)).alias("folder"))
    hit = above.join(small(folders.select(F.col("path").alias("folder")).distinct()), "folder", "left_semi").select("path").distinct()
    return rows.join(hit, "path", "left_anti")


def collected(roots: list[DataFrame], private: DataFrame) -> DataFrame:
    """The files of several roots to analyse: each path and each file (hard links) once, none in private folders. Paths are absolute."""
    return one_per_file(outside(reduce(DataFrame.unionByName, roots), private))


def snapshot_items(files: DataFrame, private: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rel, size) of readable files outside private folders, and one row of how many were skipped: links, private, unreadable. ``files``: path, size, link, readable."""
    real = files.where("link IS NULL")
    open_ = outside(real, private)
    counts = real.agg(F.count("*").alias("n")).join(open_.agg(F.count("*").alias("open"), F.count_if(~F.col("readable")).alias("unreadable"))).join(files.agg(F.count_if(F.col("link").isNotNull()).alias("links")))
    return open_.where("readable").select(F.col("path").alias("rel"), "size"), counts.select("links", (F.col("n") - F.col("open")).alias("private"), "unreadable")


#: Fixed value: the version of saved catalogs; others are not read.
VERSION = 1


def save(catalog: DataFrame, path: str, root: str) -> None:
    """Write a catalog with its version and root; Spark's committer makes it whole or not at all."""
    catalog.withColumns({"__version": F.lit(VERSION), "__root": F.lit(root)}).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, root: str) -> DataFrame:
    """A saved catalog; no rows if it has another version or root."""
    return spark.read.parquet(path).where((F.col("__version") == VERSION) & (F.col("__root") == root)).drop("__version", "__root")
