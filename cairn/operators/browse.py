"""Browsing: scope, search, filters, order, limits; folders and breadcrumbs; visibility boundaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, values
from ..session import small

LIMIT = 50_000
KINDS = {"photo", "video", "gif", "document", "audio", "other"}


@dataclass
class Query:
    """What to list. ``kind``: a kind, all, screenshot, recording, favorites or tag:<id>."""

    folder: str = ""
    scope: str = "folder"
    kind: str = "all"
    search: str = ""
    sort: str = "name"
    desc: bool = False
    recursive: bool = False
    everywhere: bool = False


def boundaries(files: DataFrame, private: DataFrame) -> DataFrame:
    """Adds boundary: the length of the deepest private folder strictly above the path, 0 if none. An equality join on ancestors."""
    above = files.select("path", F.explode(paths.ancestors("path")).alias("folder")).join(small(private.select("folder").distinct()), "folder")
    deepest = above.groupBy("path").agg(F.max(F.length("folder")).alias("boundary"))
    return files.join(deepest, "path", "left").withColumn("boundary", F.coalesce("boundary", F.lit(0)))


def visible(base: str = "") -> Column:
    return (F.col("boundary") == 0) | (F.col("boundary") <= len(base))


def covered(files: DataFrame, folders: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether the path or an ancestor of it is one of ``folders``."""
    above = files.select("path", F.explode(paths.ancestors("path", itself=True)).alias("folder"))
    found = above.join(small(folders.select("folder").distinct()), "folder", "left_semi").select("path").distinct().withColumn(name, F.lit(True))
    return files.join(found, "path", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def in_scope(q: Query, path: str = "path") -> Column:
    """Everything for the library and for searches everywhere; else what lies below the folder, or directly in it."""
    if q.scope == "library" or (q.search.strip() and q.everywhere):
        return F.lit(True)
    if q.recursive:
        return F.lit(True) if not q.folder else F.startswith(F.col(path), F.lit(q.folder + "/"))
    return paths.parent_of(path) == q.folder


def matches(q: Query, path: str = "path") -> Column:
    """Each word of the search occurs in the path below the scope, whatever its case and accents."""
    wide = q.scope == "library" or (q.search.strip() and q.everywhere)
    rel = F.col(path) if wide or not q.folder else F.substring(F.col(path), F.lit(len(q.folder) + 2), F.length(path))
    out = F.lit(True)
    for word in q.search[:256].split():
        out = out & F.contains(values.folded(rel), F.collate(F.lit(word), "UNICODE_CI_AI"))
    return out


def of_kind(q: Query) -> Column:
    if q.kind in KINDS:
        return F.col("kind") == q.kind
    if q.kind in ("screenshot", "recording"):
        return F.col("capture") == (1 if q.kind == "screenshot" else 2)
    if q.kind == "favorites":
        return F.col("favorite")
    if q.kind.startswith("tag:"):
        return F.array_contains("tags", int(q.kind[4:]))
    return F.lit(True)


def shows_folders(q: Query) -> bool:
    """Folders: never in the library; in a search only without a kind and if it is wide or flat; else unless recursive."""
    if q.scope == "library":
        return False
    if q.search.strip():
        return q.kind not in KINDS and (q.everywhere or not q.recursive)
    return not q.recursive


def order_keys(q: Query) -> list[Column]:
    main = {"modified": F.col("modified_ms"), "created": F.coalesce("created_ms", "modified_ms"), "size": F.col("size"), "type": F.col("ext")}.get(q.sort)
    keys = [*([main] if main is not None else []), values.natural_key("name"), F.col("path")]
    return [k.desc() if q.desc else k.asc() for k in keys]


def browse(catalog: DataFrame, q: Query, limit: int | None = LIMIT) -> DataFrame:
    """The rows to list, folders first, at most ``limit`` (None: all), ordered. Without is_dir and boundary columns all are visible files."""
    rows = catalog.where(in_scope(q) & matches(q))
    if "boundary" in rows.columns:
        rows = rows.where(visible(q.folder if q.scope != "library" else ""))
    if "is_dir" not in rows.columns:
        return _first(rows.where(of_kind(q)).orderBy(*order_keys(q)), limit)
    files = ~F.col("is_dir") & of_kind(q)
    tagged = of_kind(q) if q.kind == "favorites" or q.kind.startswith("tag:") else F.lit(True)
    rows = rows.where(files | (F.col("is_dir") & tagged & F.lit(shows_folders(q))))
    return _first(rows.orderBy(F.col("is_dir").desc(), *order_keys(q)), limit)


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def page_summary(rows: DataFrame, limit: int) -> DataFrame:
    """total before the limit, and whether it cut anything."""
    return rows.agg(F.count("*").alias("total")).select("total", (F.col("total") > limit).alias("truncated"))


def page(rows: DataFrame, keys: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*keys).offset(offset).limit(min(limit, 500))


def folders_of(files: DataFrame) -> DataFrame:
    """All folders above files, as path, name, parent."""
    f = files.select(F.explode(paths.ancestors("path")).alias("path")).distinct()
    return f.select("path", paths.name_of("path").alias("name"), paths.parent_of("path").alias("parent"))


def subfolders(folders: DataFrame, base: str) -> DataFrame:
    return folders.where(F.col("parent") == base).orderBy(values.natural_key("name"), "path")


def breadcrumbs(rows: DataFrame) -> DataFrame:
    """(path, depth, crumb) from the top ancestor to the path itself."""
    return rows.select("path", F.posexplode(paths.ancestors("path", itself=True)).alias("depth", "crumb"))


def stats(catalog: DataFrame) -> DataFrame:
    """Counts by kind and capture, favourites and bytes over visible rows, in one aggregate."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in sorted(KINDS)]
    favorite = F.count_if(F.col("favorite")) if "favorite" in catalog.columns else F.lit(0).cast("long")
    return catalog.agg(*kinds, F.count_if(F.col("capture") == 1).alias("screenshots"), F.count_if(F.col("capture") == 2).alias("recordings"), favorite.alias("favorites"), F.sum("size").alias("bytes"))


def drive_totals(files: DataFrame, folders: DataFrame, favorites: DataFrame, private: DataFrame) -> DataFrame:
    """One row of what can be seen from the top: files, folders, links, each kind, captures, favourites among files and folders, bytes.
    ``favorites`` and ``private``: path; what is in private folders does not count, the folders themselves do."""
    shown = lambda rows: boundaries(rows, private.select(F.col("path").alias("folder"))).where("boundary = 0")
    seen, dirs = shown(files).select("path", "kind", "capture", "size"), shown(folders).select("path")
    loved = seen.select("path").union(dirs).join(small(favorites.select("path").distinct()), "path", "left_semi")
    row = lambda rows, what: rows.withColumn("what", F.lit(what))
    every = row(seen, "file").unionByName(row(dirs, "folder"), allowMissingColumns=True).unionByName(row(loved, "favorite"), allowMissingColumns=True)
    count = lambda on, name: F.count_if(on).alias(name)
    kinds = [count(F.col("kind") == k, f"{k}s") for k in sorted(KINDS | {"link"})]
    what = [count(F.col("what") == w, f"{w}s") for w in ("file", "folder", "favorite")]
    return every.agg(*what, *kinds, count(F.col("capture") == 1, "screenshots"), count(F.col("capture") == 2, "recordings"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
