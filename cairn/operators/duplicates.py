"""Exact copies: sizes first, hashes only for repeated sizes; still and motion pairs; the copy to keep; plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..session import cut, small, spread_join
from ..sources import ranges

#: Folder names that count against or for a copy, and their weights.
TEMPORARY = ["downloads", "download", "tmp", "temp", "cache", "caches", "trash", "recycle bin", "$recycle.bin"]
OLD = ["backup", "backups", "old", "copies", "duplicates"]
MEDIA = ["pictures", "photos", "videos", "movies", "dcim", "music", "documents"]
COPY_NAME = r" copy|copy of|-copy|\([1-9]\)"
WEIGHTS = {"temporary": 100, "old": 20, "copy": 30, "media": -10}
PART = 65_536
#: Repeated sizes up to which they are broadcast: 8 bytes each.
SIZES = 1_000_000


def repeated_sizes(files: DataFrame) -> DataFrame:
    """Non-empty files whose size another file has too."""
    sizes = files.where("size > 0").groupBy("size").count().where("count > 1").select("size")
    return files.where("size > 0").join(sizes, "size", "left_semi")


def partial_hash(content: Column | str) -> Column:
    """Of 64 KiB at the beginning, around the middle and at the end; of all bytes of shorter files."""
    c = F.col(content) if isinstance(content, str) else content
    n = F.octet_length(c)
    sub = lambda at: F.substring(c, F.greatest(F.lit(1), at), F.lit(PART))
    return F.sha2(F.when(n <= 3 * PART, c).otherwise(F.concat(sub(F.lit(1)), sub((n / 2 - PART / 2).cast("int") + 1), sub(n - PART + 1))), 256)


def hashed(files: DataFrame, content: str) -> DataFrame:
    """Only files that can have a copy are hashed: by size, then by parts, then whole.

    Sizes are few and broadcast, and both hashes are taken before rows are shuffled, so that contents which are not asked for
    stay where they are read; a file of up to three parts is hashed once, as its parts are the whole."""
    whole = files.where("size > 0")
    sizes = small(cut(whole.groupBy("size").count().where("count > 1").select("size")), SIZES)
    bytes_ = F.col(content).cast("binary")
    first = whole.join(sizes, "size", "left_semi").withColumn("part", partial_hash(bytes_))
    first = first.withColumn("hash", F.when(F.octet_length(bytes_) <= 3 * PART, F.col("part")).otherwise(F.sha2(bytes_, 256)))
    parts = first.groupBy("size", "part").count().where("count > 1").select("size", "part")
    return first.join(parts, ["size", "part"], "left_semi").drop("part")


def hashed_on_disk(files: DataFrame, root: str) -> DataFrame:
    """``hashed`` for files below ``root`` (path, size), with part_bytes: those of a repeated size are read in three windows, those of
    equal windows whole; files of up to three windows are read once. Files that cannot be read are left out."""
    first = cut(ranges.windows(repeated_sizes(files), root).withColumnRenamed("bytes_read", "part_bytes").where("part IS NOT NULL"))
    parts = first.groupBy("size", "part").count().where("count > 1").select("size", "part")
    again = first.join(parts, ["size", "part"], "left_semi")
    short = F.col("size") <= 3 * PART
    whole = ranges.whole_hash(again.where(~short).drop("part"), root)
    return whole.where("hash IS NOT NULL").unionByName(again.where(short).withColumnRenamed("part", "hash"))


def groups(files: DataFrame) -> DataFrame:
    """(size, hash, members, recoverable) of copies; ``files`` has size and hash."""
    g = files.groupBy("size", "hash").agg(F.count("*").alias("members")).where("members > 1")
    return g.withColumn("recoverable", F.col("size") * (F.col("members") - 1))


#: The kinds of files that an analysis option takes.
ANALYSED = {"images": ["photo", "gif"], "videos": ["video"], "documents": ["document"], "audio": ["audio"], "other": ["other"]}


def of_options(files: DataFrame, options: list[str], pairs: DataFrame) -> DataFrame:
    """Files of the kinds that options name (none: all), and the other half of a still and motion pair of which one is taken."""
    if not options:
        return files
    wanted = [k for o in options for k in ANALYSED.get(o, [])]
    taken = files.where(F.col("kind").isin(wanted))
    both = pairs.select(F.col("still").alias("path"), F.col("motion").alias("other")).union(pairs.select(F.col("motion").alias("path"), F.col("still").alias("other")))
    partners = both.join(taken.select("path"), "path", "left_semi").select(F.col("other").alias("path"))
    return taken.union(files.where(~F.col("kind").isin(wanted)).join(partners, "path", "left_semi").select(*taken.columns))


def recoverable(units: DataFrame) -> DataFrame:
    """(unit, members, recoverable) of units (unit, size, locked: a row for each copy): all copies but the locked ones, or but one."""
    by = units.groupBy("unit").agg(F.count("*").alias("members"), F.max("size").alias("size"), F.count_if("locked").alias("_locked"))
    return by.select("unit", "members", (F.col("size") * (F.col("members") - F.greatest("_locked", F.lit(1)))).alias("recoverable"))


def members(files: DataFrame) -> DataFrame:
    return files.join(groups(files).select("size", "hash"), ["size", "hash"], "left_semi")


def traits() -> dict[str, Column]:
    segments = F.split(F.lower("path"), "/")
    has = lambda words: F.arrays_overlap(segments, F.array(*map(F.lit, words)))
    return {"temporary": has(TEMPORARY), "old": has(OLD), "copy": F.lower("name").rlike(COPY_NAME), "media": has(MEDIA)}


def keep_score() -> Column:
    return reduce(lambda a, b: a + b, [F.when(on, WEIGHTS[k]).otherwise(0) for k, on in traits().items()])


def with_keeper(files: DataFrame, by: list[str]) -> DataFrame:
    """Adds keep: locked members first, then the lowest score, the oldest, the shortest path, the path (which is unique). The least of
    each group is found before rows meet, so a hot group's members never come together."""
    locked = F.col("locked") if "locked" in files.columns else F.lit(False)
    place = F.struct((~locked).alias("open"), keep_score().alias("score"), F.coalesce("created_ms", "modified_ms").alias("at"), F.octet_length("path").alias("length"), F.col("path").alias("path"))
    rows = cut(files.withColumn("__place", place))
    first = rows.groupBy(*by).agg(F.min("__place").alias("__first"))
    return spread_join(rows, first, by).withColumn("keep", F.col("__place") == F.col("__first")).select(*files.columns, "keep")


def reasons(kept: DataFrame, by: list[str]) -> DataFrame:
    """Why each group's keeper was chosen, as an array of codes; needs with_keeper's column."""
    t = {k: F.col(f"_{k}") for k in traits()}
    rows = kept.withColumns({f"_{k}": v for k, v in traits().items()}).withColumn("_date", F.coalesce("created_ms", "modified_ms"))
    own = lambda c: F.max(F.when(F.col("keep"), c))
    other = lambda c: F.max(F.when(~F.col("keep"), c))
    no = F.lit(False)
    rule = {
        "others-temporary": ~own(t["temporary"]) & F.coalesce(other(t["temporary"]), no), "others-old": ~own(t["old"]) & F.coalesce(other(t["old"]), no),
        "others-copy-named": ~own(t["copy"]) & F.coalesce(other(t["copy"]), no), "in-media-folder": own(t["media"]) & F.coalesce(other(~t["media"]), no),
        "oldest": F.max(F.when(F.col("keep"), F.col("_date"))) < F.min(F.when(~F.col("keep"), F.col("_date"))),
    }
    codes = F.array_compact(F.array(*[F.when(on, F.lit(k)) for k, on in rule.items()]))
    return rows.groupBy(*by).agg(codes.alias("reasons")).withColumn("reasons", F.when(F.size("reasons") == 0, F.array(F.lit("shortest-path"))).otherwise(F.col("reasons")))


def live_pairs(files: DataFrame, still: list[str], motion: list[str]) -> DataFrame:
    """(parent, stem, still, motion): stems with exactly one still and one motion file beside each other."""
    stem = F.lower(paths.stem_of("name"))
    is_still, is_motion = F.col("ext").isin(still), F.col("ext").isin(motion)
    g = files.where(is_still | is_motion).groupBy("parent", stem.alias("stem")).agg(F.count_if(is_still).alias("s"), F.count_if(is_motion).alias("m"), F.max(F.when(is_still, F.col("path"))).alias("still"), F.max(F.when(is_motion, F.col("path"))).alias("motion"))
    return g.where("s = 1 AND m = 1").select("parent", "stem", "still", "motion")


def live_groups(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(unit, path, locked): pairs equal in both hashes are one unit's copies; a lone copy of a half of a pair is locked."""
    h = files.select("path", "size", "hash")
    s, m = (h.select(F.col("path").alias(x), F.col("hash").alias(f"{x}_hash")) for x in ("still", "motion"))
    both = pairs.join(s, "still").join(m, "motion").withColumn("unit", F.sha2(F.concat_ws("/", "still_hash", "motion_hash"), 256))
    units = both.groupBy("unit").count().where("count > 1").select("unit")
    whole = both.join(units, "unit", "left_semi")
    in_unit = whole.select("unit", F.explode(F.array("still", "motion")).alias("path"))
    halves = both.select(F.explode(F.array("still", "motion")).alias("path"))
    single = h.join(in_unit, "path", "left_anti")
    single = members(single).select(F.col("hash").alias("unit"), "path").join(halves.withColumn("locked", F.lit(True)), "path", "left").select("unit", "path", F.coalesce("locked", F.lit(False)).alias("locked"))
    return in_unit.withColumn("locked", F.lit(False)).unionByName(single)


def plan_violations(plan: DataFrame, all_members: DataFrame) -> DataFrame:
    """(unit, problem) of a plan (unit, path): repeated, no member, locked, or every copy of a unit."""
    repeated = plan.groupBy("unit", "path").count().where("count > 1").select("unit", F.lit("repeated").alias("problem"))
    joined = plan.distinct().join(all_members, ["unit", "path"], "left")
    stray = joined.where("locked IS NULL").select("unit", F.lit("no-member").alias("problem"))
    locked = joined.where("locked").select("unit", F.lit("locked").alias("problem"))
    sizes = all_members.groupBy("unit").agg(F.count("*").alias("n"))
    everything = joined.where("locked IS NOT NULL").groupBy("unit").agg(F.count("*").alias("m")).join(sizes, "unit").where("m >= n").select("unit", F.lit("all-copies").alias("problem"))
    return reduce(DataFrame.union, [repeated, stray, locked, everything]).distinct()


def forget(files: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    """Without the paths in ``gone``, and without groups of which less than two members are left."""
    left = files.join(gone.select("path"), "path", "left_anti")
    return left.join(left.groupBy(*by).count().where("count > 1").select(*by), by, "left_semi")
