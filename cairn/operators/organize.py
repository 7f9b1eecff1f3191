"""Tags, favourites, private and protected folders, history: small tables beside a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths, values
from ..session import numbered, small

KEEP = 200


def with_tags(files: DataFrame, assignments: DataFrame) -> DataFrame:
    """Adds tags, sorted; files without one have an empty array. ``assignments``: path, tag."""
    tags = assignments.groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return files.join(tags, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<int>")))


def with_favorites(files: DataFrame, favorites: DataFrame) -> DataFrame:
    return files.join(small(favorites.select("path").distinct()).withColumn("favorite", F.lit(True)), "path", "left").withColumn("favorite", F.coalesce("favorite", F.lit(False)))


def with_capture(files: DataFrame, yes: DataFrame, no: DataFrame) -> DataFrame:
    """Corrections of the capture class by hand: ``no`` beats ``yes``, both beat the name. ``yes``: path, capture; ``no``: path."""
    y = small(yes.select("path", F.col("capture").alias("_yes")))
    n = small(no.select("path").withColumn("_no", F.lit(True)))
    fixed = F.when(F.col("_no"), 0).otherwise(F.coalesce("_yes", "capture"))
    return files.join(y, "path", "left").join(n, "path", "left").withColumn("capture", fixed).drop("_yes", "_no")


def tag_counts(tags: DataFrame, tagged: DataFrame) -> DataFrame:
    """(id, name, items) of every tag, unused ones too. ``tagged`` has tags."""
    used = tagged.select(F.explode("tags").alias("id")).groupBy("id").agg(F.count("*").alias("items"))
    return tags.join(used, "id", "left").select("id", "name", F.coalesce("items", F.lit(0)).alias("items"))


def rename_tag(tags: DataFrame, tag_id: int, name: str) -> DataFrame:
    """With the new name, unless another tag has it already, case aside."""
    taken = tags.where((F.lower("name") == name.strip().lower()) & (F.col("id") != tag_id)).limit(1).count() > 0
    return tags if taken else tags.withColumn("name", F.when(F.col("id") == tag_id, name.strip()).otherwise(F.col("name")))


def delete_tag(assignments: DataFrame, tag_id: int) -> DataFrame:
    return assignments.where(F.col("tag") != tag_id)


def follow_rename(rows: DataFrame, old: str, new: str, path: str = "path") -> DataFrame:
    """Paths at or below ``old`` move to ``new``."""
    moved = F.concat(F.lit(new), F.substring(F.col(path), F.lit(len(old) + 1), F.length(path)))
    return rows.withColumn(path, F.when(paths.is_within(path, F.lit(old)), moved).otherwise(F.col(path)))


def remove(rows: DataFrame, gone: str, path: str = "path") -> DataFrame:
    return rows.where(~paths.is_within(path, F.lit(gone)))


def follow_private(private: DataFrame, folders: DataFrame) -> DataFrame:
    """Private folders (path, ino) that are gone, with the path that now has their inode."""
    gone = private.join(folders.select("path"), "path", "left_anti")
    return gone.join(folders.select(F.col("path").alias("now"), "ino"), "ino").select("path", "now")


def refusal(files: DataFrame, protected: DataFrame, read_only: bool = False) -> DataFrame:
    """Adds refusal: why an item must not be changed: read-only, protected (it or an ancestor), contains-protected."""
    from .browse import covered

    holds = protected.select(F.explode(paths.ancestors("folder")).alias("path")).distinct().withColumn("_holds", F.lit(True))
    rows = covered(files, protected, "_covered").join(small(holds), "path", "left")
    why = F.when(F.lit(read_only), "read-only").when(F.col("_covered"), "protected").when(F.col("_holds"), "contains-protected")
    return rows.withColumn("refusal", why).drop("_covered", "_holds")


def hide_below(rows: DataFrame, folder: str, root: str = "") -> DataFrame:
    """Results without those below a newly private folder, unless the root is it or lies inside it."""
    return rows if root and (root == folder or root.startswith(folder + "/")) else rows.where(~F.startswith(F.col("path"), F.lit(folder + "/")))


def forget_volume(rows: DataFrame, volume: str | None) -> DataFrame:
    return rows.where(~F.col("volume").eqNullSafe(F.lit(volume)))


def to_volume(path: Column | str, root: str) -> Column:
    """A root-relative path as a volume-relative one."""
    p = F.col(path) if isinstance(path, str) else path
    return p if not root else F.concat_ws("/", F.lit(root), F.nullif(p, F.lit("")))


def last_undoable(log: DataFrame, by: str) -> DataFrame:
    """The latest record of each ``by`` that is not undone."""
    return log.where("NOT undone").groupBy(by).agg(F.max_by("id", F.struct("at", "id")).alias("id"))


def trimmed(log: DataFrame, by: str, keep: int = KEEP) -> DataFrame:
    """The latest ``keep`` records of each ``by``."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("at"), F.desc("id")))).where(F.col("_n") <= keep).drop("_n")


def latest_decisions(events: DataFrame, item: str, at: list[str]) -> DataFrame:
    """Each item's last decision (item, decision); later ones replace earlier ones."""
    last = F.max_by("decision", F.struct(*at)) if len(at) > 1 else F.max_by("decision", at[0])
    return events.groupBy(item).agg(last.alias("decision"))


def decision_counts(items: DataFrame, decisions: DataFrame, item: str) -> DataFrame:
    """One row: kept, marked, undecided, marked_bytes; decisions about other items do not count."""
    d = items.join(decisions, item, "left")
    marked = F.col("decision") == "mark"
    return d.agg(F.count_if(F.col("decision") == "keep").alias("kept"), F.count_if(marked).alias("marked"), F.count_if(F.col("decision").isNull()).alias("undecided"), F.coalesce(F.sum(F.when(marked, F.col("size"))), F.lit(0)).alias("marked_bytes"))


def set_favorite(favorites: DataFrame, path: str, on: bool) -> DataFrame:
    """(path) with or without one path."""
    left = favorites.select("path").where(F.col("path") != path)
    return left.union(favorites.sparkSession.sql("SELECT :path AS path", {"path": path})) if on else left


def listed_tags(tags: DataFrame) -> DataFrame:
    """Tags (id, name) with rank, by name, case aside."""
    return numbered(tags.select("id", "name"), [F.lower("name"), F.col("name"), F.col("id")])


MAX_TAGS = 500


def ensure_tag(tags: DataFrame, name: str) -> DataFrame:
    """Tags (id, name) with ``name`` among them, case aside, under the next id; unchanged if the name is not fit or there are MAX_TAGS."""
    made = tags.sparkSession.sql("SELECT :name AS name", {"name": name}).select(values.clean_tag("name").alias("name")).where("name IS NOT NULL")
    known = made.join(tags.select(F.lower("name").alias("_low")), F.lower("name") == F.col("_low"), "left_anti")
    next_id = tags.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast(tags.schema["id"].dataType).alias("id"), F.count("*").alias("_n"))
    return tags.select("id", "name").union(known.join(F.broadcast(next_id)).where(F.col("_n") < MAX_TAGS).select("id", "name"))


def assign_tag(assignments: DataFrame, chosen: DataFrame, tag: int, on: bool = True) -> DataFrame:
    """Assignments (path, tag) with the tag on (or off) the chosen paths."""
    hit = chosen.select("path").distinct().withColumn("tag", F.lit(tag).cast(assignments.schema["tag"].dataType))
    return assignments.select("path", "tag").union(hit).distinct() if on else assignments.select("path", "tag").join(hit, ["path", "tag"], "left_anti")


def from_volume(path: Column | str, root: str) -> Column:
    """A volume-relative path as a root-relative one; null outside the root."""
    p = F.col(path) if isinstance(path, str) else path
    return p if not root else F.when(p == root, "").when(F.startswith(p, F.lit(root + "/")), F.substring(p, F.lit(len(root) + 2), F.length(p)))


def renamed(catalog: DataFrame, old: str, new: str) -> DataFrame:
    """A catalog after a rename: what lies at or below ``old`` moves, and what follows from a path is told anew."""
    from ..sources.catalog import described

    moved = follow_rename(catalog, old, new)
    named = described(moved)
    if "is_dir" not in catalog.columns:
        return named
    return named.withColumns({"kind": F.when(F.col("is_dir"), "folder").otherwise(F.col("kind")), "ext": F.when(F.col("is_dir"), "").otherwise(F.col("ext"))})


def added(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """A catalog with new rows; those of a path that it has replace it."""
    return catalog.join(rows.select("path").distinct(), "path", "left_anti").select(*catalog.columns).unionByName(rows, allowMissingColumns=True)


def why_not(changes: Column | str = "changes") -> Column:
    """Why a record's changes (array of kind, trashed) cannot be undone: deleted, by-hand (nobody told where a trashed original lies), or null."""
    c = F.col(changes) if isinstance(changes, str) else changes
    lost = F.exists(c, lambda x: x["kind"].isin("trashed", "cross-moved") & x["trashed"].isNull())
    return F.when(F.exists(c, lambda x: x["kind"] == "deleted"), "deleted").when(lost, "by-hand")


def history(log: DataFrame) -> DataFrame:
    """Adds note and undoable to records (id, at, changes, undone); those without a change are none."""
    return log.where(F.size("changes") > 0).withColumn("note", why_not()).withColumn("undoable", ~F.col("undone") & F.col("note").isNull())


#: File systems that write in place, that copy on write, and that lie on a network.
IN_PLACE = ["hfs", "msdos", "exfat", "ntfs", "ext4", "ext3", "ext2", "fat32", "vfat"]
COPY_ON_WRITE = ["apfs", "zfs", "btrfs"]
NETWORK = ["nfs", "smbfs", "afpfs", "webdav", "cifs"]


def overwrite_refusal(fs_type: Column | str = "fs_type", medium: Column | str = "medium") -> Column:
    """Why overwriting would not reach a file's old bytes: copy-on-write, network, unknown-system, solid-state, unknown-medium, or null (a rotational disk)."""
    f, m = (F.col(x) if isinstance(x, str) else x for x in (fs_type, medium))
    return (
        F.when(f.isin(COPY_ON_WRITE), "copy-on-write").when(f.isin(NETWORK), "network").when(f.isNull() | ~f.isin(IN_PLACE), "unknown-system")
        .when(m == "solid-state", "solid-state").when(m.isNull() | (m != "rotational"), "unknown-medium")
    )
