"""Dry runs: what an operation on a selection would do. Nothing here changes files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import paths, values
from ..session import cut, spread_join


def roll_up(files: DataFrame, selection: DataFrame) -> DataFrame:
    """(item, files, bytes) of each selected item: itself if a file, else all below it. One equality join on ancestors."""
    spread = files.select("size", F.explode(paths.ancestors("path", itself=True)).alias("item"))
    got = spread.groupBy("item").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return selection.select("item").join(got, "item", "left").select("item", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def totals(rolled: DataFrame, folders: int, trash: bool = False) -> DataFrame:
    """One row: entries, files, bytes, and whether the user must type to confirm."""
    t = rolled.agg(F.count("*").alias("entries"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    typed = (F.col("entries") > 25) | (F.col("files") > 100) | (F.col("bytes") > 1 << 30) | F.lit(folders > 0)
    return t.withColumn("typed", typed & F.lit(not trash))


def _with_first(rows: DataFrame, name: F.Column, free: F.Column) -> DataFrame:
    """Adds _first: the least seq of the free rows of a name. It is found before rows meet, so a hot name's rows never come together."""
    named = cut(rows.withColumns({"_fold": name, "_free": free}))
    first = named.where("_free").groupBy("_fold").agg(F.min("seq").alias("_first"))
    return spread_join(named, first, ["_fold"], "left").drop("_fold", "_free")


def transfer(batch: DataFrame, target: DataFrame, fold=values.folded) -> DataFrame:
    """Adds conflict to (seq, name): exists (a file of the target has the name), batch (an earlier one of the batch has it, case
    and accents aside), or null."""
    there = target.select(F.lower("name").alias("_low")).distinct().withColumn("_there", F.lit(True))
    rows = _with_first(batch.withColumn("_low", F.lower("name")).join(there, "_low", "left"), fold("name"), F.lit(True))
    return rows.withColumn("conflict", F.when(F.col("_there"), "exists").when(F.col("seq") > F.col("_first"), "batch")).drop("_first", "_low", "_there")


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, name) of the first free name for each wanted one: itself, or with the smallest number from 2 on that is free.

    The numbers in use of a stem and extension rise by one from 2 on up to the first gap, however many there are."""
    dot = F.regexp_extract("name", r"^.+(\.[^.]*)$", 1)
    bare = paths.stem_of("name")
    number = F.regexp_extract(bare, r"^.+ ([1-9][0-9]{0,17})$", 1)
    used = taken.select(F.regexp_extract(bare, r"^(.+) [1-9][0-9]{0,17}$", 1).alias("stem"), dot.alias("dot"), number.try_cast("long").alias("k")).where("k >= 2").distinct()
    in_turn = used.withColumn("r", F.row_number().over(Window.partitionBy("stem", "dot").orderBy("k")) + 1)
    gap = in_turn.where("k = r").groupBy("stem", "dot").agg((F.max("k") + 1).alias("free"))
    stem = F.regexp_replace(bare, r"^(.+) (0*[2-9]|0*[1-9]\d+)$", "$1")
    rows = wanted.select("id", "name", stem.alias("stem"), dot.alias("dot")).join(gap, ["stem", "dot"], "left").join(taken.select("name").distinct().withColumn("_taken", F.lit(True)), "name", "left")
    return rows.select("id", F.when(F.col("_taken"), F.concat("stem", F.lit(" "), F.coalesce("free", F.lit(2)).cast("string"), "dot")).otherwise(F.col("name")).alias("name"))


def drop_refusal(moved: str = "moved", target: str = "target") -> F.Column:
    """Why a drop is refused: same (onto itself), inside (into its own subtree), parent (it is there already), or null."""
    return F.when(F.col(moved) == F.col(target), "same").when(paths.is_within(target, F.col(moved)), "inside").when(paths.parent_of(moved) == F.col(target), "parent")


def inventory(files: DataFrame, category: dict[str, str]) -> DataFrame:
    """(category, files, bytes) of local data by the folder that the path begins with."""
    top = F.substring_index("path", "/", 1)
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in category.items() for x in p]), top), F.lit("other"))
    return files.groupBy(named.alias("category")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def neighbour(listing: DataFrame, removed: DataFrame, pos: int) -> DataFrame:
    """The item to select after a removal at ``pos``: the next that is left, else the last before it. ``listing``: pos, path."""
    left = listing.join(removed.select("path"), "path", "left_anti")
    return left.agg(F.coalesce(F.min(F.when(F.col("pos") >= pos, F.col("pos"))), F.max(F.when(F.col("pos") < pos, F.col("pos")))).alias("pos"))


def drop_check(items: DataFrame, target: dict, read_only: bool = False) -> DataFrame:
    """One row: why items (pos, id, path, kind, guarded) must not be dropped on a target (id, path, kind, guarded), or null.

    In this order: nothing, not-a-folder, read-only, target-protected; then the first item's: itself, inside, item-protected; then already-here."""
    t = {k: F.lit(target.get(k)) for k in ("id", "path", "kind", "guarded")}
    inside = (F.col("kind") == "folder") & paths.is_within(t["path"], F.col("path"))
    own = F.when(F.col("id") == t["id"], "itself").when(inside, "inside").when(F.col("guarded"), "item-protected")
    rows = items.select("pos", own.alias("own"), (paths.parent_of("path") == t["path"]).alias("here"))
    found = rows.agg(F.count("*").alias("n"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("pos"))).alias("own"), F.every("here").alias("here"))
    why = (
        F.when(F.col("n") == 0, "nothing").when(F.coalesce(t["kind"], F.lit("folder")) != "folder", "not-a-folder").when(F.lit(read_only), "read-only").when(F.coalesce(t["guarded"].cast("boolean"), F.lit(False)), "target-protected")
        .when(F.col("own").isNotNull(), F.col("own")).when(F.col("here"), "already-here")
    )
    return found.select(why.alias("refusal"))


def transfer_plan(batch: DataFrame, files: DataFrame, there: DataFrame, dest: str, volume: str, protected: DataFrame, moving: bool, read_only: bool = False) -> DataFrame:
    """A dry run of a move or copy of ``batch`` (seq, path, kind: file, folder or link; volume) to the folder ``dest`` of ``volume``.

    (seq, path, bytes, files, blocked, conflict, replaceable, crosses): blocked: already-here, into-itself, read-only, protected,
    contains-protected; else conflict: file, folder or link that stands there (``there``: name, kind), or batch:
    an earlier item that stays has the name, case and accents aside. ``files`` (path, size) gives what folders hold.
    """
    from .organize import refusal

    rows = batch.dropDuplicates(["path"]).withColumn("name", paths.name_of("path"))
    held = roll_up(files, rows.where("kind <> 'link'").select(F.col("path").alias("item"))).withColumnRenamed("item", "path")
    rows = rows.join(held, "path", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files", "bytes")})
    rows = refusal(rows, protected, read_only).withColumnRenamed("refusal", "_own")
    to = F.concat_ws("/", F.nullif(F.lit(dest), F.lit("")), "name")
    target = refusal(rows.select("seq", to.alias("path")), protected, read_only).select("seq", F.when(F.col("refusal").isin("read-only", "protected"), F.col("refusal")).alias("_target"))
    here = paths.parent_of("path") == dest
    blocked = F.when(here, "already-here") if moving else F.when(F.lit(False), "")
    blocked = blocked.when(paths.is_within(F.lit(dest), F.col("path")), "into-itself")
    blocked = (blocked.when(F.col("_own").isNotNull(), F.col("_own")) if moving else blocked).otherwise(F.col("_target"))
    rows = rows.join(target, "seq").withColumn("blocked", blocked)
    stands = there.select(F.col("name"), F.col("kind").alias("_kind"))
    rows = rows.join(stands, "name", "left")
    free = F.col("blocked").isNull() & F.col("_kind").isNull()
    rows = _with_first(rows, values.folded("name"), free)
    rows = rows.withColumn("conflict", F.when(F.col("blocked").isNull(), F.coalesce("_kind", F.when(F.col("seq") > F.col("_first"), "batch"))))
    replaceable = F.coalesce(F.col("blocked").isNull() & ~here & (F.col("kind") == "file") & (F.col("_kind") == "file") & F.col("_target").isNull(), F.lit(False))
    crosses = F.coalesce(F.lit(moving) & F.col("blocked").isNull() & (F.col("volume") != volume), F.lit(False))
    rows = rows.withColumn("replaceable", replaceable).withColumn("crosses", crosses)
    return rows.select("seq", "path", "bytes", "files", "blocked", "conflict", "replaceable", "crosses")


def transfer_totals(plan: DataFrame) -> DataFrame:
    """One row: bytes and files of what is not blocked, the numbers of blocked items and conflicts, and whether the move crosses volumes."""
    ok = F.col("blocked").isNull()
    return plan.agg(F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(ok, F.col("files"))), F.lit(0)).alias("files"), F.count_if(~ok).alias("blocked"), F.count_if(F.col("conflict").isNotNull()).alias("conflicts"), F.coalesce(F.bool_or("crosses"), F.lit(False)).alias("crosses"))


def executable(plan: DataFrame, members: DataFrame, now: DataFrame) -> DataFrame:
    """(unit, path, outcome) of a cleanup plan (unit, path) just before it runs: trash, changed, or skipped if a copy to keep changed.

    ``members``: unit, path, size, hash as analysed; ``now``: path, size, hash of what is there."""
    fresh = now.select("path", F.col("size").alias("_s"), F.col("hash").alias("_h"))
    rows = members.join(fresh, "path", "left").withColumn("same", F.coalesce((F.col("_s") == F.col("size")) & (F.col("_h") == F.col("hash")), F.lit(False)))
    rows = rows.join(plan.select("unit", "path").distinct().withColumn("_go", F.lit(True)), ["unit", "path"], "left")
    broken = rows.where("_go IS NULL AND NOT same").select("unit").distinct().withColumn("_skip", F.lit(True))
    go = rows.where("_go").join(broken, "unit", "left")
    return go.select("unit", "path", F.when(F.col("_skip"), "skipped").when(~F.col("same"), "changed").otherwise("trash").alias("outcome"))

