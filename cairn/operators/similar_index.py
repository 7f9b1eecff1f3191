"""Similarity kept up to date: saved fingerprints, lookups, edges and components, into which only new versions are merged.

A version is what a key (path, size, time, mode) names. Only versions that are not saved are fingerprinted; only their new hashes
probe, the saved lookups and one another, or at a wide radius are compared with the saved hashes and one another; new edges join saved components, named by their roots, so that a graph of what has
changed is all that is contracted. Where hashes have gone, the components they were in are found anew from their own saved edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import values
from ..session import cut, spread_join
from .similar import bands, compared, compared_pays, components, lookups

#: A state is to grow: whether its hashes are looked up or compared outright is decided for as many.
GROWN = 1_000_000
PRINTS, LOOKUPS, EDGES, LABELS = "key string, h long", "g long, band int, part long, other long", "h long, g long", "h long, root long"


def _read(spark: SparkSession, path: str, name: str, generation: int, schema: str) -> DataFrame:
    """The rows of a table that generations up to this one have added."""
    if generation < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, generation int").parquet(f"{path}/{name}").where(F.col("generation") <= generation).drop("generation")


def _write(rows: DataFrame, path: str, name: str, generation: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/generation={generation}")


def _probe(fresh: DataFrame, saved: DataFrame, found: list[tuple[int, int, int]], radius: int) -> DataFrame:
    """(h, g), each pair once, of new hashes ``fresh`` (h) near saved ones and near one another; ``saved``: lookups with new (whether g is)."""
    a = lookups(fresh, found, "h", True)
    low = F.col("other").bitwiseAND(-F.col("other"))
    own = (F.col("mask").bitwiseAND(F.col("other")) == 0) & (F.bit_count("mask") - F.bit_count("other")).isin(0, 1) & ((F.col("other") == 0) | (F.col("mask") < low))
    for i, (shift, width, most) in enumerate(found):
        part = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.col("g")), shift).bitwiseAND((1 << width) - 1)
        own = own & ((F.col("band") <= i) | (F.bit_count(part) > most))
    return a.join(saved, ["band", "part"]).where((~F.col("new") | (F.col("h") < F.col("g"))) & (F.col("h") != F.col("g")) & (values.hamming("h", "g") <= radius) & own).select("h", "g")


def update(spark: SparkSession, path: str, versions: DataFrame, prints: Callable[[DataFrame], DataFrame], radius: int, generation: int) -> dict[str, int]:
    """Bring the state in ``path`` from ``generation`` - 1 to ``generation``: ``versions`` (key, and what ``prints`` needs) is all there is now.

    ``prints`` gives (key, h) of the versions it is asked for; a null h tells nothing and is kept, so that it is not asked for again.
    Returns how many versions were fingerprinted, hashes probed, edges found and hashes gone. Keys that repeat count once. A generation
    that runs again replaces itself. ``labels`` and ``groups`` read the state.
    """
    last = generation - 1
    known = _read(spark, path, "prints", last, PRINTS)
    gone_keys = _read(spark, path, "gone", last, "key string, h long")
    # A key that has gone and comes again is printed again; what was saved of it counts until then.
    live = known.groupBy("key").agg(F.max("h").alias("h"), F.count("*").alias("times")).join(gone_keys.groupBy("key").agg(F.count("*").alias("left")), "key", "left")
    live = cut(live.where("times > coalesce(left, 0)").select("key", "h"))
    now = versions.dropDuplicates(["key"])
    made = cut(prints(now.join(live.select("key"), "key", "left_anti")).select("key", F.col("h").cast("long").alias("h")))
    left = cut(live.join(now.select("key"), "key", "left_anti"))
    _write(made, path, "prints", generation)
    _write(left, path, "gone", generation)

    old = live.where("h IS NOT NULL").select("h").distinct()
    kept = live.join(left.select("key"), "key", "left_anti").select("h").union(made.select("h")).where("h IS NOT NULL").distinct()
    lost = cut(old.join(kept, "h", "left_anti"))
    fresh = cut(made.where("h IS NOT NULL").select("h").distinct().join(old, "h", "left_anti"))
    if generation:
        found = [tuple(r) for r in spark.read.parquet(f"{path}/bands").orderBy("shift").collect()]  # eight at most
    else:
        found = bands(radius, fresh.count()) if not compared_pays(bands(radius, GROWN), GROWN, GROWN / 2) else []
        spark.createDataFrame(found, "shift int, width int, most int").write.mode("overwrite").parquet(f"{path}/bands")
    if found:
        # Lookups of hashes that have gone may stay: they are told by ``live`` hashes alone.
        own = lookups(fresh.withColumnRenamed("h", "g"), found, "g", False).withColumnRenamed("mask", "other").select("g", F.col("band").cast("int").alias("band"), "part", "other")
        _write(own, path, "lookups", generation)
        there = _read(spark, path, "lookups", last, LOOKUPS)
        both = there.withColumn("new", F.lit(False)).union(own.withColumn("new", F.lit(True)))
        near = cut(_probe(fresh, both, found, radius).join(kept.withColumnRenamed("h", "g"), "g", "left_semi").select("h", "g"))
    else:
        keyed = lambda rows: rows.select("h", F.col("h").alias("k"))
        pairs = compared(keyed(fresh), radius).union(compared(keyed(fresh), radius, keyed(cut(old.join(lost, "h", "left_anti")))))
        near = cut(pairs.select(F.col("a").alias("h"), F.col("b").alias("g")))
    _write(near, path, "edges", generation)

    before = spark.read.schema(LABELS).parquet(f"{path}/labels/generation={last}") if generation else spark.createDataFrame([], LABELS)
    # Components that have lost a hash fall apart into their hashes and are joined by their own edges.
    broken = cut(before.join(lost, "h", "left_semi").select("root").distinct())
    loose = cut(before.join(broken, "root", "left_semi").join(lost, "h", "left_anti").select("h", F.col("h").alias("root")))
    whole = before.join(broken, "root", "left_anti").select("h", "root")
    inner = _read(spark, path, "edges", last, EDGES).join(loose.select("h"), "h", "left_semi").join(loose.select(F.col("h").alias("g")), "g", "left_semi").select("h", "g")
    named = cut(whole.union(loose).union(fresh.select("h", F.col("h").alias("root"))))
    roots = lambda e: spread_join(spread_join(cut(e), named.withColumnRenamed("root", "a"), ["h"]), named.select(F.col("h").alias("g"), F.col("root").alias("b")), ["g"])
    changed = components(roots(near.union(inner)).where("a <> b").select("a", "b").distinct())
    labels = spread_join(named, changed.select(F.col("id").alias("root"), F.col("root").alias("top")), ["root"], "left").select("h", F.coalesce("top", "root").alias("root"))
    _write(labels, path, "labels", generation)
    return {"printed": made.count(), "probed": fresh.count(), "edges": near.count(), "gone": lost.count()}


def labels(spark: SparkSession, path: str, generation: int) -> DataFrame:
    """(h, root) of all hashes there are: the root is the smallest hash of the component."""
    return spark.read.schema(LABELS).parquet(f"{path}/labels/generation={generation}")


def groups(spark: SparkSession, path: str, versions: DataFrame, generation: int) -> DataFrame:
    """(key, root) of the versions whose hash is another's too or near one: the smallest key of their component."""
    prints = _read(spark, path, "prints", generation, PRINTS).where("h IS NOT NULL").groupBy("key").agg(F.max("h").alias("h"))
    rows = cut(spread_join(cut(prints.join(versions.select("key").distinct(), "key", "left_semi")), labels(spark, path, generation), ["h"]))
    tops = rows.groupBy("root").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first")
    return spread_join(rows, tops, ["root"]).select("key", F.col("first").alias("root"))
