"""Checksums, snapshots and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def sha256(content: Column | str) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.sha2(c.cast("binary"), 256)


def same_content(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, same): equal size and checksum; both frames have key, size, sha256."""
    left, right = (x.select(key, F.col("size").alias(f"size_{n}"), F.col("sha256").alias(f"sha_{n}")) for n, x in (("a", a), ("b", b)))
    return left.join(right, key).select(key, ((F.col("size_a") == F.col("size_b")) & (F.col("sha_a") == F.col("sha_b"))).alias("same"))


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(rel, status) of two snapshots (rel, size, sha256): unchanged, changed, missing, added or unreadable (no checksum now)."""
    a = before.select("rel", F.col("size").alias("s"), F.col("sha256").alias("h"), F.lit(True).alias("old"))
    b = now.select("rel", F.col("size").alias("t"), F.col("sha256").alias("g"), F.lit(True).alias("new"))
    status = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added").when(F.col("g").isNull(), "unreadable")
    status = status.when(F.col("s").eqNullSafe(F.col("t")) & F.col("h").eqNullSafe(F.col("g")), "unchanged").otherwise("changed")
    return a.join(b, "rel", "full_outer").select("rel", status.alias("status"))


def counts(differences: DataFrame) -> DataFrame:
    return differences.groupBy("status").agg(F.count("*").alias("n"))


#: Names that a verification lists of each status at most; counts are whole.
LISTED = 1000


def verification(differences: DataFrame, listed: int = LISTED) -> DataFrame:
    """(status, n, names) of ``diff``: all counted, the first ``listed`` names by order; unchanged ones are only counted."""
    turn = F.row_number().over(Window.partitionBy("status").orderBy("rel"))
    first = differences.where("status <> 'unchanged'").withColumn("_n", turn).where(F.col("_n") <= listed)
    names = first.groupBy("status").agg(F.sort_array(F.collect_list("rel")).alias("names"))
    return counts(differences).join(names, "status", "left").select("status", "n", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


class Snapshots:
    """A folder of snapshots, one partition each; a snapshot is written whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, snapshot_id: str, items: DataFrame) -> None:
        items.select("rel", "size", "sha256", F.current_timestamp().alias("created")).write.mode("errorifexists").parquet(f"{self.path}/snapshot_id={snapshot_id}")

    def load(self, snapshot_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshot_id={snapshot_id}").drop("created")

    def delete(self, snapshot_id: str) -> bool:
        """Whether there was such a snapshot."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshot_id={snapshot_id}")
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)

    def all(self) -> DataFrame:
        """(snapshot_id, created, files, bytes), newest first."""
        rows = self.spark.read.schema("rel string, size long, sha256 string, created timestamp, snapshot_id string").parquet(self.path)
        return rows.groupBy("snapshot_id").agg(F.min("created").alias("created"), F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("created"), F.desc("snapshot_id"))


def unread(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items whose version (path, size, modification) the cache does not hold; only they need reading."""
    return items.join(cache.select("path", "size", "modified_ms"), ["path", "size", "modified_ms"], "left_anti")
