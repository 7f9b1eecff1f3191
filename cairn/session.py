"""The session that all queries expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows up to which a side of a join is broadcast; beyond it the join shuffles.
SMALL_ROWS = 50_000


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive execution; ``conf`` adds to or replaces these settings."""
    builder = SparkSession.builder.appName("cairn")
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=base | conf).getOrCreate()


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that spark.checkpoint.dir names.

    Where it is unset a local master gets one of its own; any other is refused, as its executors could not read it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="cairn-checkpoint-")
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), file


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    fs, file = _file(spark, path)
    fs.mkdirs(file)
    fs.deleteOnExit(file)  # of what is there
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete what is at a path, now."""
    fs, file = _file(spark, path)
    fs.delete(file, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read back: recomputation stops here, also after lost executors.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{temporary(spark, 'cut')}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", parts: int = 1000) -> DataFrame:
    """``left.join(right, on, how)`` (inner or left) where ``right`` has one row for each key and some keys of ``left`` may be hot.

    Keys that hold more than one in ``parts`` of ``left``'s rows are ``parts`` at most; their right rows are broadcast, so that no
    task gets all of a hot key's rows. The rest is shuffled. ``left`` is read several times: give a table.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("__rows"))
    total = left.count()
    hot = cut(counts.where(F.col("__rows") > max(total / parts, 50)).select(*on).na.drop())
    if hot.isEmpty():
        return left.join(right, on, how)
    marked = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left")
    few = right.join(F.broadcast(hot), on, "left_semi")
    return marked.where("__hot").drop("__hot").join(F.broadcast(few), on, how).unionByName(marked.where("__hot IS NULL").drop("__hot").join(right, on, how))


def numbered(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: each row's number from 1 in the order of ``keys``, which should leave no ties.

    Rows are dealt by ranges of the keys and numbered there; the ranges' counts, one row each, give where each begins. So no task
    gets all rows.
    """
    dealt = cut(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + own).drop("__range", "__before")
