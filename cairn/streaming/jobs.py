"""Streaming forms: windowed counts with late data, sessions, progressive totals, arrivals and the decision reducer."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from ..session import temporary


def source(spark: SparkSession, like: DataFrame, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, by: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, by, n) of event-time windows; events later than ``late`` are left out once their window is closed."""
    at = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(at.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, by: str, gap: str, late: str) -> DataFrame:
    """(start, stop, by, n): runs of events less than ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), by, "n")


def totals(files: DataFrame, by: str) -> DataFrame:
    """Totals that each batch publishes anew (complete mode)."""
    return files.groupBy(by).agg(F.count("*").alias("n"))


def collected(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """All that a bounded stream has to say, once it has read what is there now, from files in the shared folder.

    Each batch writes its own folder, so that a batch run again replaces itself. Complete: the last batch's rows; append: all rows;
    update: each of ``keys``' last row.
    """
    spark, path, batches = stream.sparkSession, temporary(stream.sparkSession, "stream"), []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        batches.append(batch)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(f"{path}/rows")
    if mode == "complete":
        return rows.where(F.col("batch") == max(batches)).drop("batch")
    if mode == "update" and keys:
        others = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*").select(*stream.columns)
    return rows.drop("batch")


def reduced(events: DataFrame) -> DataFrame:
    """(item, decision, moves) after each batch from (item, seq, decision): the last decision of an item stands, undo takes it back.

    The order is that of ``seq`` in all that has come, whichever batch or piece of a batch brought it: an earlier event that comes
    late changes what undo took back. So the state of an item is its events."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        said = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        for pdf in batches:  # a group may come in several pieces
            said.extend(zip(pdf["seq"].tolist(), pdf["decision"].tolist(), strict=True))
        said.sort()
        done: list[str] = []
        for _, decision in said:
            if decision != "undo":
                done.append(decision)
            elif done:
                done.pop()
        state.update((json.dumps(said),))
        yield pd.DataFrame({"item": [key[0]], "decision": [done[-1] if done else None], "moves": [len(done)]})

    return events.groupBy("item").applyInPandasWithState(step, "item long, decision string, moves long", "said string", "update", "NoTimeout")


class Progress(StreamingQueryListener):
    """Keeps the rows that streams have read, by query: what a progress bar shows."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.ended.add(str(event.id))


def publish(rows: DataFrame, path: str, generation: int) -> bool:
    """Write a generation of results unless a later one is there already; whether it was written."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    known = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(folder) if "=" in s.getPath().getName()] if fs.exists(folder) else []
    if known and max(known) >= generation:
        return False
    rows.write.parquet(f"{path}/generation={generation}")
    return True


def published(spark: SparkSession, path: str) -> DataFrame:
    """The latest generation."""
    rows = spark.read.parquet(path)
    latest = rows.select(F.max("generation")).first()[0]
    return rows.where(F.col("generation") == latest).drop("generation")
