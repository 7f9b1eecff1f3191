"""What comes and goes: differences of a folder's listing, and of a table of snapshots, as streams that survive a restart."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..session import cut, small, temporary

#: Names in a listing, which a stream's offset holds; a larger listing is a table of snapshots (``differences``).
MAX_NAMES = 10_000


class _Events(InputPartition):
    def __init__(self, events: list[tuple[str, str]]):
        super().__init__(0)
        self.events = events


class _ListingReader(DataSourceStreamReader):
    """An offset is the listing itself, so a batch is the difference of two offsets: a batch run again is the same batch, and a
    stream that starts again goes on from the listing of its last batch. What is there at the first start is not announced."""

    def __init__(self, folder: str, known: set[str]):
        self.folder, self.known = folder, known

    def _listing(self) -> dict:
        with os.scandir(self.folder) as entries:
            names = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
        if len(names) > MAX_NAMES:
            raise ValueError(f"{self.folder} has {len(names)} folders; at most {MAX_NAMES} are watched by listing")
        return {"names": json.dumps(names)}

    def initialOffset(self) -> dict:  # noqa: N802
        return self._listing()

    def latestOffset(self, *_: object) -> dict:  # noqa: N802
        return self._listing()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = (set(json.loads(x["names"])) for x in (start, end))
        return [_Events([(n, "added") for n in sorted(now - before - self.known)] + [(n, "removed") for n in sorted(before - now)])]

    def read(self, partition: _Events) -> Iterator[tuple[str, str]]:
        yield from partition.events

    def commit(self, end: dict) -> None:
        pass


class Listing(DataSource):
    """``spark.readStream.format("cairn_listing").option("path", folder)``: (name, event: added or removed) of the folders in a folder
    that the driver sees, such as mounted drives. ``known``: a JSON list of names that are not announced when they come."""

    @classmethod
    def name(cls) -> str:
        return "cairn_listing"

    def schema(self) -> str:
        return "name string, event string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _ListingReader(self.options["path"], set(json.loads(self.options.get("known", "[]"))))


def watch(spark: SparkSession, folder: str, known: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(Listing)
    return spark.readStream.format("cairn_listing").option("path", folder).option("known", json.dumps(known or [])).load()


def between(rows: DataFrame, name: str = "path") -> DataFrame:
    """(snapshot, name, event) of consecutive snapshots in ``rows`` (snapshot, name): equality joins with the neighbouring snapshot.

    A row with a null name says that a snapshot was taken, though it may be empty. The first snapshot announces nothing; names that
    repeat in a snapshot count once."""
    rows = cut(rows.select("snapshot", name).distinct())
    order = Window.orderBy("snapshot")  # a row for each snapshot
    steps = small(cut(rows.select("snapshot").distinct().select("snapshot", F.lag("snapshot").over(order).alias("last"), F.lead("snapshot").over(order).alias("next"))))
    named = rows.where(F.col(name).isNotNull())
    added = named.join(steps.where("last IS NOT NULL"), "snapshot").join(named.select(F.col("snapshot").alias("last"), name), ["last", name], "left_anti")
    removed = named.join(steps.where("next IS NOT NULL"), "snapshot").join(named.select(F.col("snapshot").alias("next"), name), ["next", name], "left_anti")
    return added.select("snapshot", name, F.lit("added").alias("event")).union(removed.select(F.col("next").alias("snapshot"), name, F.lit("removed").alias("event")))


def differences(snapshots: DataFrame, path: str, name: str = "path", known: DataFrame | None = None) -> None:
    """Run a stream of snapshots (snapshot, name), as far as there are any, into ``path``: ``differences_in`` reads what came and went.

    Each batch keeps its last snapshot beside its events, in a folder of its number. A batch that runs again, after a failure or a
    restart, starts from the batch before it and writes the same folders anew: nothing is lost or told twice. Snapshots must arrive
    in their order or together. ``known``: names that are not announced when they come.
    """
    spark = snapshots.sparkSession
    schema = StructType([snapshots.schema["snapshot"], snapshots.schema[name]])

    def step(rows: DataFrame, batch: int) -> None:
        rows = rows.select("snapshot", name)
        if batch:
            rows = rows.union(spark.read.schema(schema).parquet(f"{path}/listing/batch={batch - 1}"))
        rows = cut(rows)
        events = between(rows, name)
        if known is not None:
            events = events.where("event = 'removed'").union(events.where("event = 'added'").join(known.select(name).distinct(), name, "left_anti").select("snapshot", name, "event"))
        events.write.mode("overwrite").parquet(f"{path}/events/batch={batch}")
        last = small(rows.agg(F.max("snapshot").alias("snapshot")))
        rows.join(last, "snapshot", "left_semi").write.mode("overwrite").parquet(f"{path}/listing/batch={batch}")

    snapshots.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()


def differences_in(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot, name, event) of all batches of ``differences``."""
    return spark.read.parquet(f"{path}/events").drop("batch")


def scratch(spark: SparkSession) -> str:
    return temporary(spark, "arrivals")
