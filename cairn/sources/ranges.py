"""Parts of files, read where they are: heads, tails and windows by position, whole files in steps. A file is never read to cut a part from it.

``root`` is a folder that all executors see or an address that Arrow's file systems know; ``path`` is below it. Filters on the
listing (sizes, kinds) decide what is opened. Tasks get about equal shares of bytes and files, many small files each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes and files of a task, bytes of a batch of results, and bytes read at once of whole files.
TASK_BYTES, TASK_FILES, BATCH_BYTES, STEP = 64 << 20, 10_000, 16 << 20, 1 << 20
HEAD, TAIL, WINDOW = 256 * 1024, 1024, 64 * 1024


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _shared_out(files: DataFrame, size: Column) -> DataFrame:
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return files.repartition(max(1, total // TASK_BYTES, n // TASK_FILES), "path")


def _each(files: DataFrame, root: str, schema: str, read: Callable[[pa.NativeFile, list], tuple[list, int]], nothing: list, ranges: str | None = None) -> DataFrame:
    """``files`` with the columns of ``schema``, by ``read`` (an open file, its ranges), which also tells the bytes that it gives; ``nothing`` where a file cannot be read."""
    kept = [c for c in files.columns if c != ranges]
    out = StructType([*[files.schema[c] for c in kept], *StructType.fromDDL(schema).fields])
    kind = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            wanted = batch.column(ranges).to_pylist() if ranges else [None] * batch.num_rows
            made, held, first = [], 0, 0
            for i, (path, parts) in enumerate(zip(batch.column("path").to_pylist(), wanted, strict=True)):
                try:
                    with store.open_input_file(f"{base}/{path}") as f:
                        row, size = read(f, parts)
                except OSError:
                    row, size = nothing, 0
                made.append(row)
                held += size
                if held > BATCH_BYTES or i + 1 == batch.num_rows:
                    columns = [batch.column(c).slice(first, len(made)) for c in kept] + [pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), list(kind)[len(kept) :], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=kind)
                    made, held, first = [], 0, i + 1

    return files.mapInArrow(run, out)


def parts(files: DataFrame, root: str, ranges: Column) -> DataFrame:
    """Adds parts (the bytes of each of ``ranges``: array of structs at, size; null if the file cannot be read) and bytes_read."""
    def read(f: pa.NativeFile, wanted: list) -> tuple[list, int]:
        got = [f.read_at(r["size"], r["at"]) for r in wanted or []]
        n = sum(map(len, got))
        return [got, n], n

    rows = files.withColumn("__ranges", ranges)
    size = F.aggregate("__ranges", F.lit(0).cast("long"), lambda n, r: n + r["size"])
    return _each(_shared_out(rows, size), root, "parts array<binary>, bytes_read long", read, [None, 0], "__ranges")


def _range(at: Column, size: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), size.cast("long").alias("size"))


def head_and_tail(files: DataFrame, root: str) -> DataFrame:
    """Adds head (HEAD bytes at most), tail (the last TAIL) and bytes_read of ``files`` (path, size)."""
    n = F.col("size")
    ends = F.array(_range(F.lit(0), F.least(n, F.lit(HEAD))), _range(F.greatest(n - TAIL, F.lit(0)), F.least(n, F.lit(TAIL))))
    head_only = F.array(_range(F.lit(0), n))
    rows = parts(files, root, F.when(n > HEAD, ends).otherwise(head_only))
    head = F.get("parts", F.lit(0))
    return rows.withColumn("head", head).withColumn("tail", F.coalesce(F.get("parts", F.lit(1)), F.when(F.length(head) > TAIL, F.substring(head, -TAIL, TAIL)).otherwise(head))).drop("parts")


def windows(files: DataFrame, root: str) -> DataFrame:
    """Adds part (SHA-256 of WINDOW bytes at the beginning, around the middle and at the end; of all bytes up to three windows) and bytes_read."""
    n, w = F.col("size"), F.lit(WINDOW)
    three = F.array(_range(F.lit(0), w), _range(F.floor(n / 2) - WINDOW // 2, w), _range(n - WINDOW, w))
    rows = parts(files, root, F.when(n > 3 * WINDOW, three).otherwise(F.array(_range(F.lit(0), n))))
    return rows.withColumn("part", F.sha2(F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)), 256)).drop("parts")


def whole_hash(files: DataFrame, root: str) -> DataFrame:
    """Adds hash (SHA-256 of all bytes, read in steps; null if the file cannot be read or is not of its listed size)."""
    def read(f: pa.NativeFile, _: list) -> tuple[list, int]:
        h, n = hashlib.sha256(), 0
        while step := f.read(STEP):
            h.update(step)
            n += len(step)
        return [h.hexdigest(), n], 0

    made = _each(_shared_out(files, F.col("size")), root, "hash string, __n long", read, [None, None])
    return made.withColumn("hash", F.when(F.col("__n") == F.col("size"), F.col("hash"))).drop("__n")
