"""Vectorised text kernels over Arrow string buffers, and the Spark plumbing the operators share.

A column of texts is one byte buffer with offsets. Words are runs of bytes outside a separator table, found
with a few array operations; nothing here loops over words in Python but for words longer than ``LONG`` bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut, remove, shared_dir, spread_join, temporary

#: Bytes of text handled at once, so that temporary arrays stay small whatever the Arrow batch holds.
CHUNK = 4 << 20
LONG = 32

#: [^\x20\x09-\x0D]+
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= _M2
    h ^= h >> np.uint64(27)
    h *= _M3
    h ^= h >> np.uint64(31)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's bounds in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    bounds = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of whole texts of about ``size`` bytes."""
    data, bounds = buffers(texts)
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, side="right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the bounds of its words in these lists."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = table[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    table = LOWER if lower else SAME
    size = ends - starts
    out = size.astype(np.uint64) + _M1
    order = np.argsort(-np.minimum(size, LONG + 1).astype(np.int16), kind="stable")
    sizes = size[order]
    many = int(np.searchsorted(-sizes, -LONG, side="left"))
    at, h = starts[order[many:]], out[order[many:]]
    sizes = sizes[many:]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, side="left"))  # those longer than k
        h[:m] = (h[:m] ^ table[data[at[:m] + k]]) * _M1
        h[:m] ^= h[:m] >> np.uint64(29)
    out[order[many:]] = h
    for i in order[:many]:
        out[i] = xxhash.xxh64_intdigest(table[data[starts[i] : ends[i]]].tobytes())
    return mix(out)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k values from each place on; the last k - 1 places have no meaning."""
    out = h.copy()
    for j in range(1, k):
        n = max(0, len(h) - j)
        out[:n] = out[:n] * _M1 + h[j:]
        out ^= out >> np.uint64(31)
    return mix(out)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash), sorted, of each text's distinct runs of k words; of fewer words, the whole as one."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    full = windows(h, k)
    keep = np.arange(len(h)) + k <= bounds[1:][doc]
    few = np.flatnonzero((n > 0) & (n < k))
    extra = np.array([xxhash.xxh64_intdigest(h[bounds[i] : bounds[i + 1]].tobytes(), 7) for i in few], np.uint64)
    doc, full = np.concatenate([doc[keep], few]), np.concatenate([full[keep], extra])
    order = np.lexsort((full, doc))
    doc, full = doc[order], full[order]
    if len(doc):
        first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (full[1:] != full[:-1])])
        doc, full = doc[first], full[first]
    return doc, full


def texts(column: pa.Array) -> list[str | None]:
    """The column's strings; bytes that are not UTF-8 become U+FFFD, nulls stay."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, columns: list[str], schema: str | StructType, each: Callable[[pa.RecordBatch], dict | Iterator[dict]]) -> DataFrame:
    """``each`` makes columns (name: values) from a batch of ``columns``, or several such; run by Arrow batch in Python workers."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = to_arrow_schema(schema)

    def run(batches):
        for batch in tidied(batches):
            made = each(batch)
            for x in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([x[f.name] if isinstance(x[f.name], pa.Array) else pa.array(x[f.name], f.type) for f in kind], schema=kind)

    return df.select(*columns).mapInArrow(run, schema)


def tidied(batches: Iterator) -> Iterator:
    """The batches; when they end, a worker that waits for its next task gives back what it no longer uses."""
    yield from batches
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def row_bytes(spark: SparkSession, at_most: int = 16 << 20) -> None:
    """Arrow batches of text end at so many bytes, however long single texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(at_most))


def docs_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


__all__ = ["ALNUM", "CHUNK", "LOWER", "SPACES", "buffers", "chunks", "cut", "docs_of", "hashes", "map_batches", "mix", "remove", "row_bytes", "shared_dir", "shingles", "spread_join", "temporary", "texts", "tidied", "windows", "words"]
