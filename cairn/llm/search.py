"""Ranked lexical search over postings kept as a DataFrame in buckets of terms.

A posting is a row (bucket, term, document, occurrences, the document's number of terms). Postings are made once and written
sorted by bucket and term, so that a search reads the buckets of its terms. Terms of the items join postings; each match is an
integer score; scores are summed by item and document where the documents' postings lie, and a window numbers the best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import small
from . import kernel as K

BUCKETS, TOP = 256, 20
#: Distinct terms of the items up to which other terms' postings are left out as they are made; with more, all are made.
MAX_TERMS = 1_000_000


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", only=None) -> DataFrame:
    """(row, key, n, h, term, tf) of every distinct term of every row, and a row with a null term for each row of ``docs``.

    Terms are runs of letters, digits and signs beyond ASCII, A-Z lower-cased; n counts the row's terms with repeats. ``only``, a
    broadcast sorted array of hashes, leaves out other terms. Null and empty texts have no terms; rows that repeat are rows of
    their own, told apart by ``row``; other columns are not read. Texts that are not UTF-8 are taken byte by byte.
    """
    K.row_bytes(docs.sparkSession)
    fields = [StructField("row", LongType()), StructField("key", docs.schema[key].dataType)]
    schema = StructType(fields).add("n", "long").add("h", "long").add("term", "string").add("tf", "long")

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in K.tidied(batches):
            for i, j, data, bounds in K.chunks(batch.column(1)):
                starts, ends, at = K.words(data, bounds, K.ALNUM)
                n = np.diff(at)
                doc, h = np.repeat(np.arange(j - i), n), K.hashes(data, starts, ends)
                if only is not None and len(h):
                    all_, where = only.value, np.searchsorted(only.value, h)
                    kept = np.flatnonzero(all_[np.minimum(where, len(all_) - 1)] == h) if len(all_) else np.zeros(0, np.int64)
                    starts, ends, doc, h = starts[kept], ends[kept], doc[kept], h[kept]
                order = np.lexsort((h, doc))
                d, g = doc[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])])) if len(d) else np.zeros(0, np.int64)
                tf, d, g, at = np.diff(np.append(first, len(order))), d[first], g[first], order[first]
                heads = np.arange(j - i)
                whose = np.concatenate([heads, d])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + i + whose),
                        batch.column(0).take(pa.array(i + whose)),
                        pa.array(n[whose]),
                        pa.array(np.concatenate([np.zeros(j - i, np.int64), g.view(np.int64)])),
                        _strings(data, starts[at], ends[at], j - i),
                        pa.array(np.concatenate([np.zeros(j - i, np.int64), tf])),
                    ],
                    names=schema.names,
                )
            row += batch.num_rows

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, nulls: int) -> pa.Array:
    """So many nulls, then the lower-cased byte ranges."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    flat = K.LOWER[data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]] if len(size) else np.zeros(0, np.uint8)
    offsets = np.concatenate([np.zeros(nulls, np.int32), at.astype(np.int32)])
    valid = np.concatenate([np.zeros(nulls, bool), np.ones(len(size), bool)])
    return pa.StringArray.from_buffers(nulls + len(size), pa.py_buffer(offsets), pa.py_buffer(flat), pa.py_buffer(np.packbits(valid, bitorder="little")), nulls)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", only=None) -> DataFrame:
    """The postings as a table in the shared folder: each task's file is sorted by bucket and term. Null terms are in bucket -1."""
    bucket = F.when(F.col("term").isNull(), F.lit(-1)).otherwise(F.pmod("h", F.lit(BUCKETS))).cast("int").alias("bucket")
    return K.cut(postings(docs, key, text, only).select(bucket, "term", "row", "key", "n", "tf", "h").sortWithinPartitions("bucket", "term"))


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item, rank, key, score) of each item's ``top`` documents with a score above 0, equal scores by the key, then by row.

    Items or documents without terms (null, empty, signs only) have no rows; repeated items are ranked each, repeated documents
    rank one after another; null keys rank first among ties. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = index(items, item, item_text).where("term IS NOT NULL")
    terms = asked.select("h").distinct()
    held = None
    if terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS:
        found = np.sort(np.array([r[0] for r in terms.collect()], np.int64).view(np.uint64))
        held = spark.sparkContext.broadcast(found)
    whole = index(docs, key, text, held)
    n_docs, n_terms = whole.where("bucket = -1 AND n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
    lists = whole.where(F.col("bucket").isin(buckets))
    df = lists.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    # A term of no weight adds nothing to any score.
    weighed = asked.join(df, "term").select("term", F.col("row").alias("item_row"), F.col("key").alias("item"), (weight * F.col("tf")).alias("w")).where("w > 0")
    m = F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")
    part = F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)")
    # Dealt by document, so that the sums by item and document need no second shuffle.
    scored = lists.withColumn("m", m).select("row", "key", "term", part.alias("part")).repartition("row").join(small(K.cut(weighed)), "term")
    sums = scored.groupBy("row", "item_row").agg(F.first("key").alias("key"), F.first("item").alias("item"), F.sum(F.col("w") * F.col("part")).alias("score")).where("score > 0")
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_first("key"), "row")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(K.docs_of(spark, sf_dir), K.docs_of(spark, sf_dir, "benchmark"))


SQL = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
     asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     postings AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL),
     lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM terms GROUP BY ALL),
     corpus AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM lengths),
     weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, corpus GROUP BY term, nd),
     matches AS (SELECT item_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))) AS score
                 FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), corpus),
     sums AS (SELECT item_id, doc_id, sum(score)::BIGINT AS score FROM matches GROUP BY ALL),
     ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM sums WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
