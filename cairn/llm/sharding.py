"""Sharding by extendible hashing, in DataFrame operations only.

A row's key is 60 hash bits. The directory is indexed by prefixes of those bits; a bucket that holds more bytes than the
limit splits on its next bit, others do not. Bytes are summed once for prefixes a little longer than an even split
would need; all shorter prefixes follow from these sums. Buckets still too large go on to longer prefixes with their
own rows alone. The directory is never collected and joins rows by prefix.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import kernel as K

BITS = 60
#: Bits beyond those of an even split that the first round counts, bits that each further round adds, and levels of the tree summed at once.
SPARE, STEP, LEVELS = 3, 8, 6


def _hash(key: str, text: str) -> F.Column:
    """32 bits of the key's md5, then 28 of the text's, which part rows of equal keys."""
    bits = lambda c, n: F.conv(F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), 1, n), 16, 10).cast("long")
    return F.shiftleft(bits(key, 8), 28).bitwiseOR(bits(text, 7))


def _leaves(rows: DataFrame, base: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """For rows whose buckets at ``base`` bits are too large (or all, at 0): slots (prefix of ``depth`` bits, leaf), and the prefixes to split further."""
    sums = rows.groupBy(F.shiftright("h", BITS - depth).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    # From the longest prefixes up, a few levels at a time: what a step sums is 2 ** LEVELS times fewer rows than the step below.
    low, levels, first = depth, [], depth
    while not levels or low > base:
        high, low = low, max(base, low - LEVELS)
        each = sums.select(F.explode(F.sequence(F.lit(low), F.lit(first))).alias("d"), "p", "b", "n")
        levels.append(K.cut(each.groupBy("d", F.expr(f"shiftright(p, {high} - d)").alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))))
        sums, first = levels[-1].where(F.col("d") == low).select("p", "b", "n"), low - 1
    tree = reduce(DataFrame.union, levels)
    full = tree.where(F.col("b") > limit)
    last = depth == BITS
    fits = tree.where(F.lit(last) & (F.col("d") == depth) | (F.col("b") <= limit))
    split = full if not last else full.where(F.col("d") < depth)
    # A leaf fits and its parent does not.
    parents = split.select((F.col("d") + 1).alias("d"), F.explode(F.array(F.col("p") * 2, F.col("p") * 2 + 1)).alias("p"))
    leaves = fits.join(parents, ["d", "p"], "left_semi") if base else fits.join(parents, ["d", "p"], "left_semi").union(fits.where("d = 0"))
    width = F.expr(f"shiftleft(1L, {depth} - d)")
    slots = leaves.select("d", "p", "b", "n", F.explode(F.sequence(F.col("p") * width, F.col("p") * width + width - 1)).alias("slot"))
    return slots, full.where((F.col("d") == depth) & F.lit(not last)).select(F.col("p").alias("slot"))


def _placed(docs: DataFrame, limit: int, key: str, text: str) -> DataFrame:
    """``assign`` with h, the row's hash bits: rows of one h are in one shard."""
    rows = K.cut(docs.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), _hash(key, text).alias("h")))
    total = rows.select(F.sum("n_bytes")).first()[0] or 0
    base, depth, parts = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE), []
    while True:
        slots, more = _leaves(rows, base, depth, limit)
        more = K.cut(more)
        keyed = rows.withColumn("slot", F.shiftright("h", BITS - depth))
        found = keyed.join(slots, "slot")
        digits = F.when(F.col("d") == 0, F.lit("")).otherwise(F.expr("lpad(bin(p), d, '0')"))
        parts.append(found.select("h", key, "n_bytes", digits.alias("shard"), F.col("d").alias("depth"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"), (F.col("b") > limit).alias("overflow")))
        if more.isEmpty():
            break
        rows = K.cut(keyed.join(more, "slot", "left_semi").drop("slot"))
        base, depth = depth, min(BITS, depth + STEP)
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes, shard_docs, overflow) of every row; shard is the bucket's prefix in binary digits.

    Null and empty texts have 0 bytes; a null key is hashed as an empty one. Only where one row alone, or rows equal in key
    and text, exceed the limit does a shard exceed it, and is marked ``overflow``. An empty table gives an empty result.
    """
    return _placed(docs, limit, key, text).drop("h")


def write(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as one folder per shard. Every row goes to the shard that ``assign`` gives it, null keys and parted ones
    too: it finds it by its hash bits; another shuffle takes it to its shard's task."""
    shards = _placed(docs, limit, key, text).select(F.col("h").alias("__h"), "shard").distinct()
    docs.withColumn("__h", _hash(key, text)).join(shards, "__h").drop("__h").repartition("shard").write.partitionBy("shard").parquet(path)


LIMIT = 1 << 20


def query(spark, sf_dir: str) -> DataFrame:
    return assign(K.docs_of(spark, sf_dir), LIMIT)


#: Tries every depth for every row, up to where a shard of this limit can still split at the test's size.
SQL = f"""
WITH rows AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT << 28) | ('0x' || substr(md5(coalesce(text, '')), 1, 7))::BIGINT AS h FROM documents),
     depths AS (SELECT unnest(range(0, {BITS} + 1)) AS d),
     tree AS (SELECT d, h >> ({BITS} - d) AS p, sum(n_bytes) AS b, count(*) AS n FROM rows, depths GROUP BY ALL),
     ranked AS (SELECT doc_id, n_bytes, h, d, b, n, row_number() OVER (PARTITION BY doc_id, h ORDER BY (b <= {LIMIT} OR d = {BITS}) DESC, d) AS r
                FROM rows, depths JOIN tree USING (d) WHERE tree.p = rows.h >> ({BITS} - d))
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - d)), d::INT, '0') END AS shard, d::INT AS depth, b::BIGINT AS shard_bytes, n AS shard_docs, b > {LIMIT} AS overflow
FROM ranked WHERE r = 1
"""
