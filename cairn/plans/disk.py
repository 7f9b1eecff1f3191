"""Registered queries over files on disk, which a query first writes from a table, each with SQL written independently of it."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import duplicates as D
from ..session import temporary
from ..sources import catalog as C
from ..sources.catalog import CATALOG_SQL as CAT, of_documents
from .queries import query


def _written(files: DataFrame) -> str:
    """The folder, shared by all executors, below which the files (path, content) have been written."""
    where = urlparse(temporary(files.sparkSession, "tree"))
    if where.scheme not in ("", "file"):
        raise ValueError("the shared folder must be mounted on all machines")
    root = where.path

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "wb") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return root


def _documents(spark: SparkSession, d: str) -> DataFrame:
    c = of_documents(spark, d)
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return c.select("doc_id", "path", content.alias("content")).withColumn("size", F.length("content"))


@query(f"""WITH {CAT} SELECT path, false AS is_dir, coalesce(size, 0)::BIGINT AS size FROM catalog UNION ALL SELECT path, true, 0
FROM (SELECT source AS path FROM documents UNION SELECT source || '/' || lang FROM documents UNION SELECT source || '/' || lang || '/2023' FROM documents WHERE doc_id % 3 = 0)""")
def tree_scan(spark, d):
    return C.scan(spark, _written(_documents(spark, d))).select("path", "is_dir", "size")


@query(f"""WITH {CAT}, f AS (SELECT path, doc_id % 50 = 0 AND size > 0 AS big, CASE WHEN doc_id % 50 = 0 AND size > 0 THEN encode(repeat(text, (200000 // size + 1)::BIGINT)) ELSE encode(coalesce(text, '')) END AS c FROM catalog),
files AS (SELECT path, c FROM f UNION ALL SELECT path || '.copy', c FROM f WHERE big UNION ALL SELECT path || '.other', c[1:66000] || '#'::BLOB || c[66002:] FROM f WHERE big), n AS (SELECT path, c, octet_length(c) AS size FROM files),
h AS (SELECT path, size, sha256(c) AS hash, sha256(CASE WHEN size <= 196608 THEN c ELSE c[1:65536] || c[size // 2 - 32767 : size // 2 + 32768] || c[size - 65535:] END) AS part FROM n WHERE size > 0)
SELECT path, hash, least(size, 196608)::BIGINT AS part_bytes FROM (SELECT *, count(*) OVER (PARTITION BY size, part) AS k FROM h) WHERE k > 1""")
def copies_on_disk(spark, d):
    """Files of the documents; some are made longer than three windows, and have a copy and one that differs between the windows."""
    big = (F.col("doc_id") % 50 == 0) & (F.col("size") > 0)
    base = _documents(spark, d)
    longer = base.where(big).withColumn("content", F.expr("repeat(decode(content, 'UTF-8'), cast(200000 div size + 1 as int))").cast("binary"))
    other = F.concat(F.substring("content", 1, 66_000), F.lit(b"#"), F.expr("substring(content, 66002)"))
    files = base.where(~big).unionByName(longer).unionByName(longer.withColumn("path", F.concat("path", F.lit(".copy")))).unionByName(longer.withColumns({"path": F.concat("path", F.lit(".other")), "content": other}))
    root = _written(files)
    return D.hashed_on_disk(C.scan(spark, root).where("NOT is_dir").select("path", "size"), root).select("path", "hash", "part_bytes")
