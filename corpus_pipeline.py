"""From documents to packed sequences: quality rules, one document of each group of near copies, no benchmark passages, no personal data.

Stages take documents with any further columns, whatever their names, and return them as they are. Null ids count as ids of
their own; rows that repeat stay as long as their stage does not say otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm import decontaminate, kernel, ngram_join, packing, pii, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: null and empty texts have too few words and go; repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links join; documents of no words are in none. Rows equal in id and text are one document."""
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without spans of test items; those of which such spans cover more than half go. Texts of no words stay."""
    return decontaminate.remove(docs, kernel.docs_of(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data (texts without any, null ones too, stay as they are), under the key that spark.cairn.pii.key names (else a public one, for trials)."""
    out = pii.replace(docs, spark.conf.get("spark.cairn.pii.key", pii.QUERY_KEY))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in sequences of 4096 tokens; a text of no words is one piece, its end id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("ngram_join", near_copies), ("decontamination", benchmark), ("pii", personal_data), ("packing", pack)]
#: Vote patterns' posteriors and a vocabulary's merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and read again by the next.

    A stage's table is deleted once the next is written, and all of them if a stage fails; the last, in which personal data are
    replaced, goes when the driver ends.
    """
    docs, root, last = kernel.docs_of(spark, sf_dir), kernel.temporary(spark, "pipeline"), None
    try:
        for name, stage in STAGES[:-1]:
            path = f"{root}/{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                kernel.remove(spark, last)
            last = path
        return STAGES[-1][1](spark, docs, sf_dir)
    except BaseException:
        kernel.remove(spark, root)
        raise
