"""Texts that are not UTF-8: no operator fails; wrong bytes count as U+FFFD where a text is decoded, and as themselves elsewhere."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import decontaminate, language_id, license_scan, ngram_join, packing, periodic, pii, quality_rules, repeats, search, secrets, sharding, token_counts

from ..conftest import SMALL

BAD = b"Under the MIT license \xff\xfe we met Dr Smith \xc3 and more words of it, password=Ab1\xe2\x82cdefgh12"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, bytearray(BAD)), (2, bytearray(b"\xff")), (3, bytearray(b"plain words"))]
    return spark.createDataFrame(rows, "doc_id long, text binary").withColumn("text", F.col("text").cast("string")).withColumn("source", F.lit("web")).cache()


def test_counts_are_those_of_the_replaced_text(docs):
    shown = BAD.decode("utf-8", "replace")
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_counts.count(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert got[1].n_tokens == len(byte.encode(shown, add_special_tokens=False).ids)
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = {r.doc_id: r for r in packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert packed[1].doc_tokens == len(word.encode(shown, add_special_tokens=False).ids) + 1


def test_no_operator_fails(spark, docs):
    sample = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.createDataFrame([(1, "we met dr smith and more words of it password ab1"), (2, "plain")], "item_id long, text string")
    model = language_id.fit(sample)
    made = {
        "language": language_id.label(docs, model), "quality": quality_rules.assess(docs.select("doc_id", "text")), "license": license_scan.find(docs), "decontaminate": decontaminate.scan(docs, items),
        "join": ngram_join.join(docs), "shards": sharding.assign(docs, 100), "runs": periodic.runs(docs), "repeats": repeats.dedup(docs), "pii": pii.replace(docs, "key"),
    }
    for name, df in made.items():
        df.write.format("noop").mode("overwrite").save()
        assert df.count() == 3, name
    assert decontaminate.remove(docs, items).count() == 3
    assert {r.doc_id for r in search.search(docs, items).collect()} == {1, 3}
    secrets.scan(docs).write.format("noop").mode("overwrite").save()
