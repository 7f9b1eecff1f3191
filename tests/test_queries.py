import math

import pytest

import __spark_entry__ as entry
from cairn.plans.queries import QUERIES, SQL

from .conftest import SMALL, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck.sql(SQL[name]))


def test_all_catalog_queries_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_have_no_nested_loops_and_prune(spark):
    for name in ("range_candidates", "private_boundaries", "hash_candidates", "selection_rollup"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and ("NestedLoop" not in plan or name == "hash_candidates"), name
    plan = QUERIES["storage_by_kind"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "n_chars" not in plan


def test_listings_are_whole_beyond_the_screen_limit(spark, duck, tmp_path):
    docs = spark.range(160_000).selectExpr("id AS doc_id", "'a' AS text", "'en' AS lang", "concat('src', 2 + id % 2) AS source", "1L AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(160_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    spark.range(60_000).selectExpr("id AS page_id", "concat('https://example.org/', id, '.html') AS url", "encode('x', 'UTF-8') AS html").write.parquet(str(tmp_path / "pages.parquet"))
    for name, n in (("tag_filter", 53_334), ("favorites", 160_000), ("visible_from_scope", 80_000), ("browse_recursive_sorted", 80_000), ("browse_search_pages", 60_000)):
        assert QUERIES[name](spark, str(tmp_path)).count() == n, name


def test_followed_private_reads_every_folder(spark):
    plan = QUERIES["followed_private"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 1" not in plan


def test_range_pairs_over_the_whole_table(spark):
    from cairn.operators import similar as S

    v = spark.read.parquet(f"{SMALL}/part.parquet").selectExpr("p_partkey AS id", "cast(round(p_retailprice * 100) AS long) * 7 AS duration", "600 + p_size * 10 AS w", "400 AS h")
    rows = [tuple(r) for r in v.collect()]
    want = {(a, b) for a, da, wa, _ in rows for b, db, wb, _ in rows if (da, a) < (db, b) and db <= da * 1.15 + 2000 and abs(math.log(wa / 400) - math.log(wb / 400)) <= 0.05}
    assert want and {tuple(r) for r in S.range_pairs(v).collect()} == want
