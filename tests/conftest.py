import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cairn.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def same(df, relation) -> None:
    """Equal column names and equal rows, whatever their order."""
    def rows(found, columns):
        at = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(repr(tuple(r[i] for i in at)) for r in found)

    assert sorted(df.columns) == sorted(relation.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(relation.fetchall(), relation.columns)
