"""Every catalogue query equals its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quillmesh.plans.oracles import ORACLES
from quillmesh.plans.queries import QUERIES

AT = "/root/testdata/sf0.001"


def rows(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(AT):
        con.sql(f"create view {file[:-8]} as select * from '{AT}/{file}'")
    got, want = QUERIES[name](spark, AT).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_core_stands_without_the_optional_subpackage(monkeypatch):
    """Whether its folder is gone or something it needs is missing: the other queries load."""
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("quillmesh.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quillmesh.llm", None)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLES)
