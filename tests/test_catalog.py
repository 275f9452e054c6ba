"""Every query against its SQL on the smallest tables, as the driver compares them."""

import glob
import math
import os
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = entry.catalog.queries()
SQL = entry.catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows_of(rows):
    return sorted(str([plain(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(SF + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name in SQL:
        relation = duck.sql(SQL[name])
        assert sorted(relation.columns) == columns
        named = ", ".join(f'"{c}"' for c in columns)
        assert rows_of(got) == rows_of(duck.sql(f"select {named} from ({SQL[name]})").fetchall())


def test_llm_only_if_present():
    names = set(entry.queries())
    assert set(CORE) <= names
    assert entry.llm_queries is not None or not any(n.startswith("p1_") for n in names)
