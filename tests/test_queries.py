import pytest

import __spark_entry__
from oracle import same
from quillstrata.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    same(QUERIES[name](spark, tables), ORACLE_SQL[name], tables)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, tables, name):
    assert not QUERIES[name](spark, tables).isEmpty()


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "gid", "score", "rank"] and not df.isEmpty()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
