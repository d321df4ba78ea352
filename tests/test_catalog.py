"""Every registered query of the store against its SQL, and the shape of those that have none."""

import pytest
from support import SF

from tidemark.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[:2] == ["query_id", "subject"]


def test_fuzzy_entity_answers_every_customer(spark):
    assert QUERIES["fuzzy_entity"](spark, SF).count() == spark.read.parquet(f"{SF}/customer.parquet").count()
