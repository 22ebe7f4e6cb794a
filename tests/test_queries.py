"""Every registered core query against its SQL, over the smallest tables."""

import pytest

from oracle import compare, connect
from tarnwork.plans.catalog import collect

QUERIES, ORACLES = collect()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_every_document_is_a_case(spark, sf_dir):
    from pyspark.sql import functions as F

    from tarnwork.runtime import table

    cases = QUERIES["eval_by_collection_all"](spark, sf_dir).agg(F.sum("n_cases")).first()[0]
    assert cases == table(spark, sf_dir, "documents").filter("title IS NOT NULL AND collection_key IS NOT NULL AND doc_id % 70 != 0").count()
