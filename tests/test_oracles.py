"""Every registered query against its DuckDB oracle on the test tables."""

import compare
import pytest
from __spark_entry__ import entry

from broodline.plans.oracles import ORACLES
from broodline.plans.registry import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, duck, key):
    df = QUERIES[key](spark, sf_dir)
    columns, found = compare.spark_rows(df)
    expected_columns, expected = compare.oracle_rows(duck, ORACLES[key])
    assert columns == expected_columns
    assert found, "empty result"
    assert found == expected
    assert compare.type_mismatches(df, duck, ORACLES[key]) == []


def test_entry_runs(spark):
    assert entry(spark).count() > 0
