"""Every query of the core equals its SQL; those without any give rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import differences  # noqa: E402

import __spark_entry__  # noqa: E402
from tilewright.plans import catalogue  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, name):
    more, less = differences(spark, catalogue.QUERIES[name], catalogue.SQL[name], FOLDER)
    assert not more and not less, (list(more.items())[:3], list(less.items())[:3])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_sql_has_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
