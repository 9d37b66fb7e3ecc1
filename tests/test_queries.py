"""Every registered query beside its SQL, on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from checks import ORACLES, QUERIES  # noqa: E402
from tools.compare import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    verdict, size = compare(spark, connection, FOLDER, name)
    assert verdict.startswith("ok"), verdict


def test_entry_has_rows(spark):
    result = contract.entry(spark)
    assert result.columns == ["modality_name", "reports", "patients", "procedures", "share"]
    assert result.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
