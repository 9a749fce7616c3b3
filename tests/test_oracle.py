"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, con, name):
    assert check(spark, con, SMALL, name, entry.queries(), entry.oracle_sql()) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["batch_idx", "pos_in_batch", "index"]
