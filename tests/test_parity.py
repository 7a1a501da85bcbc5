"""Every query against its SQL on the smallest tables."""

import pytest

from parity.all_cases import CASES
from parity.check import difference, oracle
from parity.registry import run

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", list(CASES))
def test_query_equals_sql(spark, con, name):
    got = run(name, spark, SF_DIR).toArrow()
    text = CASES[name].sql
    if text is None:
        assert got.num_rows > 0
    else:
        assert difference(got, con.sql(text).to_arrow_table()) is None
