from __future__ import annotations

import pytest

from loomstead import catalogue
from tests.oracle import connect, differs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_agrees_with_duckdb(spark, duck, name):
    assert differs(catalogue.queries()[name](spark, SF), duck, catalogue.oracle_sql()[name]) == ""
