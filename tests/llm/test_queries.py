"""Every training-data query over the smallest tables, against its SQL where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

from check_oracle import compare, connect

from citeweave.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    said = compare(connect(FOLDER), spark, FOLDER, name)
    assert said.startswith("ok" if name in queries.oracle_sql() else "rows only")
