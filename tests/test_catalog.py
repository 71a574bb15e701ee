import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import compare  # noqa: E402

from vellum.catalog import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        compare(df, ORACLE_SQL[name], SF)
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
