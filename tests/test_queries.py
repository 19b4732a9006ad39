"""Every registered query of the engine against its DuckDB twin."""

import oracle
import pytest

from lodestone.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    if name in catalogue.ORACLE_SQL:
        assert oracle.compare(df, catalogue.ORACLE_SQL[name], FOLDER) == ""
    else:
        assert df.count() >= 0
