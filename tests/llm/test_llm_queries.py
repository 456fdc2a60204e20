"""Every query of the subpackage runs over whole tables; those with SQL give its rows."""

import pytest
from oracle import same

from lithoflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.ORACLE_SQL:
        same(df, queries.ORACLE_SQL[name], data)
    else:
        assert df.columns and df.count() > 0
