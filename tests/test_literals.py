"""Every small query gives the rows of its SQL."""

from __future__ import annotations

import duckdb
import pytest

from tests import literals
from tests.test_queries import plain


@pytest.mark.parametrize("name", sorted(literals.CATALOG.sql))
def test_rows_equal_sql(spark, name):
    df = literals.CATALOG.queries[name](spark, "")
    columns = sorted(df.columns)
    result = duckdb.connect().execute(literals.CATALOG.sql[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
