"""The queries that SQL can express, on a given table."""

import compare
import pytest

from paceline.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, sf, name):
    rows, connection = QUERIES[name](spark, sf), compare.connection(sf)
    answer = connection.execute(SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(rows.columns)
    assert sorted(answer.fetchall(), key=str) == sorted((tuple(r) for r in rows.select(*columns).collect()), key=str)
