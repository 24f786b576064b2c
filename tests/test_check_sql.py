"""Every registered query gives the rows of its SQL."""

import numbers

import pandas as pd
import pytest

from quillmere.plans.catalog import QUERIES, SQL


def _rows(frame: pd.DataFrame) -> list[tuple]:
    def text(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "null"
        return repr(float(value)) if isinstance(value, numbers.Number) and not isinstance(value, bool) else str(value)

    columns = sorted(frame.columns)
    return sorted(tuple(text(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    wanted = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert _rows(got) == _rows(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
