"""Every query of the book operators against its DuckDB SQL on the smallest tables."""

from numbers import Real

import duckdb
import pandas as pd
import pytest

from booktext.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, Real) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(show, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_flagship(spark):
    got = QUERIES["text_books"](spark, SF)
    assert got.columns == ["book_id", "text", "n_lines"] and got.count() > 0
