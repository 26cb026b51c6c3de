"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import catalog, distributed, further  # noqa: F401  these register their queries
from lodestone.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (float, int)) and abs(a - b) < 2e-5)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(catalog.SQL[name])
    assert sorted(found.columns) == columns
    theirs = sorted((tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert all(same(x, y) for a, b in zip(ours, theirs) for x, y in zip(a, b))


def test_what_has_no_sql():
    """These are learned; test_further and test_distributed hold them to held-out predictions and to a plain fit."""
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"stacked_predictions", "encoder_out_of_fold"}


def test_stacked_predictions(spark):
    got = catalog.QUERIES["stacked_predictions"](spark, FOLDER).collect()
    assert len(got) == 1500 and {r.prediction for r in got} <= {0, 1, 2, 3}


def test_entry_has_rows(spark):
    import __spark_entry__

    if not Path(FOLDER).exists():
        pytest.skip("no tables")
    df = __spark_entry__.entry(spark)
    assert df.columns == ["participant_id", "item_id", "n_windows", "pack"] and df.count() > 0
