"""Every address query against its SQL twin."""

from functools import cache

import duckdb
import pytest

from addrweave.plans import queries
from addrweave.plans.queries import QUERIES
from addrweave.plans.sql import ORACLE_SQL

from .conftest import SF


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in ("customer", "orders"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.fixture(scope="module", autouse=True)
def matched_once():
    """Queries that report on the same candidates share one match."""
    with pytest.MonkeyPatch.context() as patch:
        for name in ("_top", "_scored"):
            patch.setattr(queries, name, cache(getattr(queries, name)))
        yield


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, tables, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), tables.execute(ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert plain(mine).equals(plain(theirs))


def test_documents(spark):
    rows = QUERIES["match_documents"](spark, SF).collect()
    assert len(rows) == 1500 and all(r["document"].startswith("{") for r in rows)
