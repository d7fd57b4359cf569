"""Every registered query of the temporal engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from chronoweave.plans import catalog

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def shown(df):
    cols = sorted(df.columns)
    return df[cols].map(lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, sql, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        want = sql.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert shown(got).equals(shown(want))
    else:
        assert len(got)
