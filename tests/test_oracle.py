"""Every core query against its oracle SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from cohortshift.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda v: "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["SRC-01", "SRC-03", "SRC-08", "SNK-03", "SNK-09", "DED-01", "SMP-09", "DRF-13", "DRF-14", "ST-03", "ST-09", "ST-10", "VIZ-02"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
