"""The registry, and a sample of queries against DuckDB on the smallest tables."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["state_at_latest_listed", "normalise_states", "phrase_hits", "repair_headings", "assemble_prompts", "final_attempt", "job_run_status"]


def test_registry():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 140


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "documents", "events", "part", "benchmark", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = collections.Counter(tuple(r[i] for i in at) for r in cur.fetchall())
    assert collections.Counter(map(tuple, df.select(*cols).collect())) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
