"""The registered queries against their DuckDB twins on the smallest tables
(a subset; tools/oracle_check.py runs all of them)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from conftest import SF_SMALL  # noqa: E402

FAST = ["tokens_with_offsets", "markup_runs", "spans_decoded", "initials_shifted", "name_pair_key",
        "persons_numbered", "redacted_markup", "ledger_resolved", "case_sessions", "roster_json",
        "golden_rollup", "span_metrics", "admission", "stream_throughput", "ledger_subset", "parts_numbered",
        "parts_numbered_case", "roster_sorted"]


@pytest.fixture(scope="module")
def con():
    import duckdb
    from oracle_check import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    from oracle_check import digest

    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]


def test_every_query_has_oracle_and_entry_runs(spark):
    import __spark_entry__ as E
    from redactum.plans import catalog

    # queries of the optional subpackage may have no SQL
    assert set(catalog.QUERIES) <= set(E.oracle_sql()) <= set(E.queries())
    df = E.entry(spark)
    assert df.count() > 0
