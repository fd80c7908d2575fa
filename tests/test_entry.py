"""Registered queries: names, SQL twins and, for a fast selection, equal rows at the smallest scale.

``VEILFRAME_ALL_QUERIES=1`` compares all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from veilframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
FAST = ("scan_email", "scan_all_types", "check_digits", "placeholder_parse", "policies_sanitized", "site_match",
        "navigation_moves", "generated_scan", "generated_business_scan", "vault_entries")
NAMES = list(QUERIES) if os.environ.get("VEILFRAME_ALL_QUERIES") else FAST


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "type", "detections", "documents"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_the_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)

    def rows(values):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values), key=repr)

    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(cursor.fetchall())
