"""Registered queries against their check SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from tools.check_queries import bag

FOLDER = "/root/testdata/sf0.001"
KEYS = [
    "B09_B10_B11_B12_B13_built_candidates", "A01_A02_commune_bands", "G12_G15_located_requests",
    "J09_J10_J11_J12_J13_J14_area_fetch", "J16_J19_attempt_trace", "V13_V14_V15_V16_values", "C12_E10_lead_facts",
    "K04_publication_gates",
]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
@pytest.mark.parametrize("key", KEYS)
def test_matches_check_sql(spark, key):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[key](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[key])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.columns, df.collect()) == bag(columns, cursor.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
