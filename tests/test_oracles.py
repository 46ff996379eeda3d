"""Every query with DuckDB SQL gives the same rows on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"


def norm(rows):
    def cell(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return str(x)
        return "nan" if isinstance(x, float) and math.isnan(x) else f"{float(x):.9g}"

    return sorted(tuple(cell(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == columns
    got = norm(tuple(r[c] for c in columns) for r in df.collect())
    assert got == norm(tuple(r[i] for i in order) for r in want.fetchall())
