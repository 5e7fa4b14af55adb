"""Every query of the entry point that has SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from parley.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cur = db.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    text = lambda get: sorted(str([repr(float(v)) if isinstance(v := get(r, c), float) else v for c in sorted(columns)]) for r in get.rows)

    class Want:
        rows = cur.fetchall()

        def __call__(self, r, c):
            return r[columns.index(c)]

    class Got:
        rows = df.collect()

        def __call__(self, r, c):
            return r[c]

    assert text(Got()) == text(Want())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_adjacent_grouping_reads_all_rows_and_texts(spark, monkeypatch):
    from parley import queries

    kept, read = [], queries.readers.read_csv
    monkeypatch.setattr(queries.readers, "read_csv", lambda *a: kept.append(read(*a)) or kept[-1])
    queries.csv_adjacent_grouping(spark, SF)
    got = [(int(r.input_id), m["id"], m["value"]) for r in kept[0].collect() for m in r.messages]
    clean = lambda v: v.replace("\r\n", "\n").replace("\r", "\n")
    want = [(r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert sorted((c, t, clean(v)) for c, t, v in got) == sorted((c, t, clean(v)) for c, t, v in want)
