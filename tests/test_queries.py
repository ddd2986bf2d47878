"""Each catalogue query against its SQL, and the driver's entry points."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from foldspar.plans import catalogue
from foldspar.sources import tables


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, folder, duck, name):
    df = catalogue.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows
    if name in catalogue.ORACLES:
        got = duck.execute(catalogue.ORACLES[name])
        at = [[d[0] for d in got.description].index(c) for c in columns]
        assert rows == sorted((tuple(norm(r[i]) for i in at) for r in got.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("fmt", tables.FORMATS)
def test_round_trip_of_formats(spark, folder, tmp_path, fmt):
    df = tables.table(spark, folder, "nation")
    tables.write(df, str(tmp_path / "x"), fmt)
    back = tables.read(spark, str(tmp_path / "x"), fmt, "n_nationkey int, n_name string, n_regionkey int")
    assert sorted(back.collect()) == sorted(df.collect())


def test_formats_are_checked(spark):
    with pytest.raises(ValueError):
        tables.read(spark, "x", "avro")
    with pytest.raises(ValueError):
        tables.read(spark, "x", "csv")
