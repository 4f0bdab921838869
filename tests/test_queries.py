"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from textmill.plans import all_oracles, all_queries


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def test_every_query_has_sql():
    assert set(all_oracles()) == set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, db, sf, name):
    df = all_queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = db.execute(all_oracles()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    expected = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
    assert rows == expected


@pytest.mark.parametrize("name", ["merge_root_parts", "merge_tokenized_files"])
def test_tables_of_several_files(spark, sf, name, tmp_path):
    """A table that is a directory gives the rows of the same table in one file."""
    for other in ("benchmark", "documents"):
        rows = spark.read.parquet(f"{sf}/{other}.parquet")
        rows.repartitionByRange(3, rows.columns[0]).sortWithinPartitions(rows.columns[0]).write.parquet(f"{tmp_path}/{other}.parquet")
    whole, parts = (all_queries()[name](spark, folder) for folder in (sf, str(tmp_path)))
    rows = sorted(map(tuple, whole.collect()))
    assert len(rows) > 200 and sorted(map(tuple, parts.collect())) == rows


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[-1] == "shuffle_pos" and df.count() == 200
