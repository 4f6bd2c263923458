"""Every query runs on the smallest test tables, and equals its SQL where it has any."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings comments posts threads removals mentions price_series attention_events bulk_comments feeds archive_lines csv_lines".split()


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if Path(f"{data}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, data):
    assert entry.entry(spark).count() == 41


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, data, duck, tmp_path, name):
    df = entry.queries()[name](spark, data)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
        return
    df.write.parquet(str(tmp_path / "out"))
    want = duck.execute(sql)
    cols = sorted(d[0] for d in want.description)
    assert cols == sorted(df.columns)
    pick = ", ".join(f'"{c}"' for c in cols)
    sides = [Counter(repr(r) for r in duck.execute(f"select {pick} from {src}").fetchall()) for src in (f"({sql})", f"read_parquet('{tmp_path}/out/*.parquet')")]
    assert sides[0] == sides[1]
