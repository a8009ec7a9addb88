"""Every query against its SQL oracle on the same parquet tables."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_oracle(name, spark, sf_dir, duck):
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(rounded(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
