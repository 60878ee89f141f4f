"""The queries SQL can express against their DuckDB text."""

import duckdb
import pytest

from marquee.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert [names[i] for i in order] == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in cursor.fetchall())
