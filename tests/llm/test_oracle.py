import duckdb
import pytest

from objloom.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows_as_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    df = queries.queries()[name](spark, tiny)
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle.SQL[name]})")
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
