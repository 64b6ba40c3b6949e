"""Every query of the library against DuckDB, and the driver's entry points."""

import os
import shutil
import subprocess
import sys
import zlib

import duckdb
import pytest

from objloom.queries.registry import QUERIES, SQL

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    rows = sorted((tuple(map(plain, r)) for r in df.collect()), key=str)
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
        columns = ", ".join(f'"{c}"' for c in df.columns)
        assert rows == sorted(con.execute(f"SELECT {columns} FROM ({SQL[name]})").fetchall(), key=str)


def test_adler32_of_every_document(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {r.doc_id: r.adler32 for r in QUERIES["adler32_documents"](spark, tiny).collect()}
    assert got == {i: None if t is None else zlib.adler32(t.encode()) for i, t in texts.items()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_imports_alone(tmp_path):
    """Without the optional subpackage and the pipeline, everything else is there."""
    for x in ("objloom", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{HERE}/{x}") else shutil.copy)(f"{HERE}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "objloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tree_oid' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
