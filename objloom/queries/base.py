"""Registering queries, and tables that several of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objloom.functions import objects as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(spark: SparkSession, sf_dir: str, fmt: str = "sha1") -> DataFrame:
    """documents as blobs: doc_id, lang, content, oid (hexadecimal)."""
    content = O.utf8(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", content.alias("content"), O.oid_hex("blob", content, fmt).alias("oid"))


#: DuckDB: a blob's identifier, for a text column.
BLOB_OID = "sha1(encode('blob ' || octet_length(encode({0}))) || '\\x00'::BLOB || encode({0}))"
BLOB_OID_256 = "sha256(encode('blob ' || octet_length(encode({0}))) || '\\x00'::BLOB || encode({0}))"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The same rows as SQL."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        return str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"
