"""Cutting lineage in iterative operators, and the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one in the warehouse, which is shared too, where that is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/objloom-shared")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Parts:
    """Rows that come in many small steps, kept as few tables.

    ``WIDTH`` tables of one rank are written together as one of the next, so
    after n steps there are at most WIDTH * log(n) tables and a row has been
    written again log(n) times, not n.
    """

    WIDTH = 8

    def __init__(self) -> None:
        self.ranks: list[list[DataFrame]] = []

    def add(self, df: DataFrame, rank: int = 0) -> None:
        if len(self.ranks) == rank:
            self.ranks.append([])
        own = self.ranks[rank]
        own.append(df)
        if len(own) == self.WIDTH:
            self.ranks[rank] = []
            tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            self.add(cut(union(own).coalesce(tasks)), rank + 1)

    def all(self) -> DataFrame:
        return union([df for own in self.ranks for df in own])
