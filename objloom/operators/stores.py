"""Object stores as DataFrames: (object_format, oid, otype, size, content), and what reads and writes of them mean."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objloom.functions import objects as O
from objloom.operators import lineage


def with_ids(contents: DataFrame, content: Column, otype: str = "blob", fmt: str = "sha1") -> DataFrame:
    """contents with object_format, oid, otype and size of the content."""
    return contents.withColumns({"object_format": F.lit(fmt), "oid": O.oid(otype, content, fmt), "otype": F.lit(otype), "size": F.octet_length(content).cast("long")})


def deduplicated(objects: DataFrame) -> DataFrame:
    """One row for each (format, id).  Objects of one id are equal, so any row will do; only keys and one row per task are shuffled."""
    return objects.dropDuplicates(["object_format", "oid"])


def first_hit(stores: DataFrame, key: list[str], priority: str = "priority") -> DataFrame:
    """Of the rows of each key, that of the least priority: a chain of stores.

    An aggregation, so rows are reduced before they are shuffled; a window
    would move them all.
    """
    rest = [c for c in stores.columns if c not in key]
    best = stores.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(priority)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def chained(stores: list[DataFrame], key: list[str]) -> DataFrame:
    """first_hit over a list of stores, the first of which comes first."""
    marked = [s.withColumn("priority", F.lit(i)) for i, s in enumerate(stores)]
    out = marked[0]
    for s in marked[1:]:
        out = out.unionByName(s)
    return first_hit(out, key)


def dual(objects: DataFrame, packs: DataFrame) -> DataFrame:
    """The view of a store with an object side and a pack side."""
    return objects.withColumn("side", F.lit("object")).unionByName(packs.withColumn("side", F.lit("pack")), allowMissingColumns=True)


def lookup(ids: DataFrame, objects: DataFrame, key: list[str]) -> DataFrame:
    """ids with the object of each, and status found or missing."""
    found = ids.join(objects.withColumn("_found", F.lit(True)), key, "left")
    return found.withColumn("status", F.when(F.col("_found"), "found").otherwise("missing")).drop("_found")


def missing(ids: DataFrame, objects: DataFrame, key: list[str]) -> DataFrame:
    return ids.select(*key).distinct().join(objects, key, "left_anti")


def exact(ids: DataFrame, objects: DataFrame, want: str, key: list[str]) -> DataFrame:
    """Lookup with a type assertion: error is ErrObjectNotFound, ObjectTypeError or null."""
    found = lookup(ids, objects, key)
    return found.withColumn("error", F.when(F.col("status") == "missing", "ErrObjectNotFound").when(F.col("otype") != want, "ObjectTypeError"))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A store's table, None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def write(objects: DataFrame, path: str, fmt: str = "sha1") -> DataFrame:
    """Content-addressed append to a Parquet store: known ids are left alone.  Gives the store after it."""
    spark = objects.sparkSession
    new = deduplicated(with_ids(objects, F.col("content"), fmt=fmt).select("object_format", "oid", "otype", "size", "content"))
    known = stored(spark, path)
    if known is not None:
        new = new.join(known.select("object_format", "oid"), ["object_format", "oid"], "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_full(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Framed bytes to (otype, size, content, error): the header must agree with the content."""
    return raw.withColumn("_h", O.parse_header(F.col(column))).select("*", "_h.otype", "_h.size", F.col("_h.body").alias("content"), "_h.error").drop("_h")


def within_size(objects: DataFrame, most: int) -> DataFrame:
    """objects with error ErrObjectTooLarge where size exceeds most; no limit if most <= 0."""
    return objects.withColumn("error", F.when(F.lit(most > 0) & (F.col("size") > most), "ErrObjectTooLarge"))


# -- routing: an object side and a pack side

def routed(rows: DataFrame) -> dict[str, DataFrame]:
    """Writes of a dual store: rows(kind, …) of loose objects go to the object side, packs to the pack side."""
    return {"object": rows.where("kind = 'object'").drop("kind"), "pack": rows.where("kind = 'pack'").drop("kind")}


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Quarantine:
    """Objects staged in a folder beside the store: readable at once with the store behind them, published by promote, dropped by discard.

    A promote that is cut short and repeated adds what is still lacking, as
    known ids are left alone; the staged rows go only after that.
    """

    def __init__(self, store: DataFrame, path: str) -> None:
        self.store, self.path, self.staging = store, path, f"{path.rstrip('/')}-quarantine-{uuid.uuid4().hex}"
        self.spark = store.sparkSession

    def add(self, objects: DataFrame) -> None:
        objects.select(self.store.columns).write.mode("append").parquet(self.staging)

    @property
    def staged(self) -> DataFrame | None:
        return stored(self.spark, self.staging)

    def view(self) -> DataFrame:
        staged = self.staged
        return self.store if staged is None else chained([staged.select(self.store.columns), self.store], ["object_format", "oid"]).select(self.store.columns)

    def promote(self) -> None:
        staged = self.staged
        if staged is not None:
            known = stored(self.spark, self.path)
            new = deduplicated(staged)
            new = new if known is None else new.join(known.select("object_format", "oid"), ["object_format", "oid"], "left_anti")
            new.write.mode("append").parquet(self.path)
        self.discard()

    def discard(self) -> None:
        _remove(self.spark, self.staging)


class PackQuarantine:
    """Packs ingested into a folder apart: readable with the packs behind them, published by promote, dropped by discard."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "sha1") -> None:
        self.spark, self.path, self.fmt = spark, path, fmt
        self.staging = f"{path.rstrip('/')}-quarantine-{uuid.uuid4().hex}"

    def ingest(self, files: DataFrame, external: DataFrame | None = None, max_size: int = 0) -> DataFrame:
        from objloom.operators import packs

        return packs.ingest(files, self.staging, self.fmt, max_size, external)

    def view(self, name: str = "objects") -> DataFrame:
        """A table of the staged packs and of those published that aren't staged."""
        from objloom.operators import packs

        parts = [packs.published(self.spark, p, name) for p in (self.staging, self.path) if packs.manifest(self.spark, p).limit(1).count()]
        if not parts:
            raise ValueError("no packs, staged or published")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].join(parts[0].select("pack").distinct(), "pack", "left_anti"))

    def promote(self) -> None:
        """The tables of the packs that the store lacks, and last the manifest, under the run that staged them."""
        from objloom.operators import packs

        made = packs.manifest(self.spark, self.staging)
        if made.limit(1).count():
            new = made.join(packs.manifest(self.spark, self.path).select("pack"), "pack", "left_anti")
            for name in packs.TABLES:
                self.spark.read.parquet(f"{self.staging}/{name}").join(new.select("pack", "run"), ["pack", "run"], "left_semi").write.mode("append").parquet(f"{self.path}/{name}")
            # read before it is written to
            rows = lineage.cut(new.select("pack", "objects", "object_format", "received", "run"))
            rows.write.mode("append").parquet(f"{self.path}/manifest")
        self.discard()

    def discard(self) -> None:
        _remove(self.spark, self.staging)


class CoordinatedQuarantine:
    """An object and a pack quarantine as one: both are promoted, or discarded, and what fails in one doesn't keep the other."""

    def __init__(self, objects: Quarantine, packs: PackQuarantine) -> None:
        self.objects, self.packs = objects, packs

    def view(self) -> DataFrame:
        own = ["oid", "otype", "content"]
        return dual(self.objects.view().select(own), self.packs.view().select(own))

    def _both(self, action: str) -> None:
        errors = []
        for part in (self.objects, self.packs):
            try:
                getattr(part, action)()
            except Exception as e:  # joined below
                errors.append(e)
        if errors:
            raise ExceptionGroup(action, errors)

    def promote(self) -> None:
        self._both("promote")

    def discard(self) -> None:
        self._both("discard")
