"""Repository-level plans: format checks, effective configuration, and the read path from a name to an object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from objloom.functions import config as cfg
from objloom.operators import graph, stores
from objloom.operators import refs as R

#: Extensions that only version 1 may have, and those that any version may have.
V1_ONLY = ("noop-v1", "objectformat", "compatobjectformat", "refstorage", "relativeworktrees", "submodulepathconfig")
ANY = ("noop", "partialclone", "preciousobjects", "worktreeconfig")


def last_values(entries: DataFrame) -> DataFrame:
    """The last entry of each (section, subsection, key): a value is missing, valueless or a string, never null."""
    return entries.groupBy("section", "subsection", "key").agg(F.max_by(F.struct("kind", "value"), F.struct("source_ord", "ord")).alias("v")).select("section", "subsection", "key", "v.kind", "v.value")


def all_values(entries: DataFrame) -> DataFrame:
    """Every value of each key, in order."""
    rows = F.array_sort(F.collect_list(F.struct("source_ord", "ord", "value")))
    return entries.groupBy("section", "subsection", "key").agg(F.transform(rows, lambda r: r["value"]).alias("all_values"))


def merged(*configs: DataFrame) -> DataFrame:
    """Configurations one after another; later ones win."""
    out = None
    for i, c in enumerate(configs):
        c = c.withColumn("source_ord", F.lit(i).cast("long"))
        out = c if out is None else out.unionByName(c)
    return out


def effective(common: DataFrame, worktree: DataFrame) -> DataFrame:
    """The worktree's configuration over the common one, if extensions.worktreeconfig is true."""
    on = last_values(common.withColumn("source_ord", F.lit(0).cast("long"))).where("section = 'extensions' AND key = 'worktreeconfig'").where(cfg.bool_column(F.col("kind"), F.col("value")))
    return merged(common, worktree.join(F.broadcast(on.select(F.lit(1).alias("_on")).limit(1)), F.lit(True), "left_semi"))


def extension_error(version: Column, name: Column, value: Column) -> Column:
    """What is wrong with a repository's extension under its format version; null if nothing is."""
    return (
        F.when(~version.isin(0, 1), "ErrConfig: version")
        .when((version == 0) & name.isin(*V1_ONLY), "ErrConfig: needs version 1")
        .when(name == "compatobjectformat", "ErrConfig: unsupported")
        .when((version == 1) & ~name.isin(*V1_ONLY, *ANY), "ErrConfig: unknown extension")
        .when((name == "objectformat") & ~value.isin("sha1", "sha256"), "ErrConfig: object format")
        .when((name == "refstorage") & (value != "files"), "ErrConfig: reference storage")
    )


def read_path(refs: DataFrame, wanted: DataFrame, types: DataFrame, tags: DataFrame, commits: DataFrame, entries: DataFrame, deepest: int) -> DataFrame:
    """(qid, mode, child, error) of wanted(qid, name, parts): name to id, peeled to a tree, then along the path."""
    ends = R.resolve_symbolic(refs).select("name", "target_id", F.col("error").alias("ref_error"))
    start = wanted.join(ends, "name", "left")
    trees = graph.peel(start.select(F.col("target_id").alias("id")).where("id IS NOT NULL").distinct(), types, tags, commits, "tree").withColumnsRenamed({"id": "target_id", "error": "peel_error"})
    start = start.join(trees, "target_id", "left").withColumn("early", F.coalesce("ref_error", "peel_error", F.when(F.col("target_id").isNull(), "ErrReferenceNotFound")))
    found = graph.resolve_paths(start.where("early IS NULL").select("qid", F.col("peeled").alias("tree"), "parts"), entries, deepest)
    return found.select("qid", "mode", "child", "error").unionByName(start.where("early IS NOT NULL").select("qid", F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("child"), F.col("early").alias("error")))


def object_chain(loose: DataFrame, packed: DataFrame, alternates: DataFrame | None = None) -> DataFrame:
    """The object that a repository reads for each id, with the store it comes from.

    loose and packed are the repository's own objects(object_format, oid, …);
    alternates(…, path, depth, side) those of the stores it borrows from, as
    alternates_closure orders them.  Own loose objects come first, then own
    packed ones, then each alternate's loose and packed ones, the nearest first.
    """
    own = loose.columns
    rows = loose.withColumns({"store": F.lit("loose"), "_at": F.lit(0).cast("long")}).unionByName(packed.select(own).withColumns({"store": F.lit("packed"), "_at": F.lit(1).cast("long")}))
    if alternates is not None:
        order = alternates.select("path", "depth").distinct().withColumn("_k", F.row_number().over(W.orderBy("depth", "path")))  # a repository's few alternates
        far = alternates.join(F.broadcast(order.select("path", "_k")), "path").withColumn("_at", (F.col("_k") * 2 + F.when(F.col("side") == "packed", 1).otherwise(0)).cast("long"))
        rows = rows.unionByName(far.select(*own, F.concat_ws(":", "path", "side").alias("store"), "_at"))
    return stores.first_hit(rows, ["object_format", "oid"], "_at").drop("_at")


def string_value(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked(section, subsection, key) with value and error: ErrMissing for no entry, ErrValueless for one without a value."""
    last = last_values(entries)
    got = asked.join(last, ["section", "subsection", "key"], "left").withColumn("_s", cfg.string_struct(F.col("kind"), F.col("value")))
    return got.select(*asked.columns, F.col("_s.value").alias("value"), F.col("_s.error").alias("error"))
