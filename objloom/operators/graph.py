"""Recursive operators: chains, peeling, paths, trees, alternates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objloom.functions.objects import mode_row
from objloom.operators.lineage import cut, union


def resolve_chains(edges: DataFrame, node: str = "node", nxt: str = "next") -> DataFrame:
    """(node, terminal, hops, cycle) of a graph with at most one edge from each node.

    Pointer doubling: after r rounds every node points 2**r steps on, so a
    chain of n steps takes log2(n) rounds, whatever the number of chains.  The
    distances to a terminal have no gaps, so a round that newly ends nothing
    leaves only nodes that lead into cycles.
    """
    state = edges.select(F.col(node).alias("node"), F.col(nxt).alias("at"), F.lit(1).cast("long").alias("hops"), F.lit(False).alias("done"))
    left = None
    while True:
        far = state.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"), F.col("done").alias("far_done"))
        state = state.join(far, "at", "left").select(
            "node",
            F.when(F.col("done") | F.col("to").isNull(), F.col("at")).otherwise(F.col("to")).alias("at"),
            F.when(F.col("done") | F.col("to").isNull(), F.col("hops")).otherwise(F.col("hops") + F.col("more")).alias("hops"),
            (F.col("done") | F.col("to").isNull() | F.col("far_done")).alias("done"),
        )
        state = cut(state)
        now = state.where("NOT done").count()
        if now == 0 or now == left:
            break
        left = now
    return state.select("node", F.when(F.col("done"), F.col("at")).alias("terminal"), F.when(F.col("done"), F.col("hops")).alias("hops"), (~F.col("done")).alias("cycle"))


def peel(starts: DataFrame, types: DataFrame, tags: DataFrame, commits: DataFrame, want: str) -> DataFrame:
    """(id, peeled, error) of starts(id).

    types(id, otype), tags(id, target), commits(id, tree).  Tags are followed
    to their end; to a tree, a commit then gives its tree.  Another type at the
    end is ObjectTypeError; an absent start is ErrObjectNotFound; a tag's
    absent target is ObjectMissingError.
    """
    chains = resolve_chains(tags, "id", "target").select(F.col("node").alias("id"), "terminal")
    ends = starts.join(chains, "id", "left").withColumn("end", F.coalesce("terminal", "id"))
    ends = ends.join(types.select(F.col("id").alias("end"), F.col("otype")), "end", "left").join(commits.select(F.col("id").alias("end"), "tree"), "end", "left")
    # a commit's tree id is taken as it stands, whether or not the tree exists
    peeled = F.when(F.col("otype") == want, F.col("end"))
    if want == "tree":
        peeled = peeled.when(F.col("otype") == "commit", F.col("tree"))
    absent = F.when(F.col("terminal").isNull(), "ErrObjectNotFound").otherwise("ObjectMissingError")
    return ends.select("id", peeled.alias("peeled"), F.when(F.col("otype").isNull(), absent).when(peeled.isNull(), "ObjectTypeError").alias("error"))


def resolve_paths(paths: DataFrame, entries: DataFrame, deepest: int) -> DataFrame:
    """(qid, mode, child, error, at) of paths(qid, tree, parts) by a join for each level.

    entries(tree, name, mode, child).  error is ErrPathInvalid (no segments, or
    an empty one), PathNotFoundError or PathNotTreeError, with the segment's
    index in ``at``.
    """
    bad = (F.size("parts") == 0) | F.array_contains("parts", "")
    state = paths.select("qid", "parts", F.col("tree").alias("cur"), F.lit(None).cast("string").alias("mode"), F.when(bad, "ErrPathInvalid").alias("error"), F.lit(None).cast("int").alias("at"))
    for i in range(deepest):
        step = entries.select(F.col("tree").alias("cur"), F.col("name").alias("seg"), F.col("mode").alias("m"), F.col("child").alias("c"))
        open_ = F.col("error").isNull() & (F.size("parts") > i)
        state = state.withColumn("seg", F.when(open_, F.try_element_at("parts", F.lit(i + 1)))).join(step, ["cur", "seg"], "left")
        error = F.when(F.col("m").isNull(), "PathNotFoundError").when((F.col("m") != "40000") & (F.size("parts") > i + 1), "PathNotTreeError")
        state = state.select(
            "qid", "parts", F.when(open_ & F.col("m").isNotNull(), F.col("c")).otherwise(F.col("cur")).alias("cur"), F.when(open_, F.col("m")).otherwise(F.col("mode")).alias("mode"),
            F.when(open_, error).otherwise(F.col("error")).alias("error"), F.when(open_ & error.isNotNull(), F.lit(i)).otherwise(F.col("at")).alias("at"),
        )
    ok = F.col("error").isNull()
    return state.select("qid", F.when(ok, F.col("mode")).alias("mode"), F.when(ok, F.col("cur")).alias("child"), "error", "at")


def find_entries(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked(…, tree, name) with the mode and child of the entry of that name; a directory comes before a file of the same name."""
    best = entries.groupBy("tree", "name").agg(F.min_by(F.struct("mode", "child"), F.when(F.col("mode") == "40000", 0).otherwise(1)).alias("_e"))
    return asked.join(best, ["tree", "name"], "left").select(*asked.columns, F.col("_e.mode").alias("mode"), F.col("_e.child").alias("child"))


def inserted(entries: DataFrame, new: DataFrame) -> DataFrame:
    """new(tree, seq, mode, name, …) with the error of inserting its rows in order of seq into trees that have entries(tree, name).

    ErrInvalidTree: an empty name, one with NUL or ``/``, or a name that the
    tree has by then, as a file or as a directory; ErrInvalidMode.
    """
    bad = F.when((F.octet_length("name") == 0) | F.contains(F.col("name"), F.lit("/")) | F.contains(F.col("name"), F.lit("\0")) | F.col("name").isNull(), "ErrInvalidTree").otherwise(mode_row(F.col("mode"))["error"])
    rows = new.withColumn("_bad", bad)
    first = rows.where("_bad IS NULL").groupBy("tree", "name").agg(F.min("seq").alias("_first"))
    there = entries.select("tree", "name").distinct().withColumn("_there", F.lit(True))
    rows = rows.join(first, ["tree", "name"], "left").join(there, ["tree", "name"], "left")
    again = F.when(F.col("_there") | (F.col("seq") > F.col("_first")), "ErrInvalidTree")
    return rows.select(*new.columns, F.coalesce("_bad", again).alias("error"))


def _fs_entries(paths: DataFrame, entries: DataFrame, deepest: int) -> DataFrame:
    """resolve_paths of paths(qid, tree, path), where ``.`` is the root itself."""
    valid = F.col("path").rlike(r"\A(?:\.|(?!\.{1,2}(?:/|\z))[^/]+(?:/(?!\.{1,2}(?:/|\z))[^/]+)*)\z")
    inner = paths.where(valid & (F.col("path") != "."))
    found = resolve_paths(inner.select("qid", "tree", F.split("path", "/").alias("parts")), entries, deepest).select("qid", "mode", "child", "error")
    root = paths.where(F.col("path") == ".").select("qid", F.lit("40000").alias("mode"), F.col("tree").alias("child"), F.lit(None).cast("string").alias("error"))
    wrong = paths.where(~valid | F.col("path").isNull()).select("qid", F.lit(None).cast("string").alias("mode"), F.lit(None).cast(entries.schema["child"].dataType).alias("child"), F.lit("ErrInvalidPath").alias("error"))
    return found.unionByName(root).unionByName(wrong)


def read_files(paths: DataFrame, entries: DataFrame, blobs: DataFrame, deepest: int) -> DataFrame:
    """(qid, content, error) of paths(qid, tree, path): ErrIsDirectory, ErrGitlinkNotFile, ErrObjectNotFound, or what the path's resolution says."""
    found = _fs_entries(paths, entries, deepest).join(blobs.select("child", "content"), "child", "left")
    error = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("mode") == "40000", "ErrIsDirectory").when(F.col("mode") == "160000", "ErrGitlinkNotFile")
        .when(F.col("content").isNull(), "ErrObjectNotFound")
    )
    return found.select("qid", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def subtrees(paths: DataFrame, entries: DataFrame, deepest: int) -> DataFrame:
    """(qid, tree, error) of paths(qid, tree, path): the tree that a file system rooted there has; ErrInvalidPath for what isn't a directory."""
    found = _fs_entries(paths, entries, deepest)
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("mode") != "40000", "ErrInvalidPath")
    return found.select("qid", F.when(error.isNull(), F.col("child")).alias("tree"), error.alias("error"))


def flatten(roots: DataFrame, entries: DataFrame, deepest: int = 4096) -> DataFrame:
    """(root, path, mode, child) of everything below roots(root), level by level.

    A tree that holds itself can't exist among real ids, but a made-up table
    may have one: beyond ``deepest`` levels ErrTreeTooDeep is raised.
    """
    level = roots.select("root", F.col("root").alias("tree"), F.lit("").alias("prefix"))
    parts = []
    while True:
        found = cut(level.join(entries, "tree").select("root", F.concat("prefix", "name").alias("path"), "mode", "child"))
        parts.append(found)
        level = found.where("mode = '40000'").select("root", F.col("child").alias("tree"), F.concat("path", F.lit("/")).alias("prefix"))
        if level.isEmpty():
            return union(parts)
        if len(parts) >= deepest:
            raise ValueError("ErrTreeTooDeep")


def alternates_closure(edges: DataFrame, start: str, most: int = 5) -> DataFrame:
    """(path, depth) of the stores reached from one by edges(src, dst), each once, at most ``most`` deep, without itself."""
    seen = edges.sparkSession.createDataFrame([(start, 0)], "path string, depth int")
    front = seen
    for d in range(1, most + 1):
        front = front.join(edges, front["path"] == edges["src"]).select(F.col("dst").alias("path")).distinct().join(seen, "path", "left_anti").withColumn("depth", F.lit(d))
        front = cut(front)
        seen = seen.unionAll(front)
        if front.isEmpty():
            break
    return seen.where(F.col("path") != start)
