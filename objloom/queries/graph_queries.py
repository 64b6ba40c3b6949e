"""Recursive operators: peeling, paths, trees, symbolic references, alternates, delta chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from objloom.operators import graph, packs, refs
from objloom.plans import repository
from objloom.queries.base import query, table

# Tags are orders: order k tags order k-1 while k isn't a multiple of 4, else an object by k's remainder.
_TAGS = """
WITH RECURSIVE tags AS (SELECT 't' || o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN 't' || (o_orderkey - 1) WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'b' || o_custkey ELSE 'r' || o_custkey END AS target FROM orders),
types AS (SELECT id, 'tag' AS otype FROM tags UNION ALL SELECT 'c' || c_custkey, 'commit' FROM customer UNION ALL SELECT 'b' || c_custkey, 'blob' FROM customer UNION ALL SELECT 'r' || c_custkey, 'tree' FROM customer WHERE c_custkey % 5 <> 0),
walk(id, cur) AS (SELECT id, target FROM tags UNION ALL SELECT walk.id, tags.target FROM walk JOIN tags ON walk.cur = tags.id),
ends AS (SELECT walk.id, walk.cur, types.otype FROM walk LEFT JOIN types ON walk.cur = types.id WHERE types.otype IS NULL OR types.otype <> 'tag')
"""


def _universe(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    tag = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    tags = o.select(tag("t", k).alias("id"), F.when(k % 4 != 0, tag("t", k - 1)).when(k % 3 == 0, tag("c", cust)).when(k % 3 == 1, tag("b", cust)).otherwise(tag("r", cust)).alias("target"))
    key = F.col("c_custkey")
    types = tags.select("id", F.lit("tag").alias("otype")).unionAll(c.select(tag("c", key), F.lit("commit"))).unionAll(c.select(tag("b", key), F.lit("blob"))).unionAll(c.where("c_custkey % 5 <> 0").select(tag("r", key), F.lit("tree")))
    commits = c.select(tag("c", key).alias("id"), tag("r", key).alias("tree"))
    return tags, types, commits


def _peel(want: str, good: str) -> str:
    return _TAGS + f"SELECT id, {good} AS peeled, CASE WHEN otype IS NULL THEN 'ObjectMissingError' WHEN {good} IS NULL THEN 'ObjectTypeError' END AS error FROM ends"


def _peeled(spark, sf_dir, want):
    tags, types, commits = _universe(spark, sf_dir)
    return graph.peel(tags.select("id"), types, tags, commits, want)


@query(_peel("commit", "CASE WHEN otype = 'commit' THEN cur END"))
def peel_to_commit(spark, sf_dir):
    return _peeled(spark, sf_dir, "commit")


@query(_peel("tree", "CASE WHEN otype = 'commit' THEN 'r' || substr(cur, 2) WHEN otype = 'tree' THEN cur END"))
def peel_to_tree(spark, sf_dir):
    return _peeled(spark, sf_dir, "tree")


@query(_peel("blob", "CASE WHEN otype = 'blob' THEN cur END"))
def peel_to_blob(spark, sf_dir):
    return _peeled(spark, sf_dir, "blob")


@query(_TAGS + "SELECT otype, count(*)::BIGINT AS n FROM ends WHERE otype <> 'commit' GROUP BY otype")
def peel_type_error(spark, sf_dir):
    tags, types, commits = _universe(spark, sf_dir)
    bad = graph.peel(tags.select("id"), types, tags, commits, "commit").where("error = 'ObjectTypeError'").select("id")
    ends = graph.resolve_chains(tags, "id", "target").select(F.col("node").alias("id"), "terminal")
    return bad.join(ends, "id").join(types.withColumnRenamed("id", "terminal"), "terminal").groupBy("otype").agg(F.count("*").alias("n"))


# A tree of three levels: root / region / nation / customer.
_ENTRIES = """
entries AS (SELECT 'root' AS tree, r_name AS name, '40000' AS mode, 'R' || r_regionkey AS child FROM region
UNION ALL SELECT 'R' || n_regionkey, n_name, '40000', 'N' || n_nationkey FROM nation
UNION ALL SELECT 'N' || c_nationkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN '100755' ELSE '100644' END, 'C' || c_custkey FROM customer)
"""


def _entries(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    tag = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    mode = F.when(F.col("c_custkey") % 5 == 0, "100755").otherwise("100644")
    return (
        r.select(F.lit("root").alias("tree"), F.col("r_name").alias("name"), F.lit("40000").alias("mode"), tag("R", "r_regionkey").alias("child"))
        .unionAll(n.select(tag("R", "n_regionkey"), "n_name", F.lit("40000"), tag("N", "n_nationkey")))
        .unionAll(c.select(tag("N", "c_nationkey"), "c_name", mode, tag("C", "c_custkey")))
    )


_PARTS = """CASE c_custkey % 6 WHEN 0 THEN [r_name, n_name, c_name] WHEN 1 THEN [r_name, n_name] WHEN 2 THEN [r_name, 'nowhere', c_name] WHEN 3 THEN [r_name, n_name, c_name, 'below'] WHEN 4 THEN [r_name, '', c_name] ELSE [r_name, n_name, 'nobody'] END"""


@query(f"""WITH q AS (SELECT c_custkey AS qid, r_name, n_name, c_name, n_nationkey, c_custkey, c_custkey % 6 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT qid, CASE k WHEN 0 THEN CASE WHEN qid % 5 = 0 THEN '100755' ELSE '100644' END WHEN 1 THEN '40000' END AS mode, CASE k WHEN 0 THEN 'C' || c_custkey WHEN 1 THEN 'N' || n_nationkey END AS child,
CASE k WHEN 2 THEN 'PathNotFoundError' WHEN 3 THEN 'PathNotTreeError' WHEN 4 THEN 'ErrPathInvalid' WHEN 5 THEN 'PathNotFoundError' END AS error, CASE k WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 2 END::INT AS at FROM q""")
def path_resolve(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    q = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k, R_, N_, C_ = F.col("c_custkey") % 6, F.col("r_name"), F.col("n_name"), F.col("c_name")
    parts = F.when(k == 0, F.array(R_, N_, C_)).when(k == 1, F.array(R_, N_)).when(k == 2, F.array(R_, F.lit("nowhere"), C_)).when(k == 3, F.array(R_, N_, C_, F.lit("below"))).when(k == 4, F.array(R_, F.lit(""), C_)).otherwise(F.array(R_, N_, F.lit("nobody")))
    return graph.resolve_paths(q.select(F.col("c_custkey").alias("qid"), F.lit("root").alias("tree"), parts.alias("parts")), _entries(spark, sf_dir), 4)


@query(f"""WITH RECURSIVE {_ENTRIES}, f(path, mode, child) AS (SELECT name, mode, child FROM entries WHERE tree = 'root' UNION ALL SELECT f.path || '/' || name, e.mode, e.child FROM f JOIN entries e ON e.tree = f.child AND f.mode = '40000')
SELECT path, mode, child FROM f""")
def tree_flatten(spark, sf_dir):
    root = spark.createDataFrame([("root",)], "root string")
    return graph.flatten(root, _entries(spark, sf_dir)).select("path", "mode", "child")


@query(f"""WITH RECURSIVE {_ENTRIES}, f(path, mode, child) AS (SELECT name, mode, child FROM entries WHERE tree = 'root' UNION ALL SELECT f.path || '/' || name, e.mode, e.child FROM f JOIN entries e ON e.tree = f.child AND f.mode = '40000')
SELECT path, mode = '40000' AS is_dir, CASE WHEN mode LIKE '100%' THEN c_custkey * 10 END AS size FROM f LEFT JOIN customer ON f.child = 'C' || c_custkey""")
def tree_stat(spark, sf_dir):
    root = spark.createDataFrame([("root",)], "root string")
    sizes = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("child"), (F.col("c_custkey") * 10).alias("size"))
    found = graph.flatten(root, _entries(spark, sf_dir)).join(sizes, "child", "left")
    return found.select("path", (F.col("mode") == "40000").alias("is_dir"), F.when(F.col("mode").startswith("100"), F.col("size")).alias("size"))


@query(f"WITH {_ENTRIES} SELECT name, mode FROM entries WHERE tree = 'N3' ORDER BY encode(name || CASE WHEN mode = '40000' THEN '/' ELSE '' END) LIMIT 5 OFFSET 2")
def read_dir_page(spark, sf_dir):
    from objloom.functions.objects import tree_key, utf8

    page = _entries(spark, sf_dir).where("tree = 'N3'").orderBy(tree_key(utf8(F.col("name")), F.col("mode")))
    return page.offset(2).limit(5).select("name", "mode")  # a page is what the operator is for


# Symbolic references: alias k points to alias k*3+1 mod n where k isn't a multiple of 5, which has cycles.
_SYMREFS = """
WITH RECURSIVE n AS (SELECT count(*)::BIGINT AS n FROM customer),
refs AS (SELECT 'refs/alias/' || c_custkey AS name, CASE WHEN c_custkey % 5 = 0 THEN 'direct' ELSE 'symbolic' END AS kind, CASE WHEN c_custkey % 5 = 0 THEN sha1(c_name) END AS target_id, CASE WHEN c_custkey % 5 <> 0 THEN 'refs/alias/' || ((c_custkey * 3 + 1) % (n + 20) + 1) END AS target_name FROM customer, n),
walk(name, cur, path, cycle) AS (SELECT name, name, [name], FALSE FROM refs UNION ALL SELECT walk.name, refs.target_name, list_append(path, refs.target_name), list_contains(path, refs.target_name) FROM walk JOIN refs ON walk.cur = refs.name WHERE kind = 'symbolic' AND NOT cycle),
ends AS (SELECT walk.name, walk.cur, walk.cycle, r.target_id FROM walk LEFT JOIN refs r ON r.name = walk.cur WHERE walk.cycle OR r.kind IS NULL OR r.kind = 'direct')
"""


def symrefs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = c.count()
    key, fifth = F.col("c_custkey"), F.col("c_custkey") % 5 == 0
    name = lambda x: F.concat(F.lit("refs/alias/"), x.cast("string"))
    return c.select(
        name(key).alias("name"), F.when(fifth, "direct").otherwise("symbolic").alias("kind"), F.when(fifth, F.sha1(F.col("c_name").cast("binary"))).alias("target_id"),
        F.when(~fifth, name((key * 3 + 1) % (n + 20) + 1)).alias("target_name"),
    )


@query(_SYMREFS + "SELECT name, CASE WHEN NOT cycle THEN cur END AS terminal, CASE WHEN NOT cycle THEN target_id END AS target_id, CASE WHEN cycle THEN 'ErrSymbolicCycle' WHEN target_id IS NULL THEN 'ErrReferenceNotFound' END AS error FROM ends")
def symref_resolve(spark, sf_dir):
    return refs.resolve_symbolic(symrefs(spark, sf_dir)).select("name", "terminal", "target_id", "error")


@query(_SYMREFS + "SELECT count(*)::BIGINT AS n_refs, count_if(cycle)::BIGINT AS n_cycles FROM ends")
def symref_cycle(spark, sf_dir):
    done = refs.resolve_symbolic(symrefs(spark, sf_dir))
    return done.agg(F.count("*").alias("n_refs"), F.count_if(F.coalesce(F.col("error") == "ErrSymbolicCycle", F.lit(False))).alias("n_cycles"))


_ALT = "SELECT 's' || n_nationkey AS src, 's' || ((n_nationkey * 2 + 1) % 25) AS dst FROM nation UNION ALL SELECT 's' || n_nationkey, 's' || (n_nationkey + 1) FROM nation WHERE n_nationkey < 12"


@query(f"""WITH RECURSIVE e AS ({_ALT}), w(path, depth) AS (SELECT 's0', 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON w.path = e.src WHERE depth < 5)
SELECT path, min(depth)::INT AS depth FROM w GROUP BY path HAVING path <> 's0'""")
def alternates_closure(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    name = lambda x: F.concat(F.lit("s"), x.cast("string"))
    edges = n.select(name(F.col("k")).alias("src"), name((F.col("k") * 2 + 1) % 25).alias("dst")).unionAll(n.where("k < 12").select(name(F.col("k")), name(F.col("k") + 1)))
    return graph.alternates_closure(edges, "s0")


# Parts are pack entries: entry k is a delta on k-1 (in its pack of 300) unless k is the first.
@query("""SELECT p_partkey AS entry, (p_partkey // 300)::BIGINT AS pack, ((p_partkey // 300) * 300)::BIGINT AS root, (p_partkey % 300)::BIGINT AS depth FROM part WHERE p_partkey % 300 <> 0""")
def delta_chain_depth(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 300).alias("g"))
    entries = p.select(F.col("g").cast("string").alias("pack"), F.col("p_partkey").alias("offset"), F.when(F.col("p_partkey") % 300 != 0, F.col("p_partkey") - 1).alias("base_offset"))
    d = packs.chain_depths(entries)
    return d.select(F.split("node", ":")[1].cast("long").alias("entry"), F.split("node", ":")[0].cast("long").alias("pack"), F.split("root", ":")[1].cast("long").alias("root"), "depth")


@query("""WITH RECURSIVE d AS (SELECT n_nationkey AS k, n_name FROM nation), c(k, content) AS (SELECT k, n_name FROM d WHERE k % 5 = 0 UNION ALL SELECT d.k, left(c.content, 3) || d.n_name FROM c JOIN d ON d.k = c.k + 1 WHERE d.k % 5 <> 0)
SELECT k::BIGINT AS entry, (k % 5)::INT AS depth, sha1(encode('blob ' || octet_length(encode(content))) || '\\x00'::BLOB || encode(content)) AS oid FROM c""")
def delta_chain_content(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    # content k is the first 3 bytes of content k-1 and the name; sizes of bases follow from that
    own = F.octet_length("n_name")
    w = n.join(n.select((F.col("k") + 1).alias("k"), F.octet_length("n_name").alias("before")), "k", "left")
    size = F.when(F.col("k") % 5 == 1, F.col("before")).otherwise(F.col("before") + 3)
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    delta = F.concat(byte(size), byte(own + 3), F.lit(b"\x90\x03"), byte(own), F.col("n_name").cast("binary"))
    base = F.col("k") % 5 == 0
    entries = w.select(
        F.lit("p").alias("pack"), F.col("k").alias("offset"), F.when(base, "blob").otherwise("ofs").alias("entry_type"), F.when(~base, F.col("k") - 1).alias("base_offset"),
        F.lit(None).cast("binary").alias("base_oid"), F.when(base, F.col("n_name").cast("binary")).otherwise(delta).alias("payload"), F.lit(None).cast("string").alias("error"),
    )
    return packs.resolve(entries).select(F.col("offset").alias("entry"), "depth", F.lower(F.hex("oid")).alias("oid"))


@query(f"""WITH {_ENTRIES}, q AS (SELECT c_custkey AS qid, r_name, n_name, c_name, c_custkey % 4 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT qid, CASE WHEN k = 0 THEN CASE WHEN qid % 5 = 0 THEN '100755' ELSE '100644' END WHEN k = 1 THEN '40000' END AS mode, CASE WHEN k = 0 THEN 'C' || qid WHEN k = 1 THEN (SELECT any_value(child) FROM entries e WHERE e.name = q.n_name AND e.mode = '40000' AND e.child LIKE 'N%') END AS child,
CASE k WHEN 2 THEN 'ErrReferenceNotFound' WHEN 3 THEN 'ObjectTypeError' END AS error FROM q""")
def read_path(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    q = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey") % 4
    wanted = q.select(F.col("c_custkey").alias("qid"), F.when(k == 2, "refs/heads/none").when(k == 3, "refs/heads/blob").otherwise("HEAD").alias("name"), F.when(k == 0, F.array("r_name", "n_name", "c_name")).otherwise(F.array("r_name", "n_name")).alias("parts"))
    known = spark.createDataFrame([("HEAD", "symbolic", None, "refs/heads/main"), ("refs/heads/main", "direct", "t1", None), ("refs/heads/blob", "direct", "b1", None)], "name string, kind string, target_id string, target_name string")
    types = spark.createDataFrame([("t1", "tag"), ("c1", "commit"), ("root", "tree"), ("b1", "blob")], "id string, otype string")
    tags, commits = spark.createDataFrame([("t1", "c1")], "id string, target string"), spark.createDataFrame([("c1", "root")], "id string, tree string")
    return repository.read_path(known, wanted, types, tags, commits, _entries(spark, sf_dir), 3)
