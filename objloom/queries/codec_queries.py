"""Typed parsing, signed payloads, text formats, writers and publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from objloom.functions import objects as O
from objloom.operators import graph, packs, refs, stores
from objloom.operators.lineage import cut, shared_dir
from objloom.queries.base import BLOB_OID, blobs, query, table
from objloom.queries.object_queries import _COMMITS, _TREE, commit_chain, lang_trees
from objloom.queries.pack_queries import pack_files
from objloom.sources import files as S
from objloom.sources import writers


def _objects(df, otype, content):
    return df.select(O.oid(otype, content).alias("oid"), F.lit(otype).alias("otype"), content.alias("content"))


@query(_TREE + f"SELECT lang, count(*)::BIGINT AS n, min('f' || doc_id) AS first_name, max({BLOB_OID.format('text')}) AS max_child FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def tree_parse(spark, sf_dir):
    """Tree bodies built from documents and parsed again, in the order they must have."""
    trees = lang_trees(spark, sf_dir)
    rows = S.parsed_objects(_objects(trees, "tree", F.col("body")))["tree_entries"].where("error IS NULL")
    own = rows.join(trees.select("lang", F.unhex("tree_oid").alias("oid")), "oid")
    return own.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.col("name").cast("string")).alias("first_name"), F.max(F.lower(F.hex("child"))).alias("max_child"))


def _commit_text(spark, sf_dir, signed=False):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    who = O.identity(F.col("role"), F.lit("r@x"), F.lit(1234567890) + F.col("turn"), F.lit(-90))
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.col("turn"), F.lit(1)).cast("int")), lambda i: F.sha1(i.cast("string").cast("binary")))
    parents = F.when(F.col("turn") > 0, parents).otherwise(F.array().cast("array<string>"))
    body = O.commit_body(F.sha1(F.col("conv_id").cast("string").cast("binary")), parents, who, who, F.col("text"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("I"), F.col("conv_id").cast("string"))))
    if signed:
        body = F.regexp_replace(body, r"\A([\s\S]*?\n)\n", "$1gpgsig BEGIN\n line " + "\n end\nx-y z\n\n")
    return t.select("conv_id", "turn", "role", "text", body.alias("body"))


@query("""SELECT conv_id, turn, sha1(conv_id::VARCHAR) AS tree, greatest(turn, 0)::BIGINT AS n_parents, role AS author, (1234567890 + turn)::BIGINT AS author_when, -90 AS author_offset, CASE WHEN turn % 2 = 0 THEN 'I' || conv_id END AS change_id, text AS message FROM conversations""")
def commit_parse(spark, sf_dir):
    c = _commit_text(spark, sf_dir)
    keyed = c.select("conv_id", "turn", O.utf8(F.col("body")).alias("content")).withColumn("oid", O.oid("commit", F.col("content"))).withColumn("otype", F.lit("commit"))
    got = S.parsed_objects(keyed.select("oid", "otype", "content").distinct())["commits"].where("error IS NULL")
    return keyed.select("conv_id", "turn", "oid").join(got, "oid").select(
        "conv_id", "turn", F.lower(F.hex("tree")).alias("tree"), F.size("parents").cast("long").alias("n_parents"), F.col("author_name").cast("string").alias("author"), "author_when", "author_offset",
        F.col("change_id").cast("string").alias("change_id"), F.col("message").cast("string").alias("message"),
    )


@query("SELECT conv_id, turn, TRUE AS same_payload, 'BEGIN' || chr(10) || 'line ' || chr(10) || 'end' || chr(10) AS signature FROM conversations")
def signed_commit_split(spark, sf_dir):
    """The payload of a signed commit is the commit without its signature."""
    plain, signed = _commit_text(spark, sf_dir), _commit_text(spark, sf_dir, signed=True)
    content = O.utf8(F.col("body"))
    keyed = signed.select("conv_id", "turn", content.alias("content"), O.oid("commit", content).alias("oid"), F.lit("commit").alias("otype"))
    got = S.signed_payloads(keyed.select("oid", "otype", "content").distinct(), "commit").select("oid", "payload", "sha1_signature")
    want = plain.select("conv_id", "turn", O.utf8(F.regexp_replace("body", r"\A([\s\S]*?\n)\n", "$1x-y z\n\n")).alias("want"))
    return keyed.select("conv_id", "turn", "oid").join(got, "oid").join(want, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("payload") == F.col("want")).alias("same_payload"), F.col("sha1_signature").cast("string").alias("signature"))


@query(f"SELECT item_id, 'v' || item_id AS name, {BLOB_OID.format('text')} AS target, 'blob' AS target_type, -120 AS tagger_offset, 'item ' || item_id AS message FROM benchmark")
def tag_parse(spark, sf_dir):
    item = F.col("item_id").cast("string")
    tagger = O.identity(F.lit("t"), F.lit("t@x"), F.lit(1234567890) + F.col("item_id"), F.lit(-120))
    body = O.utf8(O.tag_body(O.oid_hex("blob", O.utf8(F.col("text"))), F.lit("blob"), F.concat(F.lit("v"), item), tagger, F.concat(F.lit("item "), item)))
    tags = S.parsed_objects(_objects(table(spark, sf_dir, "benchmark"), "tag", body))["tags"].where("error IS NULL")
    name = F.col("name").cast("string")
    return tags.select(F.substr(name, F.lit(2)).cast("long").alias("item_id"), name.alias("name"), F.lower(F.hex("target")).alias("target"), "target_type", "tagger_offset", F.col("message").cast("string").alias("message"))


@query("SELECT c_custkey AS qid, n_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_nationkey END AS child FROM customer JOIN nation ON c_nationkey = n_nationkey")
def tree_find(spark, sf_dir):
    """Entries by (tree, name); every third name isn't there."""
    n = table(spark, sf_dir, "nation")
    entries = n.select(F.lit(0).alias("tree"), F.col("n_name").alias("name"), F.lit("100644").alias("mode"), F.col("n_nationkey").alias("child"))
    q = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    q = q.select(F.col("c_custkey").alias("qid"), F.lit(0).alias("tree"), F.col("n_name").alias("asked"), F.when(F.col("c_custkey") % 3 == 0, F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name")).alias("name"))
    return graph.find_entries(q, entries).select("qid", F.col("asked").alias("name"), "child")


@query("""WITH e AS (SELECT 'n' || (c_custkey % 40) AS name, CASE c_custkey % 5 WHEN 0 THEN '040000' WHEN 1 THEN '40000' ELSE '100644' END AS mode, c_custkey AS seq FROM customer UNION ALL SELECT 'a/b', '100644', -1 UNION ALL SELECT '', '100644', -2),
v AS (SELECT *, CASE WHEN mode = '040000' THEN 'ErrInvalidMode' WHEN name = '' OR contains(name, '/') THEN 'ErrInvalidTree' END AS bad FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY name, bad IS NULL ORDER BY seq) AS k FROM v)
SELECT seq, name, CASE WHEN bad IS NOT NULL THEN bad WHEN k > 1 THEN 'ErrInvalidTree' END AS error FROM r""")
def tree_insert(spark, sf_dir):
    """Entries inserted into one tree in order of seq: bad modes and names and names that are there are refused."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 5
    e = c.select(F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string")).alias("name"), F.when(k == 0, "040000").when(k == 1, "40000").otherwise("100644").alias("mode"), F.col("c_custkey").cast("long").alias("seq"))
    e = e.unionAll(spark.createDataFrame([("a/b", "100644", -1), ("", "100644", -2)], "name string, mode string, seq long"))
    return graph.inserted(spark.createDataFrame([], "tree int, name string"), e.withColumn("tree", F.lit(0))).select("seq", "name", "error")


@query("""SELECT 'refs/' || CASE WHEN n_nationkey % 4 = 0 THEN 'tags/' ELSE 'heads/' END || n_nationkey AS name, sha1(n_name) AS target_id, CASE WHEN n_nationkey % 4 = 0 THEN 'peeled' ELSE 'none' END AS peel_state, CASE WHEN n_nationkey % 4 = 0 THEN sha1('p' || n_name) END AS peeled_id FROM nation""")
def packed_refs_parse(spark, sf_dir):
    """References written as packed-refs text, and parsed again."""
    n = table(spark, sf_dir, "nation")
    fourth = F.col("n_nationkey") % 4 == 0
    name = F.concat(F.lit("refs/"), F.when(fourth, "tags/").otherwise("heads/"), F.col("n_nationkey").cast("string"))
    sha = lambda c: F.unhex(F.sha1(c.cast("binary")))
    rows = n.select(name.alias("name"), F.lit("direct").alias("kind"), sha(F.col("n_name")).alias("target_id"), F.when(fourth, sha(F.concat(F.lit("p"), F.col("n_name")))).alias("peeled_id"))

    def parse(path, data):
        from objloom.functions import codecs as C

        for name, oid, state, peeled in C.parse_packed_refs(data, "sha1"):
            yield {"name": name, "target_id": oid, "peel_state": state, "peeled_id": peeled}

    got = S._decoded(writers.packed_refs_text(rows), "path string, name binary, target_id binary, peel_state string, peeled_id binary, error string", parse)
    return S.as_text(got, "name").select("name", F.lower(F.hex("target_id")).alias("target_id"), "peel_state", F.lower(F.hex("peeled_id")).alias("peeled_id"))


@query("""SELECT 'r' || n_nationkey AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'symbolic' WHEN n_nationkey % 3 = 1 THEN 'direct' END AS kind, CASE WHEN n_nationkey % 3 = 0 THEN 'refs/heads/' || n_name WHEN n_nationkey % 3 = 1 THEN sha1(n_name) END AS target, CASE WHEN n_nationkey % 3 = 2 THEN 'ErrInvalidValue' END AS error FROM nation""")
def loose_ref_parse(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 3
    sha = F.sha1(F.col("n_name").cast("binary"))
    text = F.when(k == 0, F.concat(F.lit("ref:  refs/heads/"), F.col("n_name"), F.lit(" \n"))).when(k == 1, F.concat(F.upper(sha), F.lit("\nmore"))).otherwise(F.substr(sha, F.lit(1), F.lit(39)))
    files = n.select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("path"), text.cast("binary").alias("content"))

    def parse(path, data):
        from objloom.functions import codecs as C

        kind, target = C.parse_loose_ref(data, "sha1")
        yield {"kind": kind, "target": target.decode() if kind == "symbolic" else target.hex()}

    return S._decoded(files, "path string, kind string, target string, error string", parse).select(F.col("path").alias("name"), "kind", "target", "error")


@query("""SELECT n_regionkey AS file, n_nationkey AS ord, CASE WHEN n_nationkey % 2 = 0 THEN '/abs/' || n_name ELSE '/repo' || n_regionkey || '/objects/' || n_name || chr(9) || 'x' END AS target FROM nation""")
def alternates_parse(spark, sf_dir):
    """Alternates files written from nations, absolute and quoted relative, and parsed again."""
    n = table(spark, sf_dir, "nation")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("/abs/"), F.col("n_name"))).otherwise(F.concat(F.lit('"'), F.col("n_name"), F.lit('\\011x"')))
    text = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("r"))
    files = text.select(F.concat(F.lit("/repo"), F.col("n_regionkey").cast("string"), F.lit("/objects/info/alternates")).alias("path"), F.concat(F.lit("# c\n"), F.array_join(F.transform("r", lambda r: r["l"]), "\n")).cast("binary").alias("content"))
    got = S.as_text(S.alternates(files), "target").select(F.regexp_extract("path", "repo([0-9]+)", 1).cast("int").alias("file"), F.col("ord").alias("k"), "target")
    keys = text.select(F.col("n_regionkey").alias("file"), F.posexplode(F.transform("r", lambda r: r["n_nationkey"])).alias("k", "ord"))
    return got.join(keys, ["file", "k"]).select("file", "ord", "target")


@query(f"SELECT count(DISTINCT {BLOB_OID.format('text')})::BIGINT AS n, 2 AS runs FROM documents WHERE text IS NOT NULL")
def write_idempotent(spark, sf_dir):
    """Documents written twice to a content-addressed store."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(O.utf8(F.col("text")).alias("content"))
    for _ in range(2):
        out = stores.write(rows, path)
    return out.agg(F.count("*").alias("n"), F.lit(2).alias("runs"))


@query(f"""WITH b AS (SELECT {BLOB_OID.format('text')} AS oid, min(doc_id) AS d FROM documents GROUP BY 1) SELECT count(*)::BIGINT AS visible, count_if(d % 2 = 0)::BIGINT AS published FROM b""")
def quarantine_view(spark, sf_dir):
    """What a quarantine shows, and what is published without promoting it."""
    b = blobs(spark, sf_dir).groupBy("oid").agg(F.min("doc_id").alias("d")).select(F.lit("sha1").alias("object_format"), "oid", "d")
    store = b.where("d % 2 = 0")
    q = stores.Quarantine(store, f"{shared_dir(spark)}/quarantined")
    q.add(b)
    both = q.view().select(F.lit(1).alias("v"), F.lit(0).alias("p")).unionAll(store.select(F.lit(0), F.lit(1)))
    return both.agg(F.sum("v").alias("visible"), F.sum("p").alias("published"))


@query("SELECT k AS kind, count(DISTINCT doc_id // 50)::BIGINT AS n, i AS step FROM documents, (VALUES ('pack', 0), ('rev', 1), ('bloom', 2), ('idx', 3)) AS v(k, i) WHERE text IS NOT NULL GROUP BY k, i")
def pack_publish(spark, sf_dir):
    """The files of each pack in the order they are published, and indexes that parse."""
    files = pack_files(spark, sf_dir).select(F.col("path").alias("pack"), "content")
    e = cut(packs.scan(files.withColumnRenamed("pack", "path")))
    rows = packs.resolve(e).join(e.select("pack", "offset", "crc32"), ["pack", "offset"])
    made = writers.pack_artifacts(files, rows)
    return made.groupBy(F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind"), "step").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT doc_id // 50 AS pack, (row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1) AS k FROM documents WHERE text IS NOT NULL) SELECT pack::VARCHAR AS pack, count(*)::BIGINT AS n FROM p WHERE k % 5 = 4 GROUP BY 1""")
def missing_bases(spark, sf_dir):
    """With nothing but the deltas by id left of each pack, all their bases are missing."""
    e = cut(packs.scan(pack_files(spark, sf_dir)).where("entry_type = 'ref'"))
    gone = packs.missing_bases(e.withColumn("base_oid", F.unhex(F.sha1(F.concat("base_oid", F.col("offset").cast("string").cast("binary"))))), packs.resolve(e))
    return gone.groupBy(F.regexp_extract("pack", "([0-9]+)$", 1).alias("pack")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT c_custkey AS seq, CASE c_custkey % 8 WHEN 0 THEN 'MERGE_HEAD' WHEN 1 THEN 'refs/heads/a..b' WHEN 2 THEN 'HEAD' WHEN 3 THEN 'refs/../x' ELSE 'refs/heads/u' || c_custkey END AS name, CASE c_custkey % 8 WHEN 2 THEN 'create-symbolic' WHEN 3 THEN 'delete' WHEN 4 THEN 'update-symbolic' ELSE 'create' END AS kind, CASE WHEN c_custkey % 16 = 2 THEN 'refs/tags/x' ELSE 'refs/heads/x' END AS new_target FROM customer)
SELECT seq, CASE WHEN name IN ('MERGE_HEAD', 'refs/heads/a..b', 'refs/../x') OR name = 'HEAD' AND new_target = 'refs/tags/x' THEN 'ErrInvalidName' WHEN kind = 'update-symbolic' THEN 'ErrInvalidValue' END AS invalid FROM o""")
def ref_ops_validate(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 8 == 0, "MERGE_HEAD").when(k % 8 == 1, "refs/heads/a..b").when(k % 8 == 2, "HEAD").when(k % 8 == 3, "refs/../x").otherwise(F.concat(F.lit("refs/heads/u"), k.cast("string")))
    kind = F.when(k % 8 == 2, "create-symbolic").when(k % 8 == 3, "delete").when(k % 8 == 4, "update-symbolic").otherwise("create")
    none = F.lit(None).cast("string")
    ops = table(spark, sf_dir, "customer").select(k.alias("seq"), name.alias("name"), kind.alias("kind"), F.lit("1").alias("new_id"), F.lit("2").alias("old_id"), F.when(k % 16 == 2, "refs/tags/x").otherwise("refs/heads/x").alias("new_target"), none.alias("old_target"))
    return refs.validated(ops).select("seq", "invalid")


@query(_COMMITS + "SELECT conv_id, count(*)::BIGINT AS n, count_if(parent <> '')::BIGINT AS n_edges FROM body GROUP BY conv_id")
def commit_edges(spark, sf_dir):
    return commit_chain(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("parent") != "").alias("n_edges"))
