"""Packs without contents, refreshes, thin packs, quarantines, chains of stores, tree file systems, and files read back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from objloom.functions import codecs as C
from objloom.functions import objects as O
from objloom.operators import graph, packs, stores
from objloom.operators.lineage import cut, shared_dir
from objloom.plans import repository
from objloom.queries.base import BLOB_OID, blobs, query, table
from objloom.queries.pack_queries import pack_files
from objloom.sources import files as S
from objloom.sources import writers
from objloom.streaming import ingest as streams

_DOCS = f"d AS (SELECT doc_id, doc_id // 50 AS pack, {BLOB_OID.format('text')} AS oid, octet_length(encode(text))::BIGINT AS size FROM documents WHERE text IS NOT NULL)"


def folder(spark) -> str:
    """A new folder that driver and executors have mounted."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")


def hexed(column: str):
    return F.lower(F.hex(column))


def number_of(column: str = "pack"):
    return F.regexp_extract(column, "([0-9]+)$", 1).cast("long")


def _heads(spark, sf_dir):
    files = cut(pack_files(spark, sf_dir))
    return packs.entry_heads(files, packs.resolve(cut(packs.scan(files))).select("pack", "oid", "offset"))


@query(f"WITH {_DOCS} SELECT pack, oid, 'blob' AS otype, size, NULL::VARCHAR AS error FROM d")
def packed_headers(spark, sf_dir):
    """Type and size of every packed object, deltas included, without inflating one."""
    return packs.headers(_heads(spark, sf_dir)).select(number_of().alias("pack"), hexed("oid").alias("oid"), "otype", "size", "error")


@query(f"WITH {_DOCS} SELECT pack, oid, size FROM d")
def packed_sizes(spark, sf_dir):
    """Sizes alone: a delta's from its first bytes."""
    return packs.sizes(_heads(spark, sf_dir)).select(number_of().alias("pack"), hexed("oid").alias("oid"), "size")


_STATE = "CASE pack % 5 WHEN 1 THEN 'ErrMalformedIndex: count' WHEN 2 THEN 'ErrMalformedIndex: pack hash' WHEN 3 THEN 'ErrMalformedPack' WHEN 4 THEN 'ErrPackNotFound' END"


@query(f"WITH {_DOCS} SELECT pack, count(*) + CASE WHEN pack % 5 = 1 THEN 1 ELSE 0 END AS objects, {_STATE} AS error FROM d GROUP BY pack")
def pack_open(spark, sf_dir):
    """Indexes against their packs: of five packs one is sound, others differ in count or hash, are broken, or aren't there."""
    files = cut(pack_files(spark, sf_dir)).withColumn("k", number_of("path") % 5)
    counts = packs.scan(files.select("path", "content")).groupBy(F.col("pack")).agg(F.count("*").alias("n"))
    index = files.select(F.col("path").alias("pack"), "k", F.lower(F.hex(F.substring("content", -20, 20))).alias("own")).join(counts, "pack")
    index = index.select("pack", F.when(F.col("k") == 2, F.lit("00")).otherwise(F.col("own")).alias("hash"), (F.col("n") + F.when(F.col("k") == 1, 1).otherwise(0)).alias("objects"))
    broken = F.when(F.col("k") == 3, F.concat("content", F.lit(b"\0"))).otherwise(F.col("content"))
    return packs.opened(files.where("k <> 4").select(F.col("path").alias("pack"), broken.alias("content")), index).select(number_of().alias("pack"), "objects", "error")


_REFRESH = """WITH n AS (SELECT n_nationkey AS k, n_nationkey % 3 <> 0 AS known, n_nationkey % 4 <> 0 AS listed FROM nation)
SELECT 'good' AS run, k AS pack, CASE WHEN known AND listed THEN 'kept' WHEN listed THEN 'new' ELSE 'retired' END AS state, NULL::VARCHAR AS error FROM n WHERE known OR listed
UNION ALL SELECT 'bad', k, CASE WHEN known THEN 'kept' END, CASE WHEN k = 9 THEN 'ErrMalformedPack' END FROM n WHERE known OR k = 9"""


@query(_REFRESH)
def pack_refresh(spark, sf_dir):
    """Kept, new and retired packs; a new pack that can't be opened leaves everything as it was."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pack"))
    known, listed = n.where("pack % 3 <> 0"), n.where("pack % 4 <> 0")
    none = F.lit(None).cast("string")
    good = packs.refreshed(known, listed.withColumn("error", none))
    bad = packs.refreshed(known, listed.withColumn("error", F.when(F.col("pack") == 9, "ErrMalformedPack")))
    return good.select(F.lit("good").alias("run"), "pack", "state", "error").unionAll(bad.select(F.lit("bad").alias("run"), "pack", "state", "error"))


def thin_packs(spark, sf_dir):
    """A pack for each 50 documents that has deltas by id alone, all on the first document, which isn't in it: (path, content)."""

    def run(key, t):
        texts = [x.encode() for _, x in sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))]
        base = C.object_id("blob", texts[0], "sha1")
        rows = [("ref", C.build_delta(texts[0], x), base) for x in texts[1:]]
        return pa.table({"path": [f"thin-{key[0].as_py()}"][: len(rows)], "content": [C.build_pack(rows, "sha1")][: len(rows)]})

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.floor(F.col("doc_id") / 50).alias("pack"), "doc_id", "text")
    return docs.groupBy("pack").applyInArrow(run, "path string, content binary")


@query(f"WITH {_DOCS}, g AS (SELECT pack FROM d GROUP BY pack HAVING count(*) > 1) SELECT oid, count(*)::BIGINT AS n, 0 AS deeper FROM d SEMI JOIN g USING (pack) GROUP BY oid")
def thin_complete(spark, sf_dir):
    """Thin packs completed from a wider store, published whole, and read again as packs of their own."""
    out = f"{shared_dir(spark)}/thin-{uuid.uuid4().hex}"
    store = blobs(spark, sf_dir).where("content IS NOT NULL").dropDuplicates(["oid"]).select(F.unhex("oid").alias("oid"), F.lit("blob").alias("otype"), "content")
    packs.ingest(cut(thin_packs(spark, sf_dir)), out, external=store)
    whole = packs.published(spark, out, "packs").select(F.col("pack").alias("path"), "content")
    again = packs.resolve(cut(packs.scan(whole)))
    return again.groupBy(hexed("oid").alias("oid")).agg(F.count("*").alias("n"), F.max(F.when(F.col("depth") > 1, 1).otherwise(0)).cast("int").alias("deeper"))


@query(f"WITH {_DOCS}, p AS (SELECT pack, max(size) > 20000 AS large FROM d GROUP BY pack) SELECT CASE WHEN large THEN 'ErrObjectTooLarge' ELSE 'published' END AS state, count(*)::BIGINT AS packs FROM p GROUP BY 1")
def ingest_limit(spark, sf_dir):
    """A pack with an object over the limit is refused, also where only a delta's result is over it.

    An entry is held to the limit as well, so packs have no delta that is longer
    than its object.  Equal packs are ingested once; each file has its state.
    """
    files = cut(pack_files(spark, sf_dir, shorter=True))
    got = packs.ingest(files, f"{shared_dir(spark)}/limit-{uuid.uuid4().hex}", max_size=20_000)
    got = files.select(F.lower(F.hex(F.substring("content", -20, 20))).alias("pack")).join(got, "pack")
    return got.groupBy(F.coalesce("error", F.lit("published")).alias("state")).agg(F.count("*").alias("packs"))


@query(f"WITH {_DOCS} SELECT count(*)::BIGINT AS published, 2 * count(*)::BIGINT AS written FROM d")
def ingest_after_crash(spark, sf_dir):
    """An ingest that was lost before its manifest, and its repetition: tables have the rows of both, readers see one."""
    out = f"{shared_dir(spark)}/crash-{uuid.uuid4().hex}"
    files = cut(pack_files(spark, sf_dir))
    packs.ingest(files, out)
    stores._remove(spark, f"{out}/manifest")
    packs.ingest(files, out)
    seen = packs.published(spark, out, "objects").agg(F.count("*").alias("published"))
    return seen.join(spark.read.parquet(f"{out}/objects").agg(F.count("*").alias("written")), F.lit(True))  # one row each


@query(f"WITH {_DOCS} SELECT count_if(pack % 2 = 0)::BIGINT AS before, count(*)::BIGINT AS visible, count_if(pack % 2 = 0)::BIGINT AS discarded, count(*)::BIGINT AS promoted FROM d")
def pack_quarantine(spark, sf_dir):
    """Packs staged apart: visible in the quarantine, gone if discarded, published if promoted."""
    out = f"{shared_dir(spark)}/packs-{uuid.uuid4().hex}"
    files = cut(pack_files(spark, sf_dir))
    even = number_of("path") % 2 == 0
    packs.ingest(files.where(even), out)
    n = lambda name: cut(packs.published(spark, out, "objects").agg(F.count("*").alias(name)))
    before = n("before")
    q = stores.PackQuarantine(spark, out)
    q.ingest(files.where(~even))
    visible = cut(q.view().agg(F.count("*").alias("visible")))
    q.discard()
    discarded = n("discarded")
    q = stores.PackQuarantine(spark, out)
    q.ingest(files.where(~even))
    q.promote()
    return before.join(visible, F.lit(True)).join(discarded, F.lit(True)).join(n("promoted"), F.lit(True))


@query(f"""WITH {_DOCS}, p AS (SELECT DISTINCT {BLOB_OID.format('html')} AS oid FROM pages)
SELECT 'object' AS side, (SELECT count(*) FROM p)::BIGINT AS visible, (SELECT count(*) FROM p)::BIGINT AS published UNION ALL SELECT 'pack', (SELECT count(*) FROM d)::BIGINT, (SELECT count(*) FROM d)::BIGINT""")
def coordinated_quarantine(spark, sf_dir):
    """Pages as loose objects and documents as packs, staged and promoted together."""
    base = f"{shared_dir(spark)}/dual-{uuid.uuid4().hex}"
    content = O.utf8(F.col("html"))
    rows = stores.with_ids(table(spark, sf_dir, "pages").select(content.alias("content")), F.col("content")).select("object_format", "oid", "otype", "size", "content")
    stores.deduplicated(rows).limit(0).write.parquet(f"{base}/objects")
    q = stores.CoordinatedQuarantine(stores.Quarantine(spark.read.parquet(f"{base}/objects"), f"{base}/objects"), stores.PackQuarantine(spark, f"{base}/packs"))
    q.objects.add(rows)
    q.packs.ingest(cut(pack_files(spark, sf_dir)))
    seen = cut(q.view().groupBy("side").agg(F.count("*").alias("visible")))
    q.promote()
    after = stores.dual(spark.read.parquet(f"{base}/objects").select("oid"), packs.published(spark, f"{base}/packs", "objects").select("oid"))
    return seen.join(after.groupBy("side").agg(F.count("*").alias("published")), "side")


@query(f"""WITH b AS (SELECT {BLOB_OID.format('text')} AS oid, doc_id AS k FROM documents),
s AS (SELECT oid, 0 AS pos, 'loose' AS store FROM b WHERE k % 7 = 0 UNION ALL SELECT oid, 1, 'packed' FROM b WHERE k % 5 = 0 UNION ALL SELECT oid, 2, '/b:loose' FROM b WHERE k % 3 = 0 UNION ALL SELECT oid, 3, '/b:packed' FROM b WHERE k % 2 = 0 UNION ALL SELECT oid, 5, '/a:packed' FROM b)
SELECT oid, arg_min(store, pos) AS store FROM s GROUP BY oid""")
def repository_objects(spark, sf_dir):
    """The store that a repository reads each object from: loose, packed, then each alternate's."""
    b = blobs(spark, sf_dir).select(F.lit("sha1").alias("object_format"), "oid", (F.col("doc_id")).alias("k"))
    own = lambda n: b.where(F.col("k") % n == 0).select("object_format", "oid")
    far = lambda rows, path, depth, side: rows.select("object_format", "oid", F.lit(path).alias("path"), F.lit(depth).alias("depth"), F.lit(side).alias("side"))
    alternates = far(own(3), "/b", 1, "loose").unionAll(far(own(2), "/b", 1, "packed")).unionAll(far(own(1), "/a", 2, "packed"))
    return repository.object_chain(own(7), own(5), alternates).select("oid", "store")


# Regions are directories of a root tree, nations their entries, and every seventh blob is lost.
_FS = """WITH e AS (SELECT n_nationkey AS k, r_name || '/' || n_name AS path, CASE n_nationkey % 4 WHEN 0 THEN '100644' WHEN 1 THEN '100755' WHEN 2 THEN '120000' ELSE '160000' END AS mode, n_name, n_nationkey % 7 = 0 AS lost FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT c_custkey AS qid, c_custkey % 6 AS kind, e.* FROM customer JOIN e ON c_nationkey = k),
p AS (SELECT *, CASE kind WHEN 0 THEN split_part(path, '/', 1) WHEN 1 THEN path || '/x' WHEN 2 THEN '.' WHEN 3 THEN '/' || path WHEN 4 THEN path || '?' ELSE path END AS asked FROM q) """


def _tree_fs(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    mode = F.when(k % 4 == 0, "100644").when(k % 4 == 1, "100755").when(k % 4 == 2, "120000").otherwise("160000")
    tree = F.concat(F.lit("t"), F.col("n_regionkey").cast("string"))
    entries = n.select(tree.alias("tree"), F.col("n_name").alias("name"), mode.alias("mode"), F.concat(F.lit("b"), k.cast("string")).alias("child")).unionAll(
        r.select(F.lit("root"), "r_name", F.lit("40000"), F.concat(F.lit("t"), F.col("r_regionkey").cast("string"))))
    contents = n.where(k % 7 != 0).select(F.concat(F.lit("b"), k.cast("string")).alias("child"), F.col("n_name").cast("binary").alias("content"))
    full = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(k.alias("k"), F.concat_ws("/", "r_name", "n_name").alias("full"))
    c = table(spark, sf_dir, "customer").join(full, F.col("c_nationkey") == F.col("k"))
    kind, p = F.col("c_custkey") % 6, F.col("full")
    asked = F.when(kind == 0, F.split(p, "/")[0]).when(kind == 1, F.concat(p, F.lit("/x"))).when(kind == 2, ".").when(kind == 3, F.concat(F.lit("/"), p)).when(kind == 4, F.concat(p, F.lit("?"))).otherwise(p)
    return c.select(F.col("c_custkey").alias("qid"), F.lit("root").alias("tree"), asked.alias("path")), entries, contents


@query(_FS + """SELECT qid, CASE WHEN kind = 5 AND mode <> '160000' AND NOT lost THEN n_name END AS content,
CASE WHEN kind IN (0, 2) THEN 'ErrIsDirectory' WHEN kind = 1 THEN 'PathNotTreeError' WHEN kind = 3 THEN 'ErrInvalidPath' WHEN kind = 4 THEN 'PathNotFoundError' WHEN mode = '160000' THEN 'ErrGitlinkNotFile' WHEN lost THEN 'ErrObjectNotFound' END AS error FROM p""")
def tree_fs_readfile(spark, sf_dir):
    """Files read by path from a tree's file system."""
    paths, entries, contents = _tree_fs(spark, sf_dir)
    return graph.read_files(paths, entries, contents, 3).select("qid", F.col("content").cast("string").alias("content"), "error")


@query(_FS + """SELECT qid, CASE kind WHEN 0 THEN 't' || (SELECT n_regionkey FROM nation WHERE n_nationkey = p.k) WHEN 2 THEN 'root' END AS tree,
CASE WHEN kind IN (0, 2) THEN NULL WHEN kind = 1 THEN 'PathNotTreeError' WHEN kind = 4 THEN 'PathNotFoundError' ELSE 'ErrInvalidPath' END AS error FROM p""")
def tree_fs_sub(spark, sf_dir):
    """Trees of directories as file systems of their own."""
    paths, entries, _ = _tree_fs(spark, sf_dir)
    return graph.subtrees(paths, entries, 3)


def _published(spark, sf_dir):
    """A folder with the published files of all packs."""
    where = folder(spark)
    files = cut(pack_files(spark, sf_dir)).select(F.col("path").alias("pack"), "content")
    e = cut(packs.scan(files.withColumnRenamed("pack", "path")))
    rows = packs.resolve(e).join(e.select("pack", "offset", "crc32"), ["pack", "offset"])
    writers.write_files(cut(writers.pack_artifacts(files, rows)), where)
    return where


@query(f"WITH {_DOCS} SELECT oid, count(*)::BIGINT AS n, 0::BIGINT AS errors FROM d GROUP BY oid")
def index_files(spark, sf_dir):
    """Index files published beside their packs and read again."""
    got = S.pack_indexes(spark, _published(spark, sf_dir))
    return got.groupBy(hexed("oid").alias("oid")).agg(F.count("*").alias("n"), F.count("error").alias("errors"))


@query(f"WITH {_DOCS}, p AS (SELECT pack, count(*)::BIGINT AS n FROM d GROUP BY pack) SELECT n, n * (n - 1) // 2 AS pack_sum, n * (n - 1) // 2 AS idx_sum FROM p")
def reverse_files(spark, sf_dir):
    """Reverse index files read again: a permutation of the positions of each pack."""
    got = S.reverse_indexes(spark, _published(spark, sf_dir)).where("error IS NULL")
    return got.groupBy("pack").agg(F.count("*").alias("n"), F.sum("pack_pos").alias("pack_sum"), F.sum("idx_pos").alias("idx_sum")).drop("pack")


@query(f"WITH {_DOCS} SELECT count(*)::BIGINT AS pairs, count(*)::BIGINT AS hits FROM (SELECT DISTINCT pack, oid FROM d)")
def bloom_files(spark, sf_dir):
    """Filter files read again: each has all the ids of its pack, and one whose pack isn't that of its name is as if absent."""
    where = _published(spark, sf_dir)
    index = S.pack_indexes(spark, where).where("error IS NULL")
    read = S.bloom_filters(spark, where).withColumn("hash", F.col("pack"))
    wrong = read.limit(8).withColumn("hash", F.lit("00"))
    usable = packs.usable_filters(read.unionByName(wrong), index.select("pack", F.col("pack").alias("hash")).distinct())
    own = index.select("pack", "oid").distinct()
    hits = packs.bloom_probe(own.select("oid").distinct(), usable).join(own, ["pack", "oid"], "left_semi").agg(F.count("*").alias("hits"))
    return own.agg(F.count("*").alias("pairs")).join(hits, F.lit(True))  # one row each


@query(f"WITH {_DOCS} SELECT oid, any_value(size) AS size, 'blob' AS otype FROM d GROUP BY oid")
def loose_headers(spark, sf_dir):
    """Loose files written and only their headers read."""
    where = folder(spark)
    rows = stores.deduplicated(stores.with_ids(table(spark, sf_dir, "documents").where("text IS NOT NULL").select(O.utf8(F.col("text")).alias("content")), F.col("content")))
    writers.write_files(writers.loose_files(rows), where)
    return S.loose_objects(spark, where, content=False).select(hexed("oid").alias("oid"), "size", "otype")


@query(f"WITH {_DOCS}, p AS (SELECT pack, count(*)::BIGINT AS n FROM d GROUP BY pack) SELECT count(*)::BIGINT AS packs, sum(n)::BIGINT AS objects FROM p")
def pack_stream(spark, sf_dir):
    """Pack files dropped into a folder and ingested by the stream, which is then run again."""
    drop, out = folder(spark), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writers.write_files(cut(pack_files(spark, sf_dir)).select(F.concat("path", F.lit(".pack")).alias("path"), "content"), drop)
    for _ in range(2):
        streams.packs_from(spark, drop, f"{out}/packs", f"{out}/state").awaitTermination()
    return packs.manifest(spark, f"{out}/packs").agg(F.count("*").alias("packs"), F.sum("objects").alias("objects"))


@query(f"""WITH {_DOCS}, p AS (SELECT *, (row_number() OVER (PARTITION BY pack ORDER BY doc_id) - 1) % 5 AS k, lag(size) OVER (PARTITION BY pack ORDER BY doc_id) AS before FROM d)
SELECT pack, row_number() OVER (PARTITION BY pack ORDER BY doc_id) - 1 AS pack_pos, CASE WHEN k <> 0 THEN before END AS base_size, CASE WHEN k <> 0 THEN size END AS result_size FROM p""")
def pack_explain_deltas(spark, sf_dir):
    """The sizes that the explained delta instructions name and give."""
    e = cut(packs.scan(pack_files(spark, sf_dir)))
    return packs.explain(e, packs.resolve(e)).select(number_of().alias("pack"), "pack_pos", "base_size", "result_size")
