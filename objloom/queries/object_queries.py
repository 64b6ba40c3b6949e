"""Objects: identifiers, trees, commits, tags, identities, modes, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from objloom.functions import objects as O
from objloom.operators import packs, stores
from objloom.queries.base import BLOB_OID, BLOB_OID_256, blobs, frame, query, table, values


@query(f"SELECT doc_id, octet_length(encode(text))::BIGINT AS size, {BLOB_OID.format('text')} AS sha1_oid, {BLOB_OID_256.format('text')} AS sha256_oid FROM documents")
def blob_oid(spark, sf_dir):
    c = O.utf8(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(c).cast("long").alias("size"), O.oid_hex("blob", c).alias("sha1_oid"), O.oid_hex("blob", c, "sha256").alias("sha256_oid"))


_TREE = f"""
WITH entries AS (SELECT lang, encode('f' || doc_id) AS name, hex(encode('100644 f' || doc_id) || '\\x00'::BLOB) || upper({BLOB_OID.format('text')}) AS e FROM documents WHERE lang IS NOT NULL),
bodies AS (SELECT lang, unhex(string_agg(e, '' ORDER BY name)) AS body, count(*) AS n FROM entries GROUP BY lang),
trees AS (SELECT lang, n, body, sha1(encode('tree ' || octet_length(body)) || '\\x00'::BLOB || body) AS tree_oid FROM bodies)
"""


def lang_trees(spark, sf_dir):
    b = blobs(spark, sf_dir).where("lang IS NOT NULL")
    # a language holds up to all rows, and its tree is one object; what is gathered is one short row for each entry, never contents
    body = b.groupBy("lang").agg(O.tree_body(F.lit("100644"), O.utf8(F.concat(F.lit("f"), F.col("doc_id"))), F.unhex("oid")).alias("body"), F.count("*").alias("n"))
    return body.withColumn("tree_oid", O.oid_hex("tree", F.col("body")))


@query(_TREE + "SELECT lang, n::BIGINT AS n_entries, octet_length(body)::BIGINT AS size, tree_oid FROM trees")
def tree_oid(spark, sf_dir):
    return lang_trees(spark, sf_dir).select("lang", F.col("n").alias("n_entries"), F.octet_length("body").cast("long").alias("size"), "tree_oid")


@query(_TREE + """, root AS (SELECT unhex(string_agg(hex(encode('40000 ' || lang) || '\\x00'::BLOB) || upper(tree_oid), '' ORDER BY encode(lang || '/'))) AS body FROM trees)
SELECT octet_length(body)::BIGINT AS size, sha1(encode('tree ' || octet_length(body)) || '\\x00'::BLOB || body) AS root_oid FROM root WHERE body IS NOT NULL""")
def root_tree_oid(spark, sf_dir):
    t = lang_trees(spark, sf_dir).select("lang", "tree_oid")
    root = t.agg(O.tree_body(F.lit("40000"), O.utf8(F.col("lang")), F.unhex("tree_oid")).alias("body"), F.count("*").alias("n")).where("n > 0")
    return root.select(F.octet_length("body").cast("long").alias("size"), O.oid_hex("tree", F.col("body")).alias("root_oid"))


@query("""WITH e AS (SELECT DISTINCT split_part(p_type, ' ', 1) || CASE WHEN p_size % 3 = 0 THEN '-x' WHEN p_size % 3 = 1 THEN '' ELSE '.c' END AS name, CASE WHEN p_size % 3 = 1 THEN '40000' ELSE '100644' END AS mode FROM part)
SELECT name, mode, row_number() OVER (ORDER BY encode(name || CASE WHEN mode = '40000' THEN '/' ELSE '' END)) AS pos FROM e""")
def tree_order_mixed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    third = F.col("p_size") % 3
    name = F.concat(F.split("p_type", " ")[0], F.when(third == 0, "-x").when(third == 1, "").otherwise(".c"))
    e = part.select(name.alias("name"), F.when(third == 1, "40000").otherwise("100644").alias("mode")).distinct()
    from pyspark.sql import Window as W

    # distinct names of one tree, numbered in its order
    return e.withColumn("pos", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(O.tree_key(O.utf8(F.col("name")), F.col("mode")))).cast("long"))


_COMMITS = """
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
body(conv_id, pos, parent, oid) AS (
  SELECT conv_id, pos, ''::VARCHAR, sha1(encode('commit ' || octet_length(encode(b))) || '\\x00'::BLOB || encode(b)) FROM (
    SELECT conv_id, pos, 'tree 4b825dc642cb6eb9a060e54bf8d69288fbee4904' || chr(10) || 'author ' || role || ' <' || role || '@x> ' || (1234567890 + turn) || ' +0130' || chr(10) || 'committer ' || role || ' <' || role || '@x> ' || (1234567890 + turn) || ' +0130' || chr(10) || chr(10) || text AS b FROM c WHERE pos = 1)
  UNION ALL
  SELECT conv_id, pos, parent, sha1(encode('commit ' || octet_length(encode(b))) || '\\x00'::BLOB || encode(b)) FROM (
    SELECT c.conv_id, c.pos, body.oid AS parent, 'tree 4b825dc642cb6eb9a060e54bf8d69288fbee4904' || chr(10) || 'parent ' || body.oid || chr(10) || 'author ' || role || ' <' || role || '@x> ' || (1234567890 + turn) || ' +0130' || chr(10) || 'committer ' || role || ' <' || role || '@x> ' || (1234567890 + turn) || ' +0130' || chr(10) || chr(10) || text AS b
    FROM c JOIN body ON c.conv_id = body.conv_id AND c.pos = body.pos + 1))
"""


def commit_chain(spark, sf_dir):
    """conv_id, pos, parent, oid: each turn is a commit on the turn before it.

    An identifier depends on all before it, so a chain is a fold over a
    conversation's turns; conversations are independent rows of an aggregate.
    """
    who = lambda r: F.concat(r["role"], F.lit(" <"), r["role"], F.lit("@x> "), (F.lit(1234567890) + r["turn"]).cast("string"), F.lit(" +0130"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    empty = F.array().cast("array<struct<pos:bigint,parent:string,oid:string>>")

    def step(acc, r):
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["oid"], F.lit(""))
        parents = F.when(last == "", F.array().cast("array<string>")).otherwise(F.array(last))
        body = O.utf8(O.commit_body(F.lit("4b825dc642cb6eb9a060e54bf8d69288fbee4904"), parents, who(r), who(r), r["text"]))
        return F.concat(acc, F.array(F.struct((F.size(acc) + 1).cast("long").alias("pos"), last.alias("parent"), O.oid_hex("commit", body).alias("oid"))))

    return turns.select("conv_id", F.explode(F.aggregate("turns", empty, step)).alias("c")).select("conv_id", "c.*")


@query(_COMMITS + "SELECT conv_id, pos, parent, oid FROM body")
def commit_oid_chain(spark, sf_dir):
    return commit_chain(spark, sf_dir)


@query(f"""SELECT item_id, sha1(encode('tag ' || octet_length(encode(b))) || '\\x00'::BLOB || encode(b)) AS tag_oid, octet_length(encode(b))::BIGINT AS size FROM (
SELECT item_id, 'object ' || {BLOB_OID.format('text')} || chr(10) || 'type blob' || chr(10) || 'tag v' || item_id || chr(10) || 'tagger t <t@x> ' || (1234567890 + item_id) || ' -0200' || chr(10) || chr(10) || 'item ' || item_id AS b FROM benchmark)""")
def tag_body_oid(spark, sf_dir):
    item = F.col("item_id").cast("string")
    tagger = O.identity(F.lit("t"), F.lit("t@x"), F.lit(1234567890) + F.col("item_id"), F.lit(-120))
    body = O.utf8(O.tag_body(O.oid_hex("blob", O.utf8(F.col("text"))), F.lit("blob"), F.concat(F.lit("v"), item), tagger, F.concat(F.lit("item "), item)))
    return table(spark, sf_dir, "benchmark").select("item_id", O.oid_hex("tag", body).alias("tag_oid"), F.octet_length(body).cast("long").alias("size"))


_LINE = "c_name || '  <' || lower(c_mktsegment) || '@x> ' || (c_custkey * 86400) || CASE c_nationkey % 5 WHEN 0 THEN ' +0130' WHEN 1 THEN ' -2359' WHEN 2 THEN ' +2400' WHEN 3 THEN ' +0' ELSE ' -0000' END"


@query(f"""WITH l AS (SELECT c_custkey, {_LINE} AS line FROM customer),
p AS (SELECT *, regexp_extract(line, '^([^<]*)<([^>]*)> ([0-9]+) ([+-])([0-9][0-9])([0-9][0-9])', ['n','e','w','s','h','m']) AS g FROM l)
SELECT c_custkey, CASE WHEN ok THEN rtrim(g.n) END AS name, CASE WHEN ok THEN g.e END AS email, CASE WHEN ok THEN try_cast(g.w AS BIGINT) END AS when_unix,
CASE WHEN ok THEN ((try_cast(g.h AS INT) * 60 + try_cast(g.m AS INT)) * CASE WHEN g.s = '-' THEN -1 ELSE 1 END)::INT END AS offset_minutes, CASE WHEN NOT ok THEN 'ErrInvalidSignature' END AS error
FROM (SELECT *, g.w <> '' AND try_cast(g.h AS INT) < 24 AND try_cast(g.m AS INT) < 60 AS ok FROM p)""")
def identity_parse(spark, sf_dir):
    k = F.col("c_nationkey") % 5
    zone = F.when(k == 0, " +0130").when(k == 1, " -2359").when(k == 2, " +2400").when(k == 3, " +0").otherwise(" -0000")
    line = F.concat("c_name", F.lit("  <"), F.lower("c_mktsegment"), F.lit("@x> "), (F.col("c_custkey") * 86400).cast("string"), zone)
    return table(spark, sf_dir, "customer").select("c_custkey", O.parse_identity(line).alias("p")).select("c_custkey", "p.*")


@query("SELECT c_custkey, c_name || ' <c@x> ' || c_custkey || CASE WHEN m < 0 THEN ' -' ELSE ' +' END || lpad((abs(m) // 60)::VARCHAR, 2, '0') || lpad((abs(m) % 60)::VARCHAR, 2, '0') AS line FROM (SELECT *, c_nationkey * 61 - 700 AS m FROM customer)")
def identity_format(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", O.identity(F.col("c_name"), F.lit("c@x"), F.col("c_custkey"), F.col("c_nationkey") * 61 - 700).alias("line"))


_MODES = [("40000",), ("100644",), ("100755",), ("120000",), ("160000",), ("040000",), ("100600",), ("",), ("644",), ("8",), ("1006440",)]


@query(f"""SELECT octal, CASE octal WHEN '40000' THEN 16384 WHEN '100644' THEN 33188 WHEN '100755' THEN 33261 WHEN '120000' THEN 40960 WHEN '160000' THEN 57344 END::INT AS mode,
CASE octal WHEN '40000' THEN 'tree' WHEN '160000' THEN 'commit' WHEN '100644' THEN 'blob' WHEN '100755' THEN 'blob' WHEN '120000' THEN 'blob' END AS object_type,
CASE WHEN octal IN ('40000', '160000') THEN FALSE WHEN octal IN ('100644', '100755', '120000') THEN TRUE END AS blob_like,
CASE WHEN octal IN ('40000', '160000', '120000') THEN FALSE WHEN octal IN ('100644', '100755') THEN TRUE END AS regular,
CASE WHEN octal NOT IN ('40000', '100644', '100755', '120000', '160000') THEN 'ErrInvalidMode' END AS error FROM {values(_MODES, 'octal')}""")
def mode_dim(spark, sf_dir):
    return frame(spark, _MODES, "octal string").select("octal", O.mode_row(F.col("octal")).alias("m")).select("octal", "m.*")


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'blob ' || octet_length(encode(text)) WHEN 1 THEN 'blob ' || (octet_length(encode(text)) + 1) WHEN 2 THEN 'blub 3' WHEN 3 THEN 'blob x' ELSE 'tree 0' || octet_length(encode(text)) END AS head, text FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'blob' WHEN 1 THEN 'blob' WHEN 4 THEN 'tree' END AS otype, CASE doc_id % 5 WHEN 1 THEN 'ErrSizeMismatch' WHEN 2 THEN 'ErrInvalidType' WHEN 3 THEN 'ErrInvalidHeader' END AS error, octet_length(encode(text))::BIGINT AS body_size FROM r""")
def header_parse(spark, sf_dir):
    d, n = F.col("doc_id") % 5, F.octet_length("text").cast("string")
    head = F.when(d == 0, F.concat(F.lit("blob "), n)).when(d == 1, F.concat(F.lit("blob "), (F.octet_length("text") + 1).cast("string"))).when(d == 2, "blub 3").when(d == 3, "blob x").otherwise(F.concat(F.lit("tree 0"), n))
    raw = table(spark, sf_dir, "documents").select("doc_id", F.concat(O.utf8(head), F.lit(b"\0"), O.utf8(F.col("text"))).alias("raw"))
    return stores.write_full(raw).select("doc_id", "otype", "error", F.octet_length("content").cast("long").alias("body_size"))


@query(f"""WITH b AS (SELECT doc_id, {BLOB_OID.format('text')} AS oid FROM documents),
s AS (SELECT oid, 0 AS priority, doc_id FROM b WHERE doc_id % 3 = 0 UNION ALL SELECT oid, 1, doc_id FROM b WHERE doc_id % 2 = 0 UNION ALL SELECT oid, 2, doc_id FROM b)
SELECT oid, min(priority)::INT AS priority FROM s GROUP BY oid""")
def chain_first_hit(spark, sf_dir):
    b = blobs(spark, sf_dir).select("doc_id", "oid")
    third, even = F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0
    return stores.chained([b.where(third), b.where(even), b], ["oid"]).select("oid", "priority")


@query(f"""WITH b AS (SELECT {BLOB_OID.format('text')} AS oid, 'document' AS kind, octet_length(encode(text))::BIGINT AS size FROM documents UNION ALL SELECT {BLOB_OID.format('html')}, 'page', octet_length(encode(html))::BIGINT FROM pages)
SELECT oid, any_value(size) AS size, count(*)::BIGINT AS n FROM b GROUP BY oid""")
def dedupe_objects(spark, sf_dir):
    c = lambda t, col: table(spark, sf_dir, t).select(O.oid_hex("blob", O.utf8(F.col(col))).alias("oid"), F.octet_length(col).cast("long").alias("size"))
    both = c("documents", "text").unionAll(c("pages", "html"))
    counts = both.groupBy("oid").agg(F.count("*").alias("n"))
    return stores.deduplicated(both.withColumn("object_format", F.lit("sha1"))).select("oid", "size").join(counts, "oid").select("oid", "size", "n")


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def missing_objects(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return stores.missing(ids, table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id")), ["id"])


@query("""SELECT o_orderkey AS qid, CASE WHEN c.c_custkey IS NULL THEN 'ErrObjectNotFound' WHEN c.c_mktsegment <> 'BUILDING' THEN 'ObjectTypeError' END AS error
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) c ON o_custkey = c_custkey""")
def exact_fetch(spark, sf_dir):
    objects = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("otype"))
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("id"))
    return stores.exact(ids, objects, "BUILDING", ["id"]).select("qid", "error")


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2000 THEN 'ErrObjectTooLarge' END AS error FROM documents""")
def max_object_size(spark, sf_dir):
    return stores.within_size(table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size")), 2000).select("doc_id", "error")


@query("""SELECT n_nationkey AS id, side FROM (SELECT n_nationkey, 'object' AS side FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'pack' FROM nation WHERE n_nationkey % 3 = 0)""")
def dual_view(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return stores.dual(n.where("id % 2 = 0"), n.where("id % 3 = 0"))


# Bitwise, by the table that eight shifts of each byte make.
_CRC = """WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS v),
d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
b AS (SELECT doc_id, h, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS v FROM d)
SELECT doc_id, CASE WHEN h IS NOT NULL THEN xor(list_reduce(list_concat([4294967295::BIGINT], b.v), lambda c, x: xor(c >> 8, t.v[(xor(c, x) & 255) + 1])), 4294967295) END AS crc32 FROM b, t"""


@query(_CRC)
def crc32_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(O.utf8(F.col("text"))).alias("crc32"))


_ADLER = [("",), ("a",), ("Wikipedia",), ("abc" * 200,)]


@query(f"""WITH v AS (SELECT s FROM {values(_ADLER, 's')}), b AS (SELECT s, length(s) AS n, unnest(range(1, length(s) + 1)) AS i FROM v),
t AS (SELECT s, sum(ascii(substr(s, i::INT, 1))) AS a, sum((n - i + 1) * ascii(substr(s, i::INT, 1))) AS b, max(n) AS n FROM b GROUP BY s)
SELECT v.s, coalesce(((t.n + t.b) % 65521) * 65536 + (1 + t.a) % 65521, 1)::BIGINT AS adler32 FROM v LEFT JOIN t ON v.s = t.s""")
def adler32_text(spark, sf_dir):
    return frame(spark, _ADLER, "s string").select("s", O.adler32(O.utf8(F.col("s"))).alias("adler32"))


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
b AS (SELECT doc_id, h, length(h) // 2 AS n, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS v FROM d)
SELECT doc_id, CASE WHEN h IS NOT NULL THEN ((n + coalesce(list_sum(list_transform(v, lambda x, i: x * (n - i + 1))), 0)) % 65521)::BIGINT * 65536 + ((1 + coalesce(list_sum(v), 0)) % 65521)::BIGINT END AS adler32 FROM b""")
def adler32_documents(spark, sf_dir):
    return O.with_adler32(table(spark, sf_dir, "documents").select("doc_id", O.utf8(F.col("text")).alias("content")), "content").select("doc_id", "adler32")


@query("""WITH b AS (SELECT doc_id, encode(text) AS base, octet_length(encode(text))::INT AS n FROM documents)
SELECT doc_id, hex(CASE WHEN n >= 20 THEN array_slice(base, 1, 10) || encode('<' || doc_id || '>') || array_slice(base, n - 4, n) ELSE encode('<' || doc_id || '>') END) AS content FROM b WHERE n IS NOT NULL""")
def delta_apply_instr(spark, sf_dir):
    base = O.utf8(F.col("text"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    n = F.octet_length("text")
    # instructions copy(0, 10), insert, copy(n-5, 5), as an Arrow codec applies them; the insert alone on short bases
    lit = O.utf8(F.concat(F.lit("<"), F.col("doc_id"), F.lit(">")))
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    varint = lambda c: F.concat(byte(c % 128 + 128), byte(F.floor(c / 128) % 128 + 128), byte(F.floor(c / 16384) % 128 + 128), byte(F.floor(c / 2097152)))
    off = n - 5
    tail = F.concat(F.lit(b"\x9f"), *[byte(F.floor(off / 256**i) % 256) for i in range(4)], F.lit(b"\x05"))
    insert = F.concat(byte(F.octet_length(lit)), lit)
    delta = F.when(n >= 20, F.concat(varint(n), varint(F.lit(15) + F.octet_length(lit)), F.lit(b"\x90\x0a"), insert, tail)).otherwise(F.concat(varint(n), varint(F.octet_length(lit)), insert))
    got = packs.applied(docs.select("doc_id", base.alias("base"), delta.alias("delta")))
    return got.select("doc_id", F.hex("content").alias("content"))
