"""Names over several sources, chains of reference stores, symbolic transactions, the log of updates, and full configuration values."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from objloom.functions import config as cfg
from objloom.functions import objects as O
from objloom.operators import refs as R
from objloom.operators.lineage import shared_dir
from objloom.plans import repository
from objloom.queries.base import query, table
from objloom.queries.ref_queries import _CFG, config_entries
from objloom.sources import files as S
from objloom.streaming import ingest as streams


def _name(prefix: str, column: str = "c_custkey"):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@query("""SELECT 'HEAD' AS name UNION SELECT 'refs/heads/u' || c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'refs/bisect/u' || c_custkey FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 <> 0 UNION SELECT 'refs/heads/u' || c_custkey FROM customer WHERE c_custkey % 2 = 0""")
def visible_names(spark, sf_dir):
    """HEAD, loose names of the common folder and of the worktree, and packed names; lock files aren't names."""
    c = table(spark, sf_dir, "customer")
    head = spark.createDataFrame([("HEAD",)], "name string")
    lock = F.when(F.col("c_custkey") % 2 == 0, ".lock").otherwise("")
    worktree = c.where("c_custkey % 5 = 0").select(F.concat(_name("refs/bisect/u"), lock).alias("name"))
    return R.all_names(head, c.where("c_custkey % 3 = 0").select(_name("refs/heads/u").alias("name")), worktree, c.where("c_custkey % 2 = 0").select(_name("refs/heads/u").alias("name")))


@query("SELECT 'u' || c_custkey AS name, c_name AS target_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0)")
def ref_survivors(spark, sf_dir):
    """Packed references that a rewrite keeps: those that no order deletes."""
    packed = table(spark, sf_dir, "customer").select(_name("u").alias("name"), F.col("c_name").alias("target_id"))
    return R.survivors(packed, table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(_name("u", "o_custkey").alias("name")))


@query("""WITH a AS (SELECT 'n' || n_nationkey AS name, 0 AS backend, CASE WHEN n_nationkey % 4 = 0 THEN 'n' || (n_nationkey + 1) END AS target_name, CASE WHEN n_nationkey % 4 <> 0 THEN 'a' || n_nationkey END AS target_id, n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 0),
b AS (SELECT 'n' || n_nationkey AS name, 1 AS backend, NULL::VARCHAR AS target_name, 'b' || n_nationkey AS target_id, n_nationkey AS k FROM nation),
v AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM a))
SELECT v.name, v.backend, coalesce(v.target_id, t.target_id) AS target_id, CASE WHEN coalesce(v.target_id, t.target_id) IS NULL THEN 'ErrReferenceNotFound' END AS error FROM v LEFT JOIN v t ON v.target_name = t.name""")
def ref_chain(spark, sf_dir):
    """Two stores, the first over the second; a symbolic reference of one may have its target in the other."""
    n = table(spark, sf_dir, "nation")
    k, none = F.col("n_nationkey"), F.lit(None).cast("string")
    symbolic = k % 4 == 0
    a = n.where(k % 2 == 0).select(_name("n", "n_nationkey").alias("name"), F.when(symbolic, "symbolic").otherwise("direct").alias("kind"), F.when(~symbolic, _name("a", "n_nationkey")).alias("target_id"), F.when(symbolic, F.concat(F.lit("n"), (k + 1).cast("string"))).alias("target_name"))
    b = n.select(_name("n", "n_nationkey").alias("name"), F.lit("direct").alias("kind"), _name("b", "n_nationkey").alias("target_id"), none.alias("target_name"))
    both = R.chained([a, b])
    return R.resolve_symbolic(both).join(both.select("name", "backend"), "name").select("name", "backend", "target_id", "error")


# Branches b0..; an alias a<k> of each; operations on the aliases by their number.
_SYM = """WITH k AS (SELECT c_custkey AS k FROM customer), ops AS (SELECT k AS seq, CASE WHEN k % 6 = 3 THEN 'refs/heads/b' || k WHEN k % 6 = 4 THEN 'refs/none/a' || k ELSE 'refs/alias/a' || k END AS name FROM k)"""


def _symbolic(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    branch, alias, value = _name("refs/heads/b"), _name("refs/alias/a"), F.sha1(F.col("c_name").cast("binary"))
    refs = c.select(branch.alias("name"), F.lit("direct").alias("kind"), value.alias("target_id"), none.alias("target_name")).unionAll(c.select(alias, F.lit("symbolic"), none, branch))
    kind = F.when(k % 6 == 0, "create-symbolic").when(k % 6 == 1, "update-symbolic").when(k % 6 == 2, "update-symbolic").when(k % 6 == 3, "delete-symbolic").when(k % 6 == 4, "verify-symbolic").otherwise("update")
    name = F.when(k % 6 == 3, branch).when(k % 6 == 4, _name("refs/none/a")).otherwise(alias)
    old = F.when(k % 6 == 2, "refs/heads/other").when(k % 6 == 0, none).otherwise(branch)
    ops = c.select(k.alias("seq"), kind.alias("kind"), name.alias("name"), F.lit("new").alias("new_id"), value.alias("old_id"), F.lit("refs/heads/x").alias("new_target"), old.alias("old_target"))
    return refs, ops


@query(_SYM + """SELECT seq, CASE WHEN seq % 6 = 5 THEN 'refs/heads/b' || seq ELSE name END AS target,
CASE seq % 6 WHEN 0 THEN 'ErrCreateExists' WHEN 2 THEN 'WrongOldTargetError' WHEN 3 THEN 'ErrExpectedSymbolic' WHEN 4 THEN 'ErrReferenceNotFound' END AS error FROM ops""")
def symref_txn_errors(spark, sf_dir):
    """Operations on symbolic references themselves, and a direct one that goes through an alias to its branch."""
    refs, ops = _symbolic(spark, sf_dir)
    return R.prepared(refs, ops).select("seq", "target", "error")


@query(_SYM + """SELECT 'refs/heads/b' || c_custkey AS name, 'direct' AS kind, CASE WHEN c_custkey % 6 = 5 THEN 'new' ELSE sha1(c_name) END AS target_id, NULL::VARCHAR AS target_name FROM customer
UNION ALL SELECT 'refs/alias/a' || c_custkey, 'symbolic', NULL, CASE WHEN c_custkey % 6 = 1 THEN 'refs/heads/x' ELSE 'refs/heads/b' || c_custkey END FROM customer""")
def symref_txn_apply(spark, sf_dir):
    """The references after a transaction of those operations that are good."""
    refs, ops = _symbolic(spark, sf_dir)
    return R.commit(refs, ops.where("seq % 6 IN (1, 5)"))[0]


@query("""WITH e AS (SELECT user_id % 8 AS store, event_id AS seq, 'refs/heads/u' || user_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT store::VARCHAR AS store, seq, name, CASE WHEN k % 3 = 0 THEN 'rejected' ELSE 'applied' END AS status, CASE WHEN k % 3 = 0 THEN 'ErrCreateExists' END AS error FROM e""")
def ref_log_stream(spark, sf_dir):
    """A stream of updates, each on its own, with every store's references as state: create, update, create again (refused), update, …"""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    k = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    ops = e.select((F.col("user_id") % 8).cast("string").alias("store"), F.col("event_id").alias("seq"), _name("refs/heads/u", "user_id").alias("name"), k.alias("k"))
    value = lambda i: F.concat(F.lit("v"), i.cast("string"))
    last = F.when((F.col("k") - 1) % 3 == 0, F.col("k") - 2).otherwise(F.col("k") - 1)  # the number of the operation before it that was applied
    kind = F.when((F.col("k") == 1) | (F.col("k") % 3 == 0), "create").otherwise("update")
    none = F.lit(None).cast("string")
    ops = ops.select("store", "seq", kind.alias("kind"), "name", value(F.col("k")).alias("new_id"), value(last).alias("old_id"), none.alias("new_target"), none.alias("old_target"))
    base = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    ops.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(ops.schema).parquet(f"{base}/in")
    streams.ref_log(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("store string, seq long, name string, status string, error string").parquet(f"{base}/out")


# Integers in every form, from the users of events.
_FORMS = """WITH e AS (SELECT event_id, user_id AS n, event_id % 10 AS f FROM events),
t AS (SELECT event_id, n, f, CASE f WHEN 0 THEN '0x' || printf('%x', n) WHEN 1 THEN '0b' || printf('%b', n) WHEN 2 THEN '0' || printf('%o', n) WHEN 3 THEN '0o' || printf('%o', n) WHEN 4 THEN '1_' || (n % 10) WHEN 5 THEN ' -' || n || 'K' WHEN 6 THEN '08' WHEN 7 THEN '' WHEN 8 THEN '9007199254740992k' ELSE n || 'g' END AS v FROM e) """


def _forms(spark, sf_dir):
    n, f = F.col("user_id"), F.col("event_id") % 10
    digits = lambda base: F.lower(F.conv(n.cast("string"), 10, base))
    text = (
        F.when(f == 0, F.concat(F.lit("0x"), digits(16))).when(f == 1, F.concat(F.lit("0b"), digits(2))).when(f == 2, F.concat(F.lit("0"), digits(8))).when(f == 3, F.concat(F.lit("0o"), digits(8)))
        .when(f == 4, F.concat(F.lit("1_"), (n % 10).cast("string"))).when(f == 5, F.concat(F.lit(" -"), n.cast("string"), F.lit("K"))).when(f == 6, "08").when(f == 7, "").when(f == 8, "9007199254740992k").otherwise(F.concat(n.cast("string"), F.lit("g")))
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("v"))


@query(_FORMS + """SELECT event_id, v, CASE WHEN f < 4 THEN n WHEN f = 4 THEN 10 + n % 10 WHEN f = 5 THEN -n * 1024 WHEN f = 9 THEN n * 1073741824 END::BIGINT AS value,
CASE f WHEN 6 THEN 'ErrValueSyntax' WHEN 7 THEN 'ErrValueEmpty' WHEN 8 THEN 'ErrValueRange' END AS error FROM t""")
def config_integer(spark, sf_dir):
    """Base-0 literals with factors, and what is wrong with others."""
    return _forms(spark, sf_dir).select("event_id", "v", cfg.int_struct(F.col("v")).alias("i")).select("event_id", "v", "i.value", "i.error")


@query(_FORMS + """SELECT event_id, CASE WHEN f < 4 THEN n <> 0 WHEN f = 4 THEN TRUE WHEN f = 5 THEN CASE WHEN n * 1024 <= 2147483648 THEN n <> 0 END WHEN f = 7 THEN FALSE WHEN f = 9 THEN CASE WHEN n * 1073741824 < 2147483648 THEN n <> 0 END END AS b FROM t""")
def config_boolean(spark, sf_dir):
    """Booleans of any integer form within 32 bits."""
    return _forms(spark, sf_dir).select("event_id", cfg.bool_column(F.lit("string"), F.col("v")).alias("b"))


@query(_CFG + """, l AS (SELECT section, subsection, key, arg_max(kind, source_ord * 1000000000 + ord) AS kind, arg_max(value, source_ord * 1000000000 + ord) AS value FROM c GROUP BY 1, 2, 3),
a AS (SELECT DISTINCT 's' AS section, event_type AS subsection, 'k' || (user_id % 12) AS key FROM events)
SELECT a.*, CASE WHEN l.kind = 'string' THEN value END AS value, CASE WHEN l.kind IS NULL THEN 'ErrMissing' WHEN l.kind = 'valueless' THEN 'ErrValueless' END AS error FROM a LEFT JOIN l USING (section, subsection, key)""")
def config_string(spark, sf_dir):
    """Strings of keys, some of which have no entry and some no value."""
    asked = table(spark, sf_dir, "events").select(F.lit("s").alias("section"), F.col("event_type").alias("subsection"), F.concat(F.lit("k"), (F.col("user_id") % 12).cast("string")).alias("key")).distinct()
    return repository.string_value(asked, config_entries(spark, sf_dir))


@query(_CFG + """SELECT 'on' AS flag, section, subsection, key, arg_max(value, least(source_ord, 1) * 1000000000 + ord) AS value FROM c GROUP BY ALL
UNION ALL SELECT 'off', section, subsection, key, arg_max(value, ord) FROM c WHERE source_ord = 0 GROUP BY ALL""")
def config_effective(spark, sf_dir):
    """A worktree's configuration over the common one, if the extension says so."""
    e = config_entries(spark, sf_dir)
    common, worktree = e.where("source_ord = 0").drop("source_ord"), e.where("source_ord > 0").drop("source_ord")
    flag = spark.createDataFrame([(0, "extensions", "", "worktreeconfig", "string", "yes")], common.schema)
    out = [repository.last_values(repository.effective(c, worktree)).where("section = 's'").select(F.lit(name).alias("flag"), "section", "subsection", "key", "value") for name, c in (("on", common.unionByName(flag)), ("off", common))]
    return out[0].unionByName(out[1])


@query(_CFG + "SELECT section, subsection, key, arg_max(value, (2 - source_ord) * 1000000000 + ord) AS value FROM c GROUP BY 1, 2, 3")
def config_merge(spark, sf_dir):
    """Three configurations one after another, in the order given: later ones win."""
    e = config_entries(spark, sf_dir)
    parts = [e.where(F.col("source_ord") == k).drop("source_ord") for k in (2, 1, 0)]
    return repository.last_values(repository.merged(*parts)).drop("kind")


@query("""SELECT c_custkey, (c_custkey * 86400)::BIGINT AS unix, strftime(make_timestamp(c_custkey * 86400000000), '%Y-%m-%d') AS day FROM customer""")
def identity_instant(spark, sf_dir):
    """Instants of identities."""
    at = O.instant(F.col("c_custkey") * 86400)
    return table(spark, sf_dir, "customer").select("c_custkey", F.unix_timestamp(at).alias("unix"), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd").alias("day"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN sha1(o_orderkey::VARCHAR) WHEN 1 THEN sha1(o_orderkey::VARCHAR) END AS oid, CASE WHEN o_orderkey % 4 > 1 THEN TRUE ELSE FALSE END AS bad FROM orders""")
def oid_parse(spark, sf_dir):
    """Identifiers in lower and upper case; short ones and other letters are refused."""
    k, sha = F.col("o_orderkey") % 4, F.sha1(F.col("o_orderkey").cast("string").cast("binary"))
    text = F.when(k == 0, sha).when(k == 1, F.upper(sha)).when(k == 2, F.substring(sha, 1, 39)).otherwise(F.concat(F.substring(sha, 1, 39), F.lit("g")))
    got = table(spark, sf_dir, "orders").select("o_orderkey", O.parse_oid(text, "sha1").alias("oid"))
    return got.select("o_orderkey", F.lower(F.hex("oid")).alias("oid"), F.col("oid").isNull().alias("bad"))


@query("SELECT n_nationkey, 'body' || n_nationkey || chr(10) AS payload, '-----BEGIN PGP SIGNATURE-----' || chr(10) || n_name || chr(10) AS signature FROM nation")
def signed_tag_split(spark, sf_dir):
    """Tags with a signature at their end, as it was stored."""
    n = table(spark, sf_dir, "nation")
    body = F.concat(F.lit("body"), F.col("n_nationkey").cast("string"), F.lit("\n-----BEGIN PGP SIGNATURE-----\n"), F.col("n_name"), F.lit("\n"))
    keyed = n.select("n_nationkey", F.lit("tag").alias("otype"), body.cast("binary").alias("content"), F.unhex(F.sha1(F.col("n_name").cast("binary"))).alias("oid"))
    got = S.signed_payloads(keyed.select("oid", "otype", "content"), "tag")
    return keyed.join(got, "oid").select("n_nationkey", F.col("payload").cast("string").alias("payload"), F.col("sha1_signature").cast("string").alias("signature"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN 'ErrInvalidTag' WHEN 2 THEN 'ErrInvalidTag' END AS error FROM nation""")
def tag_names(spark, sf_dir):
    """Tag objects whose names are checked: HEAD, a dash in front and two dots aren't names; bytes that aren't UTF-8 are."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, F.lit(b"v1")).when(k % 4 == 1, F.lit(b"-v")).when(k % 4 == 2, F.lit(b"a..b")).otherwise(F.lit(b"v\xff\xfe"))
    head = F.concat(F.lit("object "), F.sha1(F.col("n_name").cast("binary")), F.lit("\ntype blob\ntag ")).cast("binary")
    content = F.concat(head, name, F.lit(b"\ntagger \xff\xfe <t@x> "), k.cast("string").cast("binary"), F.lit(b" +0000\n\nmessage"))
    keyed = n.select("n_nationkey", content.alias("content")).withColumn("oid", F.unhex(F.sha1("content"))).withColumn("otype", F.lit("tag"))
    return keyed.select("n_nationkey", "oid").join(S.parsed_objects(keyed.select("oid", "otype", "content"))["tags"].select("oid", "error"), "oid").select("n_nationkey", "error")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'ParseError:2' END AS error, CASE WHEN c_custkey % 5 <> 4 THEN CASE WHEN c_custkey % 5 = 0 THEN 'FFFE' ELSE upper(hex(encode(c_name))) END END AS value FROM customer""")
def config_bytes(spark, sf_dir):
    """Configuration files with values of any bytes, and some that can't be parsed."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    line = F.when(k % 5 == 0, F.lit(b"key = \xff\xfe\n")).when(k % 5 == 4, F.lit(b"1 = 2\n")).otherwise(F.concat(F.lit(b'key = "'), F.col("c_name").cast("binary"), F.lit(b'" # c\n')))
    got = S.configs(c.select(k.cast("string").alias("path"), F.concat(F.lit(b"[s]\n"), line).alias("content")))
    return got.select(F.col("path").cast("long").alias("c_custkey"), "error", F.hex("value").alias("value"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'symbolic' END AS kind, CASE c_custkey % 4 WHEN 1 THEN '726566732F68656164732FFF' END AS target, CASE WHEN c_custkey % 4 > 1 THEN 'ErrInvalidValue' END AS error FROM customer""")
def ref_bytes(spark, sf_dir):
    """Loose references with targets of any bytes, and thousands of digits where an id should be."""
    from objloom.functions import codecs as C

    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.sha1(F.col("c_name").cast("binary")).cast("binary")).when(k % 4 == 1, F.lit(b"ref: refs/heads/\xff\n")).when(k % 4 == 2, F.repeat(F.lit("9"), 5000).cast("binary")).otherwise(F.lit(b"\xff\xfe"))

    def rows(path, data):
        kind, target = C.parse_loose_ref(data, "sha1")
        yield {"kind": kind, "target_name": target if kind == "symbolic" else None}

    got = S._decoded(c.select(k.cast("string").alias("path"), text.alias("content")), "path string, kind string, target_name binary, error string", rows)
    return got.select(F.col("path").cast("long").alias("c_custkey"), "kind", F.hex("target_name").alias("target"), "error")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'blob' END AS otype, CASE c_custkey % 3 WHEN 1 THEN 'ErrInvalidHeader' WHEN 2 THEN 'ErrInvalidSignature' END AS error FROM customer""")
def long_digits(spark, sf_dir):
    """Numbers of thousands of digits are errors of their object, not of the job."""
    from objloom.functions import codecs as C

    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    nines = F.repeat(F.lit("9"), 5000)
    text = F.when(k == 0, F.concat(F.lit("blob "), F.repeat(F.lit("0"), 5000), F.lit("3\0abc"))).when(k == 1, F.concat(F.lit("blob "), nines, F.lit("\0abc"))).otherwise(F.concat(F.lit("A <a@x> "), nines, F.lit(" +0000")))

    def rows(path, data):
        if data.startswith(b"blob"):
            yield {"otype": C.parse_framed(data)[0]}
        else:
            C.parse_identity(data)

    return S._decoded(c.select(F.col("c_custkey").cast("string").alias("path"), text.cast("binary").alias("content")), "path string, otype string, error string", rows).select(F.col("path").cast("long").alias("c_custkey"), "otype", "error")
