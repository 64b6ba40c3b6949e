"""References, their names and transactions; configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from objloom.functions import config as cfg
from objloom.functions import objects as O
from objloom.functions import refnames as N
from objloom.operators import refs as R
from objloom.operators.lineage import shared_dir
from objloom.plans import repository
from objloom.queries.base import frame, query, table, values
from objloom.streaming import ingest

_NAMES = [(n,) for n in (
    "refs/heads/main", "refs/heads/a/b", "@", "", "/refs/heads/x", "refs//heads", "refs/heads/", "refs/heads/a..b", "refs/heads/a@{b", "refs/heads/a b", "refs/heads/a~1",
    "refs/heads/.x", "refs/.heads/x", "refs/heads/x.lock", "refs/x.lock/y", "refs/heads/x.", "HEAD", "refs/heads/*", "refs/*/*", "refs/heads/a:b", "refs/heads/a?b", "refs/heads/[", "refs/heads/\\", "refs/heads/^",
    "refs/heads/@", "main", "-x", "refs/tags/v1", "FETCH_HEAD", "ORIG_HEAD", "worktrees/w/HEAD", "worktrees/w/refs/bisect/x", "worktrees/w/refs/heads/x", "worktrees/w", "main-worktree/HEAD", "main-worktree/refs/heads/x", "refs/worktree/x", "refs/bisect/bad", "refs/rewritten/y", "refs/../x", "refs/a/./b", "AUTO_MERGE", "head",
)]
_ALL = f"(SELECT name FROM {values(_NAMES, 'name')} UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT 'refs/' || replace(regexp_replace(url, '^https?://', ''), '.', '/') FROM pages)"
_BAD = r"""(name = '@' OR name = '' OR name LIKE '/%' OR name LIKE '%//%' OR name LIKE '%/' OR name LIKE '%..%' OR name LIKE '%@{%' OR regexp_matches(name, '[\x00-\x20\x7f:?\[\\^~]') OR regexp_matches(name, '(^|/)[.]') OR regexp_matches(name, '[.]lock(/|$)') OR name LIKE '%.')"""


def names(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.concat(F.lit("refs/"), F.translate(F.regexp_replace("url", "^https?://", ""), ".", "/")).alias("name"))
    return frame(spark, _NAMES, "name string").unionAll(table(spark, sf_dir, "part").select("p_name")).unionAll(urls).distinct()


@query(f"SELECT name, NOT {_BAD} AND name NOT LIKE '%*%' AND name LIKE '%/%' AS ok, NOT {_BAD} AND name NOT LIKE '%*%' AS ok_one_level, NOT {_BAD} AND name NOT LIKE '%*%*%' AND name LIKE '%/%' AS ok_pattern FROM {_ALL}")
def refname_validate(spark, sf_dir):
    n = F.col("name")
    return names(spark, sf_dir).select("name", N.is_valid(n).alias("ok"), N.is_valid(n, one_level=True).alias("ok_one_level"), N.is_valid(n, pattern=True).alias("ok_pattern"))


@query(f"SELECT orig, CASE WHEN NOT {_BAD} AND name NOT LIKE '%*%' AND name LIKE '%/%' THEN name END AS normalised FROM (SELECT name AS orig, regexp_replace(regexp_replace(name, '/+', '/', 'g'), '^/', '') AS name FROM {_ALL})")
def refname_normalize(spark, sf_dir):
    n = N.normalised(F.col("name"))
    return names(spark, sf_dir).select(F.col("name").alias("orig"), F.when(N.is_valid(n), n).alias("normalised"))


@query(f"""SELECT orig AS name, CASE WHEN NOT {_BAD} AND name NOT LIKE '%*%' AND orig NOT LIKE '-%' AND orig <> 'HEAD' THEN CASE WHEN orig LIKE 'refs/%' THEN orig ELSE name END END AS branch,
CASE WHEN NOT {_BAD} AND name NOT LIKE '%*%' AND orig NOT LIKE '-%' AND orig <> 'HEAD' THEN 'refs/tags/' || orig END AS tag FROM (SELECT name AS orig, 'refs/heads/' || name AS name FROM {_ALL})""")
def branch_tag_shorthand(spark, sf_dir):
    return names(spark, sf_dir).select("name", N.branch(F.col("name")).alias("branch"), N.tag(F.col("name")).alias("tag"))


_CUR = "(regexp_full_match({0}, '[A-Z_-]*') OR {0} LIKE 'refs/worktree/%' OR {0} LIKE 'refs/bisect/%' OR {0} LIKE 'refs/rewritten/%')"


@query(f"""WITH n AS (SELECT name, regexp_extract(name, '^worktrees/([^/]*)', 1) AS own, regexp_extract(name, '^worktrees/[^/]*/(.*)$', 1) AS rest, regexp_extract(name, '^main-worktree/(.*)$', 1) AS m FROM {_ALL}),
k AS (SELECT *, CASE WHEN regexp_full_match(name, 'worktrees/[^/]*') OR name LIKE 'worktrees/%' AND {_CUR.format('rest')} THEN 'other' WHEN name LIKE 'main-worktree/%' AND {_CUR.format('m')} THEN 'main' WHEN {_CUR.format('name')} THEN 'current' ELSE 'shared' END AS kind FROM n)
SELECT name, kind, CASE WHEN kind = 'other' THEN own ELSE '' END AS worktree, CASE kind WHEN 'other' THEN rest WHEN 'main' THEN m ELSE name END AS bare FROM k""")
def worktree_parse(spark, sf_dir):
    return names(spark, sf_dir).select("name", N.worktree(F.col("name")).alias("w")).select("name", "w.*")


@query(f"""SELECT name, regexp_full_match(name, '[A-Z_-]*') AND name NOT IN ('FETCH_HEAD', 'MERGE_HEAD') AND (name LIKE '%\\_HEAD' ESCAPE '\\' OR name IN ('HEAD', 'AUTO_MERGE', 'BISECT_EXPECTED_REV', 'NOTES_MERGE_PARTIAL', 'NOTES_MERGE_REF', 'MERGE_AUTOSTASH')) AS is_root, regexp_full_match(name, '[A-Z_-]*') AS root_syntax, name IN ('FETCH_HEAD', 'MERGE_HEAD') AS is_pseudo,
CASE WHEN name LIKE 'refs/%' THEN name NOT LIKE '%//%' AND name NOT LIKE '%/' AND NOT regexp_matches(name, '/[.][.]?(/|$)') ELSE regexp_full_match(name, '[A-Z_]+') END AS is_safe FROM {_ALL}""")
def is_root(spark, sf_dir):
    n = F.col("name")
    return names(spark, sf_dir).select("name", N.is_root(n).alias("is_root"), N.is_root_syntax(n).alias("root_syntax"), N.is_pseudo(n).alias("is_pseudo"), N.is_safe(n).alias("is_safe"))


@query()
def refname_sanitize(spark, sf_dir):
    @F.pandas_udf("string")
    def clean(s):
        return s.map(N.sanitised)

    return names(spark, sf_dir).where("name <> ''").select("name", clean("name").alias("sanitised"))


_PATHS = """(SELECT DISTINCT 'refs/' || array_to_string(list_slice(string_split(regexp_replace(url, '^https?://', ''), '/'), 1, 1 + (page_id % 4)::INT), '/') AS name FROM pages)"""


@query(f"SELECT a.name, b.name AS other FROM {_PATHS} a JOIN {_PATHS} b ON a.name <> b.name AND (starts_with(a.name, b.name || '/') OR starts_with(b.name, a.name || '/'))")
def ref_conflicts(spark, sf_dir):
    parts = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    n = table(spark, sf_dir, "pages").select(F.concat(F.lit("refs/"), F.array_join(F.slice(parts, F.lit(1), 1 + (F.col("page_id") % 4).cast("int")), "/")).alias("name"))
    return R.conflicts(n, n)


@query("""SELECT coalesce(l.n_nationkey, p.n_nationkey) AS name, CASE WHEN l.n_nationkey IS NOT NULL THEN l.v ELSE p.v END AS target_id FROM (SELECT n_nationkey, 'loose' || n_nationkey AS v FROM nation WHERE n_nationkey % 2 = 0) l
FULL JOIN (SELECT n_nationkey, 'packed' || n_nationkey AS v FROM nation WHERE n_nationkey % 3 = 0) p ON l.n_nationkey = p.n_nationkey""")
def loose_over_packed(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    side = lambda p, k: n.where(F.col("n_nationkey") % k == 0).select(F.col("n_nationkey").cast("string").alias("name"), F.concat(F.lit(p), F.col("n_nationkey").cast("string")).alias("target_id"))
    return R.visible(side("loose", 2), side("packed", 3)).select(F.col("name").cast("int").alias("name"), "target_id")


# A transaction on references u0..: one operation for each customer, by its number.
_REFS = "SELECT 'refs/heads/u' || c_custkey AS name, sha1(c_name) AS id FROM customer WHERE c_custkey % 4 <> 0"


@query(f"""WITH r AS ({_REFS}), ops AS (SELECT 'refs/heads/u' || c_custkey AS name, CASE c_custkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'verify' END AS kind, sha1('new' || c_custkey) AS new_id FROM customer)
SELECT coalesce(r.name, ops.name) AS name, 'direct' AS kind, CASE WHEN ops.kind IN ('create', 'update') THEN new_id ELSE r.id END AS target_id, NULL::VARCHAR AS target_name FROM r FULL JOIN ops ON r.name = ops.name WHERE coalesce(ops.kind, '') <> 'delete'""")
def ref_txn_apply(spark, sf_dir):
    refs, ops = _txn(spark, sf_dir)
    return R.commit(refs, ops)[0]


def _txn(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, key = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    name, old = F.concat(F.lit("refs/heads/u"), key), F.sha1(F.col("c_name").cast("binary"))
    none = F.lit(None).cast("string")
    refs = c.where(k != 0).select(name.alias("name"), F.lit("direct").alias("kind"), old.alias("target_id"), none.alias("target_name"))
    kind = F.when(k == 0, "create").when(k == 1, "update").when(k == 2, "delete").otherwise("verify")
    ops = c.select(F.col("c_custkey").alias("seq"), kind.alias("kind"), name.alias("name"), F.sha1(F.concat(F.lit("new"), key).cast("binary")).alias("new_id"), old.alias("old_id"), none.alias("new_target"), none.alias("old_target"))
    return refs, ops


@query(f"""WITH r AS ({_REFS}), ops AS (SELECT c_custkey AS seq, 'refs/heads/u' || (c_custkey - CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END) AS name, CASE WHEN c_custkey % 7 = 0 THEN 'update' WHEN c_custkey % 4 = 0 THEN 'create' ELSE 'verify' END AS kind, CASE WHEN c_custkey % 5 = 0 THEN sha1('wrong') ELSE sha1(c_name) END AS old_id FROM customer),
j AS (SELECT ops.*, r.id, row_number() OVER (PARTITION BY ops.name, r.id IS NOT NULL OR kind = 'create' ORDER BY seq) AS again FROM ops LEFT JOIN r USING (name))
SELECT seq, CASE WHEN kind <> 'create' AND id IS NULL THEN 'ErrReferenceNotFound' WHEN again > 1 THEN 'ErrDuplicateUpdate' WHEN kind = 'create' THEN CASE WHEN id IS NOT NULL THEN 'ErrCreateExists' END WHEN id <> old_id THEN 'WrongOldIDError' END AS error FROM j""")
def ref_txn_errors(spark, sf_dir):
    refs, _ = _txn(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    name = F.concat(F.lit("refs/heads/u"), (k - F.when(k % 11 == 0, 1).otherwise(0)).cast("string"))
    kind = F.when(k % 7 == 0, "update").when(k % 4 == 0, "create").otherwise("verify")
    old = F.when(k % 5 == 0, F.sha1(F.lit(b"wrong"))).otherwise(F.sha1(F.col("c_name").cast("binary")))
    ops = c.select(k.alias("seq"), kind.alias("kind"), name.alias("name"), F.lit("x").alias("new_id"), old.alias("old_id"), none.alias("new_target"), none.alias("old_target"))
    return R.prepared(refs, ops).select("seq", "error")


@query(f"""WITH r AS ({_REFS}), ops AS (SELECT c_custkey AS seq, 'refs/heads/u' || c_custkey AS name, CASE c_custkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'verify' END AS kind, CASE WHEN c_custkey % 5 = 0 THEN 'wrong' ELSE sha1(c_name) END AS old_id FROM customer)
SELECT seq, ops.name, CASE WHEN e IS NULL THEN 'applied' ELSE 'rejected' END AS status, e AS error FROM (SELECT ops.*, CASE WHEN kind = 'create' THEN CASE WHEN id IS NOT NULL THEN 'ErrCreateExists' END WHEN id IS NULL THEN 'ErrReferenceNotFound' WHEN id <> old_id THEN 'WrongOldIDError' END AS e FROM ops LEFT JOIN r USING (name)) ops""")
def ref_batch_status(spark, sf_dir):
    refs, ops = _txn(spark, sf_dir)
    store = F.pmod(F.hash("name"), F.lit(16)).cast("string")
    wrong = F.when(F.col("seq") % 5 == 0, "wrong").otherwise(F.col("old_id"))
    return R.batch(refs.withColumn("store", store), ops.withColumn("store", store).withColumn("old_id", wrong)).drop("store")


# Configuration entries from events: source by user, key by event type.
def config_entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    v = F.col("event_id") % 6
    value = F.when(v == 0, "yes").when(v == 1, "off").when(v == 2, F.concat(k, F.lit("k"))).when(v == 3, k).when(v == 4, "").otherwise("maybe")
    kind = F.when(F.col("event_id") % 13 == 0, "valueless").otherwise("string")
    return e.select((F.col("user_id") % 3).alias("source_ord"), F.col("event_id").alias("ord"), F.lit("s").alias("section"), F.col("event_type").alias("subsection"), F.concat(F.lit("k"), (F.col("user_id") % 10).cast("string")).alias("key"), kind.alias("kind"), F.when(kind == "valueless", "").otherwise(value).alias("value"))


_CFG = """WITH c AS (SELECT user_id % 3 AS source_ord, event_id AS ord, 's' AS section, event_type AS subsection, 'k' || (user_id % 10) AS key, CASE WHEN event_id % 13 = 0 THEN 'valueless' ELSE 'string' END AS kind,
CASE WHEN event_id % 13 = 0 THEN '' ELSE CASE event_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'off' WHEN 2 THEN json_extract_string(props, '$.k') || 'k' WHEN 3 THEN json_extract_string(props, '$.k') WHEN 4 THEN '' ELSE 'maybe' END END AS value FROM events) """


@query(_CFG + "SELECT section, subsection, key, arg_max(kind, source_ord * 1000000000 + ord) AS kind, arg_max(value, source_ord * 1000000000 + ord) AS value FROM c GROUP BY 1, 2, 3")
def config_last_wins(spark, sf_dir):
    return repository.last_values(config_entries(spark, sf_dir))


@query(_CFG + "SELECT section, subsection, key, string_agg(value, ',' ORDER BY source_ord, ord) AS all_values FROM c GROUP BY 1, 2, 3")
def config_all(spark, sf_dir):
    return repository.all_values(config_entries(spark, sf_dir)).withColumn("all_values", F.array_join("all_values", ","))


@query(_CFG + """SELECT ord, CASE WHEN kind = 'valueless' OR value = 'yes' THEN TRUE WHEN value IN ('off', '') THEN FALSE WHEN value = 'maybe' THEN NULL ELSE replace(value, 'k', '')::BIGINT <> 0 END AS b FROM c""")
def config_bool(spark, sf_dir):
    return config_entries(spark, sf_dir).select("ord", cfg.bool_column(F.col("kind"), F.col("value")).alias("b"))


@query(_CFG + """SELECT ord, CASE WHEN value IN ('yes', 'off', '', 'maybe') THEN NULL WHEN value LIKE '%k' THEN replace(value, 'k', '')::BIGINT * 1024 ELSE value::BIGINT END AS n FROM c""")
def config_int(spark, sf_dir):
    return config_entries(spark, sf_dir).select("ord", cfg.int_column(F.col("value")).alias("n"))


@query("SELECT (user_id % 7)::BIGINT AS file, count(*)::BIGINT AS n, max(event_id)::BIGINT AS last FROM events GROUP BY 1")
def config_parse(spark, sf_dir):
    """Configuration text written from events, and parsed again."""
    from objloom.sources.files import configs

    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("file"), "event_id", F.concat(F.lit("\tkey = "), F.col("event_id").cast("string"), F.lit(" ; c\n")).alias("line"))
    lines = e.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda r: r["line"]), "").alias("t"))
    text = lines.select(F.col("file").cast("string").alias("path"), F.concat(F.lit('# top\n[Sec "Sub"]\n'), "t").cast("binary").alias("content"))
    got = configs(text).where("error IS NULL")
    return got.groupBy(F.col("path").cast("long").alias("file")).agg(F.count("*").alias("n"), F.max(F.col("value").cast("string").cast("long")).alias("last"))


_EXT = [(0, "noop", ""), (0, "objectformat", "sha1"), (0, "whatever", ""), (1, "whatever", ""), (1, "objectformat", "sha256"), (1, "objectformat", "md5"), (1, "refstorage", "files"), (1, "refstorage", "reftable"), (2, "noop", ""), (1, "compatobjectformat", "sha1"), (1, "worktreeconfig", "true"), (0, "refstorage", "files")]


@query(f"""SELECT version, name, value, CASE WHEN version NOT IN (0, 1) THEN 'ErrConfig: version' WHEN version = 0 AND name IN ('noop-v1', 'objectformat', 'compatobjectformat', 'refstorage', 'relativeworktrees', 'submodulepathconfig') THEN 'ErrConfig: needs version 1' WHEN name = 'compatobjectformat' THEN 'ErrConfig: unsupported'
WHEN version = 1 AND name = 'whatever' THEN 'ErrConfig: unknown extension' WHEN name = 'objectformat' AND value NOT IN ('sha1', 'sha256') THEN 'ErrConfig: object format' WHEN name = 'refstorage' AND value <> 'files' THEN 'ErrConfig: reference storage' END AS error FROM {values(_EXT, 'version, name, value')}""")
def repository_format(spark, sf_dir):
    return frame(spark, _EXT, "version int, name string, value string").withColumn("error", repository.extension_error(F.col("version"), F.col("name"), F.col("value")))


@query("SELECT DISTINCT octet_length(encode(text))::BIGINT AS size, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS oid FROM documents WHERE text IS NOT NULL")
def ingest_stream(spark, sf_dir):
    """A file stream of documents, read to its end and written to a content-addressed store, by the library's stream."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[d]ocuments.parquet")  # a pattern, as the table may be a file or a folder
    ingest.objects_from(stream.where("text IS NOT NULL").select(O.utf8(F.col("text")).alias("content")), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("size", F.lower(F.hex("oid")).alias("oid"))
