import random
import subprocess
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from objloom.functions import codecs as C
from objloom.functions import objects as O
from objloom.operators import graph, packs, refs, stores
from objloom.plans import repository
from objloom.sources import files as S
from objloom.streaming import ingest

def ref(name, target):
    return (name, "symbolic", None, target[1:]) if target.startswith("@") else (name, "direct", target, None)


def refs_frame(spark, rows, store=None):
    return spark.createDataFrame([ref(*r) for r in rows], "name string, kind string, target_id string, target_name string")


OPS = "seq long, name string, kind string, new_id string, old_id string, new_target string, old_target string"


def ops_frame(spark, rows):
    return spark.createDataFrame([(i, *r, *[None] * (6 - len(r))) for i, r in enumerate(rows)], OPS)


SCENARIOS = [
    ([("refs/a", "1")], [("refs/b", "create", "2")], None),
    ([("refs/a", "1")], [("refs/a", "create", "2")], "ErrCreateExists"),
    ([("refs/a", "1")], [("refs/a", "update", "2", "1"), ("refs/b", "create", "3")], None),
    ([("refs/a", "1")], [("refs/a", "update", "2", "9")], "WrongOldIDError"),
    ([("refs/a", "1")], [("refs/b", "update", "2", "1")], "ErrReferenceNotFound"),
    ([("refs/a", "1")], [("refs/a/b", "create", "2")], "NameConflictError"),
    ([("refs/a", "1")], [("refs/a", "delete", None, "1"), ("refs/a/b", "create", "2")], None),
    ([], [("refs/a", "create", "1"), ("refs/a/b", "create", "2")], "NameConflictError"),
    ([("HEAD", "@refs/a"), ("refs/a", "1")], [("HEAD", "update", "2", "1"), ("refs/a", "update", "3", "1")], "ErrDuplicateUpdate"),
    ([("HEAD", "@refs/a")], [("HEAD", "create", "2")], None),
    ([("HEAD", "@refs/a"), ("refs/a", "@HEAD")], [("HEAD", "create", "2")], "ErrSymbolicCycle"),
    ([("HEAD", "@refs/a"), ("refs/a", "1")], [("HEAD", "update-symbolic", None, None, "refs/b", "refs/a")], None),
    ([("HEAD", "@refs/a"), ("refs/a", "1")], [("HEAD", "update-symbolic", None, None, "refs/b", "refs/x")], "WrongOldTargetError"),
    ([("refs/a", "1")], [("refs/a", "delete-symbolic", None, None, None, "refs/x")], "ErrExpectedSymbolic"),
    ([("refs/a", "1")], [("refs/a", "verify", None, "1")], None),
]


@pytest.mark.parametrize(("known", "ops", "error"), SCENARIOS)
def test_transactions(spark, known, ops, error):
    """The set-based transaction and the sequential store agree."""
    after, first = refs.commit(refs_frame(spark, known), ops_frame(spark, ops))
    assert [r.error for r in first.collect()] == ([error] if error else [])
    got = {r.name: (r.kind, r.target_id or r.target_name) for r in after.collect()}
    plain = {n: ("symbolic", t[1:]) if t.startswith("@") else ("direct", t) for n, t in known}
    store = refs._Store(dict(plain))
    rows = [type("Op", (), dict(zip(("name", "kind", "new_id", "old_id", "new_target", "old_target"), [*r, *[None] * (6 - len(r))], strict=True))) for r in ops]
    bad = store.first_error(rows)
    assert (bad and bad[1]) == error
    if not error:
        store.apply(rows)
    assert got == store.refs


def test_batch():
    op = lambda *r: type("Op", (), dict(zip(("name", "kind", "new_id", "old_id", "new_target", "old_target"), [*r, *[None] * (6 - len(r))], strict=True)))
    got, after = refs.run_batch({"refs/a": ("direct", "1")}, [op("refs/b", "create", "2"), op("refs/b", "create", "3"), op("refs/a", "update", "4", "9"), op("refs/a/x", "create", "5"), op("refs/c", "delete", None, "1")])
    assert got == [("applied", None), ("rejected", "ErrDuplicateUpdate"), ("rejected", "NameConflictError"), ("rejected", "NameConflictError"), ("rejected", "ErrReferenceNotFound")]
    assert after == {"refs/a": ("direct", "1"), "refs/b": ("direct", "2")}
    # of two that conflict, the earlier one is dropped
    got, _ = refs.run_batch({}, [op("refs/a", "create", "1"), op("refs/a/b", "create", "2")])
    assert [s for s, _ in got] == ["rejected", "applied"]
    # a conflict of a target that no operation is named after stops the rest
    got, _ = refs.run_batch({"HEAD": ("symbolic", "refs/a/b"), "refs/a": ("direct", "1")}, [op("HEAD", "create", "1"), op("refs/z", "create", "2")])
    assert [s for s, _ in got] == ["not-attempted", "not-attempted"]


def by_rounds(known, ops):
    """A batch as it is defined: targets first, then rounds that each drop the first error's operation."""
    store, out, left, targets = refs._Store(dict(known)), [("not-attempted", None)] * len(ops), [], set()
    for i, o in enumerate(ops):
        t, e = store.target(o)
        if e and e not in refs.REJECTED:
            return out[:i] + [("fatal", e)] + [("not-attempted", e)] * (len(ops) - i - 1), store.refs
        if e or t in targets:
            out[i] = ("rejected", e or "ErrDuplicateUpdate")
        else:
            targets.add(t)
            left.append(i)
    while bad := store.first_error([ops[i] for i in left]):
        at = next((i for i in left if ops[i].name == bad[0]), None)
        for i in [at] if at is not None else left:
            out[i] = ("rejected" if at is not None else "not-attempted", bad[1])
        if at is None:
            return out, store.refs
        left.remove(at)
    store.apply([ops[i] for i in left])
    for i in left:
        out[i] = ("applied", None)
    return out, store.refs


def test_batches_one_after_another_are_as_defined():
    """Random batches on one store, on names above and below each other, symbolic ones and deletions that are refused."""
    r = random.Random(5)
    names = ["a", "a/b", "a/b/c", "a/d", "b", "b/c", "H", "I", "J"]
    seen = set()
    for _ in range(4000):
        target = lambda: r.choice([*names, *names, ""] if r.random() < 0.1 else names)
        known = {n: ("symbolic", target()) if n in "HIJ" or r.random() < 0.1 else ("direct", r.choice("12")) for n in names if r.random() < 0.5}
        store, before = refs._Store(dict(known)), dict(known)
        for _ in range(3):
            value = lambda: r.choice("12")
            ops = [refs.Op(r.choice(names), r.choice(refs.KINDS), value(), value(), r.choice(names), r.choice(names)) for _ in range(r.choice([1, 2, 5, 9]))]
            expected, after = by_rounds(before, ops)
            assert (store.run(ops), store.refs) == (expected, after), (before, ops)
            fresh = refs._Names(after)
            assert (store.names.own, store.names.above) == (fresh.own, fresh.above)
            assert refs.run_batch(before, ops) == (expected, after)
            before = dict(after)
            seen |= set(expected)
    assert {e for _, e in seen} >= refs.REJECTED - {"ErrExpectedDirect"} and {s for s, _ in seen} == {"applied", "rejected", "fatal", "not-attempted"}


def test_a_batch_of_many_refused_operations():
    """Work grows with the operations, not with the rounds times the operations."""
    n = 40_000
    known = {f"refs/heads/u{i}": ("direct", "1") for i in range(n)}
    ops = [refs.Op(f"refs/heads/u{i}", "delete" if i % 2 else "update", "2", "1" if i % 4 > 1 else "9", None, None) for i in range(n)]
    ops += [refs.Op(f"refs/heads/u{i}/x", "create", "2", None, None, None) for i in range(n)]
    begin = time.process_time()
    got, after = refs.run_batch(known, ops)
    assert time.process_time() - begin < 20
    assert got[:n] == [("applied", None) if i % 4 == 3 else ("rejected", "WrongOldIDError" if i % 2 else "NameConflictError") for i in range(n)]
    assert got[n:] == [("applied", None) if i % 4 == 3 else ("rejected", "NameConflictError") for i in range(n)]
    assert len(after) == n


def test_validated(spark):
    rows = [("refs/heads/a", "create", "1"), ("MERGE_HEAD", "create", "1"), ("bad..name", "update", "1"), ("HEAD", "create-symbolic", None, None, "refs/tags/x"), ("HEAD", "create-symbolic", None, None, "refs/heads/x"), ("refs/x", "delete", None, "1"), ("refs/../x", "delete", None, "1"), ("refs/heads/s", "create-symbolic", None, None, "")]
    got = [r.invalid for r in refs.validated(ops_frame(spark, rows)).orderBy("seq").collect()]
    assert got == [None, "ErrInvalidName", "ErrInvalidName", "ErrInvalidName", None, None, "ErrInvalidName", "ErrInvalidValue"]


def test_chains(spark):
    edges = [(i, i + 1) for i in range(3000)] + [(9001, 9002), (9002, 9001), (9003, 9001)]
    got = {r.node: r for r in graph.resolve_chains(spark.createDataFrame(edges, "node long, next long")).collect()}
    assert all((got[i].terminal, got[i].hops, got[i].cycle) == (3000, 3000 - i, False) for i in range(3000))
    assert all(got[i].cycle and got[i].terminal is None for i in (9001, 9002, 9003))


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "content binary")
    path = str(tmp_path / "store")
    assert stores.write(rows, path).count() == 2
    assert stores.write(rows.unionAll(spark.createDataFrame([(b"c",)], "content binary")), path).count() == 3
    store = spark.read.parquet(path)
    q = stores.Quarantine(store, path)
    new = stores.with_ids(spark.createDataFrame([(b"d",), (b"a",)], "content binary"), F.col("content")).select(store.columns)
    q.add(new)
    assert q.view().count() == 4 and spark.read.parquet(path).count() == 3
    q.discard()
    assert q.view().count() == 3
    q.add(new)
    q.promote()
    assert spark.read.parquet(path).count() == 4


@pytest.mark.parametrize("fmt", ["sha1", "sha256"])
def test_packs_end_to_end(spark, tmp_path, fmt):
    r = random.Random(4)
    texts, content = [], b""
    for i in range(40):
        content = content[: r.randrange(len(content) + 1)] + bytes(r.randrange(97, 123) for _ in range(30))
        texts.append(content)
    ids = [C.object_id("blob", t, fmt) for t in texts]
    whole = C.build_pack([("blob", texts[0])] + [("ofs", C.build_delta(texts[i - 1], texts[i]), i - 1) if i % 2 else ("ref", C.build_delta(texts[i - 1], texts[i]), ids[i - 1]) for i in range(1, 40)], fmt)
    thin = C.build_pack([("ref", C.build_delta(texts[3], b"thin one"), ids[3])], fmt)
    lost = C.build_pack([("ref", C.build_delta(texts[3], b"lost"), b"\1" * C.SIZES[fmt])], fmt)
    files = spark.createDataFrame([("p", whole), ("t", thin), ("l", lost), ("x", whole[:-1] + b"?")], "path string, content binary")
    external = spark.createDataFrame([(ids[3], "blob", texts[3])], "oid binary, otype string, content binary")
    out = str(tmp_path / "out")
    got = {r.pack: (r.objects, r.error) for r in packs.ingest(files, out, fmt, external=external).collect()}
    assert sorted(got.values(), key=str) == sorted([(40, None), (2, None), (0, "ErrMissingBases"), (0, "ErrMalformedPack")], key=str)
    objects = packs.published(spark, out, "objects")
    assert {bytes(r.oid) for r in objects.collect()} == {*ids, C.object_id("blob", b"thin one", fmt)}
    assert objects.agg(F.max("depth")).first()[0] == 39
    again = packs.ingest(files, out, fmt, external=external)
    assert packs.manifest(spark, out).count() == 2 and again.where("error IS NULL").count() == 0
    e = packs.scan(files.where("path IN ('p', 'l')"), fmt)
    done = packs.resolve(e, fmt)
    assert packs.missing_bases(e, done).count() == 1 and packs.explain(e, done).where("note IS NOT NULL").count() == 1
    # the filter of expressions is that of the codec
    table = C.parse_bloom(C.build_bloom(ids, b"\0" * C.SIZES[fmt], fmt), fmt)[2]
    words = {(r.bucket, r.word): r.mask & (2**64 - 1) for r in packs.bloom(spark.createDataFrame([("p", i) for i in ids], "pack string, oid binary")).collect()}
    assert words == {(k // 8, k % 8): w for k in range(len(table) // 8) if (w := int.from_bytes(table[8 * k : 8 * k + 8], "big"))}


def test_streams(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.pack").write_bytes(C.build_pack([("blob", b"one")], "sha1"))
    for expected in (1, 2):
        ingest.packs_from(spark, str(drop), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert packs.manifest(spark, str(tmp_path / "out")).count() == expected
        (drop / "b.pack").write_bytes(C.build_pack([("blob", b"two")], "sha1"))


def log_of(spark, path, rows):
    """Write updates as a new file of the stream's folder."""
    schema = "store string, seq long, kind string, name string, new_id string, old_id string, new_target string, old_target string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{path}/in")
    ingest.ref_log(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_a_log_goes_on_from_its_state(spark, tmp_path):
    """Updates of two runs, in order of seq, against one batch for each."""
    r = random.Random(3)
    known, expected = {"x": {}, "y": {}}, {}
    for part in range(2):
        ops = [(r.choice("xy"), part * 100 + i, refs.Op(r.choice(["a", "a/b", "c", "H"]), r.choice(refs.KINDS), *r.choices("12", k=2), *r.choices(["a", "c", "H"], k=2))) for i in range(100)]
        for s, seq, op in ops:
            (expected[seq],), known[s] = refs.run_batch(known[s], [op])
        rows = [(s, seq, op.kind, op.name, *op[2:]) for s, seq, op in ops]
        r.shuffle(rows)
        got = log_of(spark, tmp_path, rows)
        assert {x.seq: (x.status, x.error) for x in got.collect()} == expected
    assert {s for s, _ in expected.values()} >= {"applied", "rejected"}


def test_a_log_of_many_references(spark, tmp_path):
    """An update costs what it touches, not what its store holds."""
    n = 20_000
    known = spark.range(n).selectExpr("'s' AS store", "id AS seq", "'create' AS kind", "concat('refs/heads/u', id) AS name", "'1' AS new_id", "CAST(NULL AS string) AS old_id", "CAST(NULL AS string) AS new_target", "CAST(NULL AS string) AS old_target")
    begin = time.monotonic()
    got = log_of(spark, tmp_path, known.collect())
    assert time.monotonic() - begin < 60
    assert got.where("status = 'applied'").count() == n == got.count()


def test_effective_config(spark):
    s = "ord long, section string, subsection string, key string, kind string, value string"
    common = spark.createDataFrame([(0, "core", "", "a", "string", "1"), (1, "extensions", "", "worktreeconfig", "string", "true")], s)
    tree = spark.createDataFrame([(0, "core", "", "a", "string", "2")], s)
    value = lambda c: {r.key: r.value for r in repository.last_values(repository.effective(c, tree)).collect()}["a"]
    assert value(common) == "2" and value(common.where("ord = 0")) == "1"


def test_adler_and_header(spark):
    import zlib

    data = [b"", b"a", b"abc" * 500, bytes(range(256))]
    df = spark.createDataFrame([(d,) for d in data], "d binary")
    assert [r[0] for r in df.select(O.adler32(F.col("d"))).collect()] == [zlib.adler32(d) for d in data]
    raw = [b"blob 3\0abc", b"tree 03\0abc", b"blob 4\0abc", b"blub 3\0abc", b"blob x\0abc", b"blob 3abc"]
    got = spark.createDataFrame([(d,) for d in raw], "d binary").select(O.parse_header(F.col("d"))["error"]).collect()
    assert [r[0] for r in got] == [None, None, "ErrSizeMismatch", "ErrInvalidType", "ErrInvalidHeader", "ErrInvalidHeader"]


@pytest.mark.skipif(not shutil.which("git"), reason="no git binary")
def test_a_repository_on_disk(spark, tmp_path):
    env = os.environ | {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x", "HOME": str(tmp_path), "GIT_CONFIG_NOSYSTEM": "1"}
    git = lambda *a: subprocess.run(["git", *a], cwd=tmp_path, env=env, check=True, capture_output=True).stdout.decode().split()
    git("init", "-q", "-b", "main")
    for i in range(5):
        (tmp_path / "f").write_text(f"{i}\n" * 50)
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / "g").write_text("g")
        git("add", "-A")
        git("commit", "-q", "-m", f"c{i}")
    git("tag", "-a", "v1", "-m", "t")
    git("pack-refs", "--all")
    git("branch", "loose")
    top = f"{tmp_path}/.git"
    loose = S.loose_objects(spark, f"{top}/objects")
    listed = git("cat-file", "--batch-all-objects", "--batch-check=%(objectname):%(objecttype):%(objectsize)")
    assert sorted(f"{r.oid.hex()}:{r.otype}:{r.size}" for r in loose.collect()) == sorted(listed)
    assert sorted(f"{r.oid.hex()}:{r.otype}:{r.size}" for r in S.loose_objects(spark, f"{top}/objects", content=False).collect()) == sorted(listed)
    parsed = S.parsed_objects(loose)
    assert parsed["commits"].where("error IS NULL").count() == 5 and parsed["commit_parents"].count() == 4 and parsed["tags"].first()["target_type"] == "commit"
    both = refs.visible(S.as_text(S.loose_refs(spark, top), "target_name").select("name", "kind", "target_id", "target_name"), S.as_text(S.packed_refs(spark, top), "name", "target_name").select("name", "kind", "target_id", "target_name"))
    ends = {r.name: r.target_id for r in refs.resolve_symbolic(both).where("error IS NULL").collect()}
    assert {n: i.hex() for n, i in ends.items() if n != "HEAD"} == dict(zip(git("for-each-ref", "--format=%(refname)"), git("for-each-ref", "--format=%(objectname)"), strict=True))
    assert ends["HEAD"].hex() == git("rev-parse", "HEAD")[0]
    head = parsed["commits"].where(F.col("oid") == F.lit(ends["HEAD"])).first()
    entries = parsed["tree_entries"].select(F.hex("oid").alias("tree"), F.col("name").cast("string").alias("name"), "mode", F.hex("child").alias("child"))
    got = graph.flatten(spark.createDataFrame([(head.tree.hex().upper(),)], "root string"), entries).where("mode <> '40000'")
    assert sorted(r.path for r in got.collect()) == git("ls-tree", "-r", "--name-only", "HEAD")
    git("repack", "-adq")
    e = packs.scan(S.pack_files(spark, top))
    assert sorted(r.oid.hex() for r in packs.resolve(e).collect()) == sorted(x.split(":")[0] for x in listed)
    assert S.pack_indexes(spark, top).where("error IS NULL").count() == len(listed)


def test_writers(spark, tmp_path):
    from objloom.sources import writers as Wr

    texts = [b"one", b"two" * 50, b"two" * 50 + b"!"]
    pack = C.build_pack([("blob", texts[0]), ("blob", texts[1]), ("ofs", C.build_delta(texts[1], texts[2]), 1)], "sha1")
    files = spark.createDataFrame([("p", pack)], "pack string, content binary")
    e = packs.scan(files.withColumnRenamed("pack", "path"))
    rows = packs.resolve(e).join(e.select("pack", "offset", "crc32"), ["pack", "offset"])
    made = Wr.pack_artifacts(files, rows)
    assert [r.path.rsplit(".")[-1] for r in made.orderBy("step").collect()] == list(Wr.ORDER)
    for _ in range(2):
        Wr.write_files(made, str(tmp_path / "pack"))
    assert len(list((tmp_path / "pack").iterdir())) == 4
    found = S.pack_indexes(spark, str(tmp_path / "pack")).where("error IS NULL").select("oid").collect()
    assert {bytes(r.oid) for r in found} == {C.object_id("blob", t, "sha1") for t in texts}
    assert S.reverse_indexes(spark, str(tmp_path / "pack")).count() == 3
    own, read = packs.bloom(rows.select("pack", "oid")), S.bloom_filters(spark, str(tmp_path / "pack"))
    key = lambda df: sorted((r.bucket, r.word, r.mask) for r in df.collect())
    assert key(own) == key(read)
    if shutil.which("git"):
        out = subprocess.run(["git", "verify-pack", "-v", *map(str, (tmp_path / "pack").glob("*.idx"))], capture_output=True, check=True).stdout.decode()
        assert all(C.object_id("blob", t, "sha1").hex() in out for t in texts)

    objects = stores.with_ids(spark.createDataFrame([(t,) for t in texts], "content binary"), F.col("content"))
    Wr.write_files(Wr.loose_files(objects), str(tmp_path / "loose"))
    assert sorted(r.size for r in S.loose_objects(spark, str(tmp_path / "loose")).collect()) == [3, 150, 151]
    known = spark.createDataFrame([("refs/heads/a", "direct", b"\1" * 20, None), ("HEAD", "symbolic", None, "refs/heads/a")], "name string, kind string, target_id binary, target_name string")
    Wr.write_files(Wr.loose_ref_files(known), str(tmp_path / "top"))
    assert {(r.name, r.target_name or bytes(r.target_id)) for r in S.as_text(S.loose_refs(spark, str(tmp_path / "top")), "target_name").collect()} == {("refs/heads/a", b"\1" * 20), ("HEAD", "refs/heads/a")}
