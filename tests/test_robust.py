"""Codecs on arbitrary bytes, completed packs against git, publishing in order, bounds."""

import os
import shutil
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from objloom.functions import codecs as C
from objloom.functions import config as cfg
from objloom.functions import refnames as N
from objloom.operators import graph, packs, refs
from objloom.sources import files as S
from objloom.sources import writers as Wr

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PARSERS = [
    C.parse_framed, C.parse_identity, lambda b: C.parse_tree(b, "sha1"), lambda b: C.parse_commit(b, "sha1"), lambda b: C.parse_tag(b, "sha1", N.valid_tag_name), lambda b: C.parse_packed_refs(b, "sha1"),
    lambda b: C.parse_loose_ref(b, "sha1"), lambda b: C.parse_alternates(b, "/r"), cfg.parse, lambda b: C.scan_pack(b, "sha1"), lambda b: C.parse_index(b, "sha1"), lambda b: C.parse_reverse(b, "sha1"),
    lambda b: C.parse_bloom(b, "sha1"), C.delta_instructions, C.delta_sizes, lambda b: C.apply_delta(b"base", b, 100), lambda b: C.parse_entry_header(b, 0, "sha1"), C.split_signed_commit, lambda b: C.split_signed_tag(b, "sha1"), lambda b: C.pack_trailer(b, "sha1"),
]
PIECES = [b"blob ", b"9" * 5000, b"0" * 5000, b"\0", b"tree ", b"a" * 40, b"\n", b"parent ", b"author A <a@x> ", b" +0000", b"tagger ", b"tag v", b"ref: ", b"\xff\xfe", b"[s]\n", b"key = ", b"^", b"# pack-refs with: peeled \n", b"PACK\0\0\0\2", b"\0\0\0\1", b"\x80", b'"', b"\\"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.binary(max_size=12)), max_size=8).map(b"".join))
def test_any_bytes_are_a_value_or_a_codec_error(data):
    for parse in PARSERS:
        try:
            parse(data)
        except (C.CodecError, cfg.ConfigError):
            pass


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=20).filter(lambda b: b"\n" not in b))
def test_tag_names_are_those_of_the_expressions(name):
    """The codec's rule against the list of patterns, on bytes as characters."""
    import re

    full = "refs/tags/" + name.decode("latin-1")
    bad = any(re.search(p.replace(r"\z", r"\Z"), full) for p, _ in N.RULES) or "*" in full or name.startswith(b"-") or name == b"HEAD"
    assert N.valid_tag_name(name) == (not bad)


@pytest.mark.parametrize("fmt", ["sha1", "sha256"])
def test_completed_packs_are_whole(fmt, tmp_path):
    base, body = b"some base content\n" * 20, b"some base content\n" * 19 + b"the end"
    thin = C.build_pack([("ref", C.build_delta(base, body), C.object_id("blob", base, fmt))], fmt)
    whole = C.complete_pack(thin, [("blob", base)], fmt)
    rows = C.scan_pack(whole, fmt)
    assert [r["entry_type"] for r in rows] == ["ref", "blob"] and rows[1]["payload"] == base and C.pack_trailer(whole, fmt)[0] == 2
    if shutil.which("git") and fmt == "sha1":
        (tmp_path / "x.pack").write_bytes(whole)
        subprocess.run(["git", "index-pack", str(tmp_path / "x.pack")], check=True, capture_output=True)
        out = subprocess.run(["git", "verify-pack", "-v", str(tmp_path / "x.idx")], check=True, capture_output=True).stdout.decode()
        assert C.object_id("blob", body, fmt).hex() in out and C.object_id("blob", base, fmt).hex() in out


def test_a_failed_delta_keeps_its_error(spark):
    base = b"base content of some length"
    bad = C.build_pack([("blob", base), ("ofs", C.build_delta(b"another base", b"x"), 0)], "sha1")
    big = C.build_pack([("blob", b"a"), ("ofs", C.build_delta(b"a", b"y" * 500), 0)], "sha1")
    e = packs.scan(spark.createDataFrame([("bad", bad), ("big", big)], "path string, content binary"))
    done, failed = packs.resolve_all(e, max_size=600)
    assert {(r.pack, r.error) for r in failed.collect()} == {("bad", "ErrMalformedDelta")}
    assert {r.error for r in packs.resolve_all(e, max_size=100)[1].where("pack = 'big'").collect()} == {"ErrObjectTooLarge"}
    assert done.where("pack = 'big'").count() == 2


def test_a_limit_holds_for_objects_and_entries(spark, tmp_path):
    """Texts just below the limit, whose deltas would be over it; a result over it of a small delta; equal packs: as the SQL says."""
    import duckdb

    from objloom.queries.registry import QUERIES, SQL

    texts = {0: "a" * 30, 1: "bc" * 9_975, 50: "d" * 15_000, 51: "d" * 15_000 + "ef" * 3_500, 100: "same", 101: "text", 150: "same", 151: "text", 200: "g" * 20_001, 250: "h" * 20_000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = dict(con.execute(SQL["ingest_limit"]).fetchall())
    assert expected == {"published": 4, "ErrObjectTooLarge": 2}
    assert {r.state: r.packs for r in QUERIES["ingest_limit"](spark, str(tmp_path)).collect()} == expected
    # an entry that is over the limit itself is refused when it is scanned, whatever its result
    delta = C.build_delta(b"a", b"b" * 19_950)
    pack = C.build_pack([("blob", b"a"), ("ofs", delta, 0)], "sha1")
    with pytest.raises(C.CodecError, match="ErrObjectTooLarge"):
        C.scan_pack(pack, "sha1", 20_000)
    assert len(delta) > 20_000 and len(C.scan_pack(pack, "sha1", len(delta))) == 2


def test_files_are_published_step_by_step_and_rolled_back(spark, tmp_path):
    rows = [("a.pack", 0, b"p"), ("a.rev", 1, b"r"), ("a.bloom", 2, b"b"), ("a.idx", 3, b"i")]
    made = spark.createDataFrame(rows, "path string, step int, content binary")
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "a.rev").write_bytes(b"there")
    Wr.write_files(made, str(tmp_path / "ok"))
    assert sorted(x.name for x in (tmp_path / "ok").iterdir()) == ["a.bloom", "a.idx", "a.pack", "a.rev"] and (tmp_path / "ok" / "a.rev").read_bytes() == b"there"
    (tmp_path / "no").mkdir()
    (tmp_path / "no" / "a.rev").write_bytes(b"there")
    (tmp_path / "no" / "sub").write_bytes(b"a file where a folder should be")
    wrong = made.where("step < 2").unionAll(spark.createDataFrame([("sub/a.idx", 3, b"i")], made.schema))
    with pytest.raises(OSError):
        Wr.write_files(wrong, str(tmp_path / "no"))
    assert sorted(x.name for x in (tmp_path / "no").iterdir()) == ["a.rev", "sub"]


def test_a_tree_that_holds_itself_is_refused(spark):
    entries = spark.createDataFrame([("t", "a", "40000", "t")], "tree string, name string, mode string, child string")
    with pytest.raises(ValueError, match="ErrTreeTooDeep"):
        graph.flatten(spark.createDataFrame([("t",)], "root string"), entries, deepest=3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "a/b", "a/b/c", "b", "b/a", "ab", "a/c"]), max_size=8), st.sampled_from(["a", "a/b", "a/b/c/d", "b", "ab", "x"]))
def test_name_conflicts_by_look_up(names, name):
    plain = any(n.startswith(name + "/") or name.startswith(n + "/") for n in names)
    assert refs._Names(names).conflicts(name) == plain


def test_trees_find_directories_first_and_refuse_twins(spark):
    entries = spark.createDataFrame([(1, "x", "100644", "f"), (1, "x", "40000", "d"), (1, "y", "100644", "g")], "tree int, name string, mode string, child string")
    asked = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z")], "tree int, name string")
    assert {r.name: r.child for r in graph.find_entries(asked, entries).collect()} == {"x": "d", "y": "g", "z": None}
    new = spark.createDataFrame([(1, 1, "y", "40000"), (1, 2, "n", "40000"), (1, 3, "n", "100644"), (1, 4, "a\0b", "100644")], "tree int, seq int, name string, mode string")
    assert {r.seq: r.error for r in graph.inserted(entries, new).collect()} == {1: "ErrInvalidTree", 2: None, 3: "ErrInvalidTree", 4: "ErrInvalidTree"}


def test_text_of_bytes(spark):
    df = spark.createDataFrame([(b"ok",), (b"\xff",), (None,)], "name binary")
    assert [r.name for r in S.as_text(df, "name").collect()] == ["ok", None, None]


def test_core_tests_run_without_the_optional_parts(tmp_path):
    """With the optional subpackage, its tests and the pipeline deleted, the rest is collected and runs."""
    for x in ("objloom", "tests", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{HERE}/{x}") else shutil.copy)(f"{HERE}/{x}", tmp_path / x)
    for x in ("objloom/llm", "tests/llm"):
        shutil.rmtree(tmp_path / x, ignore_errors=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = lambda *a: subprocess.run([sys.executable, "-m", "pytest", "-q", *a], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    got = run("--collect-only")
    assert got.returncode == 0, got.stdout[-2000:]
    got = run("tests/test_codecs.py", "tests/test_queries.py", "-k", "test_entry or blob_oid or parse")
    assert got.returncode == 0, got.stdout[-2000:]
