"""Byte codecs: round trips, malformed inputs, and the git binary where there is one."""

import os
import random
import shutil
import subprocess
import zlib

import pytest

from objloom.functions import codecs as C

FORMATS = ["sha1", "sha256"]


def oid(i, fmt):
    return C.sum_of(b"%d" % i, fmt)


def code(f, *args):
    with pytest.raises(C.CodecError) as e:
        f(*args)
    return e.value.code


@pytest.mark.parametrize("fmt", FORMATS)
def test_tree(fmt):
    rows = [(b"100644", b"a.c", oid(1, fmt)), (b"40000", b"a", oid(2, fmt)), (b"100755", b"a0", oid(3, fmt)), (b"120000", b"z", oid(4, fmt)), (b"160000", b"m", oid(5, fmt))]
    body = C.build_tree(rows)
    assert [r[1] for r in C.parse_tree(body, fmt)] == [b"a.c", b"a", b"a0", b"m", b"z"]
    assert C.build_tree(C.parse_tree(body, fmt)) == body and C.parse_tree(b"", fmt) == []
    one = lambda mode, name: mode + b" " + name + b"\0" + oid(1, fmt)
    for bad in (body[:-1], one(b"100644", b""), one(b"100644", b"a/b"), one(b"100644", b"b") + one(b"100644", b"a"), one(b"100644", b"a") * 2, one(b"100644", b"a") + one(b"40000", b"a")):
        assert code(C.parse_tree, bad, fmt) == "ErrInvalidTree"
    for mode in (b"040000", b"100600", b"8", b"1006440"):
        assert code(C.parse_tree, one(mode, b"a"), fmt) in ("ErrInvalidMode", "ErrInvalidTree")


@pytest.mark.parametrize("fmt", FORMATS)
def test_commit(fmt):
    who = (b"A U Thor", b"a@x", 1234567890, -90)
    c = {"tree": oid(1, fmt), "parents": [oid(2, fmt), oid(3, fmt)], "author": who, "committer": who, "change_id": b"I1", "extra": [(b"encoding", b"latin1"), (b"x", b"y z")], "message": b"m\n\nbody\n"}
    body = C.build_commit(c)
    assert C.parse_commit(body, fmt) == c and C.build_commit(C.parse_commit(body, fmt)) == body
    head, message = body.split(b"\n\n", 1)
    signed = head + b"\ngpgsig -----BEGIN\n line\n end\nafter v\n cont w\n\n" + message
    got = C.parse_commit(signed, fmt)
    assert got["extra"] == [*c["extra"], (b"after", b"v"), (b"", b"cont w")] and got["message"] == message
    tree = head.split(b"\n")[0]
    for bad in (head, body.replace(b"tree ", b"trie ", 1), tree + b"\n\nm", body.replace(b"author", b"auteur"), head + b"\nparent " + oid(1, fmt).hex().encode() + b"\n\n", head + b"\nnospace\n\n", b"", b"\n", body.replace(b"-0130", b"-2430")):
        assert code(C.parse_commit, bad, fmt) == "ErrInvalidCommit"


@pytest.mark.parametrize("fmt", FORMATS)
def test_tag(fmt):
    t = {"target": oid(1, fmt), "target_type": "commit", "name": b"v1", "tagger": (b"T", b"t@x", 5, 0), "extra": [(b"k", b"v")], "message": b"hello\n"}
    body = C.build_tag(t)
    assert C.parse_tag(body, fmt) == t
    assert C.parse_tag(body.split(b"\n\n")[0] + b"\n", fmt)["message"] == b""
    for bad in (body.replace(b"type commit", b"type thing"), body.replace(b"tagger", b"taggr"), body[:20], body.replace(b"k v", b"tag v2"), body.replace(b"k v", b"kv")):
        assert code(C.parse_tag, bad, fmt) == "ErrInvalidTag"
    assert code(C.parse_tag, body, fmt, lambda n: n != b"v1") == "ErrInvalidTag"


@pytest.mark.parametrize(("line", "want"), [
    (b"A  <a@x> 1 +0130", (b"A", b"a@x", 1, 90)), (b"<> -5 -0000", (b"", b"", -5, 0)), (b"A <a> +7 -2359 tail", (b"A", b"a", 7, -1439)), (b"A <a<b> 1 ++5-0", (b"A", b"a<b", 1, 300)),
    (b"A a@x> 1 +0000", None), (b"A <a 1 +0000", None), (b"A <a>1 +0000", None), (b"A <a> 1", None), (b"A <a> 1 +000", None), (b"A <a> 1 0000+", None), (b"A <a> 1 +2400", None), (b"A <a> 1 +0060", None), (b"A <a> 9223372036854775808 +0000", None),
])
def test_identity(line, want):
    assert (C.parse_identity(line) == want) if want else code(C.parse_identity, line) == "ErrInvalidSignature"


def test_framed():
    assert C.parse_framed(C.framed("blob", b"abc")) == ("blob", b"abc") and C.parse_framed(b"tree 00\0") == ("tree", b"")
    assert [code(C.parse_framed, x) for x in (b"blob 3\0ab", b"blub 1\0a", b"blob x\0", b"blob 1", b" 1\0a")] == ["ErrSizeMismatch", "ErrInvalidType", *["ErrInvalidHeader"] * 3]


def test_numbers():
    r = random.Random(1)
    for n in [0, 1, 127, 128, 16511, 16512, 2**31, 2**63, *(r.randrange(2 ** r.randrange(1, 64)) for _ in range(500))]:
        assert C.parse_distance(C.build_distance(n), 0) == (n, len(C.build_distance(n)))
        for kind in ("commit", "blob"):
            raw = C.build_entry_header(kind, n)
            got = C.parse_entry_header(raw, 0, "sha1")
            assert (got["type"], got["size"], got["end"]) == (kind, n, len(raw))
    for bad in (b"", b"\x80", b"\x00", b"\x50", b"\xbf" + b"\xff" * 9 + b"\x01"):
        assert code(C.parse_entry_header, bad, 0, "sha1") == "ErrMalformedEntryHeader"
    assert code(C.parse_distance, b"\xff" * 11, 0) == "ErrMalformedOfsDistance"


def test_delta():
    r = random.Random(2)
    for _ in range(200):
        base = bytes(r.randrange(4) for _ in range(r.randrange(400)))
        a, b = sorted((r.randrange(len(base) + 1), r.randrange(len(base) + 1)))
        target = base[:a] + bytes(r.randrange(256) for _ in range(r.randrange(300))) + base[b:]
        assert C.apply_delta(base, C.build_delta(base, target)) == target
    big = bytes(70_000)
    assert C.apply_delta(big, C.build_delta(big, big + b"x" + big)) == big + b"x" + big
    assert C.apply_delta(bytes(65536), b"\x80\x80\x04\x80\x80\x04\x80") == bytes(65536)  # a copy of size 0 is 65536
    for bad in (b"\x03\x01\x00", b"\x02\x01\x90\x01", b"\x03\x02\x90\x01", b"\x03\x01\x91", b"\x03\x05\x05ab", b"\x03\x01\x91\x05\x01", b"", b"\x80" * 11):
        assert code(C.apply_delta, b"abc", bad) == "ErrMalformedDelta"


@pytest.mark.parametrize("fmt", FORMATS)
def test_pack_index_reverse_bloom(fmt):
    objects = [b"object %d" % i * (i % 7) for i in range(60)]
    entries = [("blob", o) for o in objects[:30]]
    for i in range(30, 45):
        entries.append(("ofs", C.build_delta(objects[i - 1], objects[i]), i - 1))
    for i in range(45, 60):
        entries.append(("ref", C.build_delta(objects[i - 1], objects[i]), C.object_id("blob", objects[i - 1], fmt)))
    pack = C.build_pack(entries, fmt)
    rows = C.scan_pack(pack, fmt)
    assert [r["entry_type"] for r in rows] == [e[0] for e in entries] and [r["payload"] for r in rows[:30]] == objects[:30]
    assert all(zlib.crc32(pack[r["offset"] : r["offset"] + r["packed_len"]]) == r["crc32"] for r in rows)
    assert rows[30]["base_offset"] == rows[29]["offset"]
    for bad in (pack[:-1], b"PACC" + pack[4:], pack[:60] + b"\0" + pack[61:], pack + b"x"):
        assert code(C.scan_pack, bad, fmt).startswith("ErrMalformed")
    assert code(C.scan_pack, pack, fmt, 10) == "ErrObjectTooLarge"

    h = C.sum_of(b"pack", fmt)
    index = [(oid(i, fmt), i * 7, i * 1000 if i % 5 else 2**33 + i) for i in range(300)]
    data = C.build_index(index, h, fmt)
    assert C.parse_index(data, fmt) == (sorted(index), h)
    for bad in (data[:-1], b"x" + data[1:], data[:8] + b"\xff" * 4 + data[12:], data[:1030]):
        assert code(C.parse_index, bad, fmt) == "ErrMalformedIndex"
    rev = C.build_reverse([2, 0, 1], h, fmt)
    assert C.parse_reverse(rev, fmt) == ([2, 0, 1], h)
    assert {code(C.parse_reverse, bad, fmt) for bad in (rev[:-1], b"x" + rev[1:], C.build_reverse([3, 0, 1], h, fmt))} == {"ErrMalformedReverseIndex"}

    ids = [oid(i, fmt) for i in range(10_000)]
    bloom = C.build_bloom(ids, h, fmt)
    b, k, table, of = C.parse_bloom(bloom, fmt, verify=True)
    assert (b, k, of) == (256, 8, h) and all(C.may_contain(table, b, k, x) for x in ids)
    assert sum(C.may_contain(table, b, k, oid(i, fmt)) for i in range(10_000, 20_000)) <= 500
    for bad in (bloom[:-1], b"x" + bloom[1:], bloom[:20] + b"\1" + bloom[21:]):
        assert code(C.parse_bloom, bad, fmt) == "ErrMalformedBloom"
    assert code(C.parse_bloom, bloom[:70] + bytes([bloom[70] ^ 1]) + bloom[71:], fmt, True) == "ErrMalformedBloom"
    assert [C.bloom_buckets(n) for n in (0, 1, 48, 49, 96, 97, 10_000)] == [1, 1, 1, 2, 2, 4, 256]


def test_signed_payloads():
    body = b"tree 1\nauthor a\ngpgsig A\n B\ngpgsig-sha256 C\ngpgsig-new D\n E\nk v\n w\n\ngpgsig in message\n"
    payload, sigs = C.split_signed_commit(body)
    assert payload == b"tree 1\nauthor a\nk v\n w\n\ngpgsig in message\n" and sigs == {"sha1": b"A\nB\n", "sha256": b"C\n"}
    tag = b"object 1\ngpgsig-sha256 X\n Y\ngpgsig-new D\n\nmessage\n-----BEGIN PGP SIGNATURE-----\nold\n-----BEGIN SSH SIGNATURE-----\nnew\n"
    payload, sigs = C.split_signed_tag(tag, "sha1")
    assert payload == b"object 1\ngpgsig-new D\n\nmessage\n-----BEGIN PGP SIGNATURE-----\nold\n"
    assert sigs == {"sha256": b"X\nY\n", "sha1": b"-----BEGIN SSH SIGNATURE-----\nnew\n"}
    assert C.split_signed_tag(b"object 1\n\nplain", "sha1") == (b"object 1\n\nplain", {})


def test_references_as_text():
    a, b = "1" * 40, "2" * 40
    text = f"# pack-refs with: peeled fully-peeled sorted \n{a} refs/heads/x\n{b} refs/tags/v\n^{a}\n"
    assert C.parse_packed_refs(text.encode(), "sha1") == [(b"refs/heads/x", bytes.fromhex(a), "none", None), (b"refs/tags/v", bytes.fromhex(b), "peeled", bytes.fromhex(a))]
    assert [r[2] for r in C.parse_packed_refs(f"# pack-refs with: peeled\n{a} refs/heads/x\n{a} refs/tags/v\n".encode(), "sha1")] == ["unknown", "none"]
    for bad in (f"{a} refs/x", f"^{a}\n", f"{a} refs/x\n^{a}\n^{a}\n", f"{a} refs/x\n{b} refs/x\n", f"{a[:-1]} refs/x\n", f"{a}\n"):
        assert code(C.parse_packed_refs, bad.encode(), "sha1") == "ErrMalformedPackedRefs"
    assert C.parse_loose_ref(b"ref: refs/heads/x \n", "sha1") == ("symbolic", b"refs/heads/x")
    assert C.parse_loose_ref(a.encode() + b" rest", "sha1") == ("direct", bytes.fromhex(a)) == C.parse_loose_ref(a.encode(), "sha1")
    assert {code(C.parse_loose_ref, x, "sha1") for x in (b"", a[:-1].encode(), a.encode() + b"f")} == {"ErrInvalidValue"}


def test_alternates():
    text = b'# c\n/abs\nrel/x\n"/q\\tz\\303\\251"\n"broken\\q"\n\n../up\n'
    assert C.parse_alternates(text, "/r/objects") == [x.encode() for x in ("/abs", "/r/objects/rel/x", "/q\tzé", '/r/objects/"broken\\q"', "/r/up")]


@pytest.mark.skipif(not shutil.which("git"), reason="no git binary")
def test_against_git(tmp_path):
    env = os.environ | {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x", "GIT_AUTHOR_DATE": "1234567890 +0130", "GIT_COMMITTER_DATE": "1234567890 +0130", "HOME": str(tmp_path), "GIT_CONFIG_NOSYSTEM": "1"}
    git = lambda *a, **k: subprocess.run(["git", *a], cwd=tmp_path, env=env, check=True, capture_output=True, **k).stdout
    git("init", "-q", "-b", "main")
    for i in range(12):
        (tmp_path / "log").write_text("".join(f"line {k}\n" for k in range(i * 20)))
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / "f").write_text(str(i // 3))
        git("add", "-A")
        git("commit", "-q", "-m", f"c{i}")
    git("tag", "-a", "v1", "-m", "tag")
    git("repack", "-adq")
    folder = tmp_path / ".git/objects/pack"
    pack, index = (next(folder.glob(f"*.{x}")).read_bytes() for x in ("pack", "idx"))
    entries, (ids, of) = C.scan_pack(pack, "sha1"), C.parse_index(index, "sha1")
    assert of == pack[-20:] and {(e["offset"], e["crc32"]) for e in entries} == {(o, c) for _, c, o in ids}
    assert C.build_index(ids, of, "sha1") == index
    content, kind = {}, {}
    for e in entries:  # bases come before their deltas in git's packs
        at = e["offset"]
        if e["entry_type"] == "ofs":
            content[at], kind[at] = C.apply_delta(content[e["base_offset"]], e["payload"]), kind[e["base_offset"]]
        else:
            content[at], kind[at] = e["payload"], e["entry_type"]
    assert any(e["entry_type"] == "ofs" for e in entries)
    assert {C.object_id(kind[a], content[a], "sha1") for a in content} == {i for i, *_ in ids}
    for a, body in content.items():
        if kind[a] == "tree":
            assert C.build_tree(C.parse_tree(body, "sha1")) == body
        elif kind[a] == "commit":
            assert C.build_commit(C.parse_commit(body, "sha1")) == body
        elif kind[a] == "tag":
            assert C.build_tag(C.parse_tag(body, "sha1")) == body
