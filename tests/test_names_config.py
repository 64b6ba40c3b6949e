import shutil
import subprocess

import pytest

from objloom.functions import config as cfg
from objloom.functions import refnames as N

NAMES = ["refs/heads/main", "a/b", "@", "a/@", "a/b.", "a/.b", "a..b/c", "a/b.lock", "a.lock/b", "a/@{b", "a b/c", "a/b*", "a//b", "/a/b", "a/b/", "x", "a/b\x7f", "a/b\x01", "a/b~1", "a/b^", "a/b:", "a/b?", "a/[b", "a/b\\", "a/{b", "a/-b", "é/ü"]


@pytest.mark.skipif(not shutil.which("git"), reason="no git binary")
def test_names_against_git(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    n = F.col("name")
    got = df.select("name", N.is_valid(n), N.is_valid(n, one_level=True), N.is_valid(n, pattern=True), N.problem(n)).collect()
    for name, *ok, problem in got:
        ask = lambda *flags: subprocess.run(["git", "check-ref-format", *flags, name]).returncode == 0  # noqa: B023, E731
        assert ok == [ask(), ask("--allow-onelevel"), ask("--refspec-pattern")], name
        assert (problem is None) == ok[0]


@pytest.mark.parametrize(("name", "want"), [
    ("abc", "abc"), ("@", "-/@"), ("a b", "a-b"), (".a", "-a"), ("a..b", "a.b"), ("a.lock", "a"), ("a.lock.lock", "a"), ("a@{b", "a@-b"), ("a.", "a."), ("a/b", "a/b"), ("a*b?", "a-b-"), ("x~^:", "x---"),
])
def test_sanitised(name, want):
    assert N.sanitised(name) == want


TEXT = b"""\xef\xbb\xbf# top
[core]
\tbare = false ; tail
\tKey\r
[Remote "o\\"r\\\\i"]
  url = "a b" c\t d   # x
  esc = \\n\\t\\"\\\\
  long = one\\
 two
  empty =
  [sec.Sub] last = x\x00y"""


def test_config_parse():
    want = [
        ("core", "", "bare", "string", "false"), ("core", "", "key", "valueless", ""), ("remote", 'o"r\\i', "url", "string", "a b c\t d"), ("remote", 'o"r\\i', "esc", "string", '\n\t"\\'),
        ("remote", 'o"r\\i', "long", "string", "one two"), ("remote", 'o"r\\i', "empty", "string", ""), ("sec.sub", "", "last", "string", "x"),
    ]
    assert [(s, b.decode(), k, kind, v.decode()) for _, s, b, k, kind, v in cfg.parse(TEXT)] == want


@pytest.mark.parametrize(("text", "line"), [(b"a = 1", 1), (b"[s]\n1 = 2", 2), (b"[s\n", 1), (b"[s]\na = \\q", 2), (b'[s]\na = "x', 2), (b"[s]\na b = 1", 2), (b'[s "x]\n', 1), (b"[]\n", 1), (b"[s]\n\na ! 1", 3)])
def test_config_errors(text, line):
    with pytest.raises(cfg.ConfigError) as e:
        cfg.parse(text)
    assert e.value.line == line


@pytest.mark.skipif(not shutil.which("git"), reason="no git binary")
def test_config_against_git(tmp_path):
    (tmp_path / "c").write_bytes(TEXT.replace(b"\x00y", b"").replace(b"c\t d", b"c  d"))
    out = subprocess.run(["git", "config", "--file", str(tmp_path / "c"), "--null", "--list"], capture_output=True, check=True).stdout.decode()
    got = [tuple(x.split("\n", 1)) if "\n" in x else (x, None) for x in out.split("\0")[:-1]]
    want = [(".".join(filter(None, (s, b.decode(), k))), v.decode() if kind == "string" else None) for _, s, b, k, kind, v in cfg.parse(TEXT.replace(b"c\t d", b"c  d"))]
    assert got == want


@pytest.mark.parametrize(("value", "want"), [
    ("1", 1), ("-1k", -1024), ("0x10", 16), ("010", 8), ("0o17", 15), ("0b11", 3), ("1_000", 1000), ("  7", 7), ("2G", 2 << 30), ("9223372036854775807", 2**63 - 1), ("0_7", 7),
    ("", "ErrValueEmpty"), ("  ", "ErrValueEmpty"), ("k", "ErrValueSyntax"), ("1x", "ErrValueSyntax"), ("08", "ErrValueSyntax"), ("1__0", "ErrValueSyntax"), ("9223372036854775808", "ErrValueSyntax"), ("9007199254740992k", "ErrValueRange"), ("-9007199254740992k", -(2**63)), ("7 ", "ErrValueSyntax"),
])
def test_integers(value, want):
    assert cfg.integer(value) == ((want, None) if isinstance(want, int) else (None, want))


def test_booleans_and_columns(spark):
    from pyspark.sql import functions as F

    cases = [("x", "valueless"), ("YES", "string"), ("off", "string"), ("", "string"), ("0", "string"), ("2k", "string"), ("maybe", "string"), ("3g", "string")]
    got = spark.createDataFrame(cases, "v string, k string").select("v", cfg.bool_column(F.col("k"), F.col("v")), cfg.int_column(F.col("v"))).collect()
    for (v, k), (_, b, n) in zip(cases, got, strict=True):
        assert b == cfg.boolean(v, k)[0] and n == cfg.integer(v)[0]
