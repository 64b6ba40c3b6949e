"""Readers of stores on disk.  Each is a file source and an Arrow codec; a bad file gives a row with its error code.

What a file says may be any bytes: names, targets, identities and values are
BINARY columns, and ``as_text`` casts those that are UTF-8.
"""

from __future__ import annotations

import re
import zlib
from struct import error as struct_error

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from objloom.functions import codecs as C
from objloom.functions import config as cfg
from objloom.functions import refnames as N
from objloom.functions.schema import struct


def _decoded(files: DataFrame, schema: str, rows) -> DataFrame:
    """A function (path, content) -> rows of dicts over (path, content)."""

    fields = struct(schema)
    arrow = to_arrow_schema(fields)

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    got = list(rows(path, data))
                except C.CodecError as e:
                    got = [{"error": e.code}]
                except (ValueError, OverflowError, struct_error):  # whatever else bytes can do to a codec
                    got = [{"error": "ErrMalformed"}]
                out += [{name: r.get(name) for name in arrow.names} | {"path": path} for r in got]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.select("path", "content").mapInArrow(run, fields)


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """df with binary columns as text; what isn't UTF-8 is null."""
    return df.withColumns({c: F.when(F.is_valid_utf8(F.col(c).cast("string")), F.col(c).cast("string")) for c in columns})


def binary(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def loose_objects(spark: SparkSession, folder: str, fmt: str = "sha1", content: bool = True) -> DataFrame:
    """Objects in ``xx/yyy…`` files; without content only each header is inflated."""

    def rows(path, data):
        oid = bytes.fromhex("".join(path.rsplit("/", 2)[1:]))
        try:
            raw = zlib.decompress(data) if content else zlib.decompressobj().decompress(data[:4096], 64)
        except zlib.error:
            raise C.CodecError("ErrInvalidObject") from None
        if content:
            otype, body = C.parse_framed(raw)
            yield {"oid": oid, "otype": otype, "size": len(body), "content": body}
        else:
            otype, size, _ = C.parse_header(raw)
            yield {"oid": oid, "otype": otype, "size": size}

    files = binary(spark, folder, "*").where(F.col("path").rlike(rf"/[0-9a-f]{{2}}/[0-9a-f]{{{2 * C.SIZES[fmt] - 2}}}$"))
    return _decoded(files, "path string, oid binary, otype string, size long, content binary, error string", rows)


def pack_files(spark: SparkSession, folder: str) -> DataFrame:
    return binary(spark, folder, "*.pack")


def pack_indexes(spark: SparkSession, folder: str, fmt: str = "sha1") -> DataFrame:
    def rows(path, data):
        got, pack = C.parse_index(data, fmt)
        for i, (oid, crc, offset) in enumerate(got):
            yield {"pack": pack.hex(), "idx_pos": i, "oid": oid, "crc32": crc, "offset": offset}

    return _decoded(binary(spark, folder, "*.idx"), "path string, pack string, idx_pos long, oid binary, crc32 long, offset long, error string", rows)


def reverse_indexes(spark: SparkSession, folder: str, fmt: str = "sha1") -> DataFrame:
    def rows(path, data):
        got, pack = C.parse_reverse(data, fmt)
        for i, p in enumerate(got):
            yield {"pack": pack.hex(), "pack_pos": i, "idx_pos": p}

    return _decoded(binary(spark, folder, "*.rev"), "path string, pack string, pack_pos long, idx_pos long, error string", rows)


def bloom_filters(spark: SparkSession, folder: str, fmt: str = "sha1") -> DataFrame:
    """(pack, buckets, bucket, word, mask) of the words that aren't zero; a bad filter is an error row, which readers take as no filter."""

    def rows(path, data):
        b, _, table, pack = C.parse_bloom(data, fmt, verify=True)
        for i in range(b * 8):
            word = int.from_bytes(table[8 * i : 8 * i + 8], "big", signed=True)
            if word:
                yield {"pack": pack.hex(), "buckets": b, "bucket": i // 8, "word": i % 8, "mask": word}

    return _decoded(binary(spark, folder, "*.bloom"), "path string, pack string, buckets long, bucket long, word int, mask long, error string", rows)


def loose_refs(spark: SparkSession, folder: str, fmt: str = "sha1") -> DataFrame:
    """References of files below ``refs/``, and capital-letter files at the top; lock files aren't references."""
    root = folder.rstrip("/") + "/"

    def rows(path, data):
        name = path.split(root, 1)[-1]
        kind, target = C.parse_loose_ref(data, fmt)
        yield {"name": name, "kind": kind, "target_id": target if kind == "direct" else None, "target_name": target if kind == "symbolic" else None}

    # below refs/, or a capital-letter name at the top: logs and objects aren't read
    below = F.regexp_extract("path", "[^/:]*//*" + re.escape(root).replace("\\/", "/").lstrip("/") + "(.*)$", 1)
    files = binary(spark, folder, "*").where(below.rlike("^(?:refs/.+|[A-Z_]+)$") & ~F.col("path").endswith(".lock"))
    return _decoded(files, "path string, name string, kind string, target_id binary, target_name binary, error string", rows)


def packed_refs(spark: SparkSession, folder: str, fmt: str = "sha1") -> DataFrame:
    def rows(path, data):
        for name, oid, state, peeled in C.parse_packed_refs(data, fmt):
            yield {"name": name, "kind": "direct", "target_id": oid, "peel_state": state, "peeled_id": peeled}

    return _decoded(binary(spark, folder, "packed-refs"), "path string, name binary, kind string, target_id binary, target_name binary, peel_state string, peeled_id binary, error string", rows)


def configs(files: DataFrame) -> DataFrame:
    """Entries of configuration files given as (path, content); error is ``ParseError:line``."""

    def rows(path, data):
        try:
            for o, section, sub, key, kind, value in cfg.parse(data):
                yield {"ord": o, "section": section, "subsection": sub, "key": key, "kind": kind, "value": value}
        except cfg.ConfigError as e:
            raise C.CodecError(f"ParseError:{e.line}") from None

    return _decoded(files, "path string, ord long, section string, subsection binary, key string, kind string, value binary, error string", rows)


def alternates(files: DataFrame) -> DataFrame:
    """(path, ord, target) of alternates files given as (path, content); relative targets are joined to the objects folder."""

    def rows(path, data):
        base = path.rsplit("/info/", 1)[0]
        for i, p in enumerate(C.parse_alternates(data, base)):
            yield {"ord": i, "target": p}

    return _decoded(files, "path string, ord long, target binary, error string", rows)


def parsed_objects(objects: DataFrame, fmt: str = "sha1") -> dict[str, DataFrame]:
    """Typed tables of objects(oid, otype, content): tree_entries, commits, commit_parents, tags, each with an error column."""
    as_path = lambda kind: objects.where(F.col("otype") == kind).select(F.hex("oid").alias("path"), "content")

    def tree_rows(path, data):
        for i, (mode, name, child) in enumerate(C.parse_tree(data, fmt)):
            yield {"pos": i, "mode": mode.decode(), "name": name, "child": child, "child_type": C.MODES[mode]}

    def who(prefix, identity):
        return dict(zip((f"{prefix}_name", f"{prefix}_email", f"{prefix}_when", f"{prefix}_offset"), identity, strict=True))

    def commit_rows(path, data):
        c = C.parse_commit(data, fmt)
        yield {"tree": c["tree"], "parents": c["parents"], **who("author", c["author"]), **who("committer", c["committer"]), "change_id": c["change_id"], "extra": [{"key": k, "value": v} for k, v in c["extra"]], "message": c["message"]}

    def tag_rows(path, data):
        t = C.parse_tag(data, fmt, N.valid_tag_name)
        yield {"target": t["target"], "target_type": t["target_type"], "name": t["name"], **who("tagger", t["tagger"]), "extra": [{"key": k, "value": v} for k, v in t["extra"]], "message": t["message"]}

    person = lambda p: f"{p}_name binary, {p}_email binary, {p}_when long, {p}_offset int"
    made = {
        "tree_entries": _decoded(as_path("tree"), "path string, pos long, mode string, name binary, child binary, child_type string, error string", tree_rows),
        "commits": _decoded(as_path("commit"), f"path string, tree binary, parents binaries, {person('author')}, {person('committer')}, change_id binary, extra headers, message binary, error string", commit_rows),
        "tags": _decoded(as_path("tag"), f"path string, target binary, target_type string, name binary, {person('tagger')}, extra headers, message binary, error string", tag_rows),
    }
    made = {k: df.withColumn("oid", F.unhex("path")).drop("path") for k, df in made.items()}
    made["commit_parents"] = made["commits"].select("oid", F.posexplode("parents").alias("parent_pos", "parent_oid"))
    return made


def signed_payloads(objects: DataFrame, otype: str, fmt: str = "sha1") -> DataFrame:
    """(oid, payload, signatures by format) of commits or tags."""

    def rows(path, data):
        payload, sigs = C.split_signed_commit(data) if otype == "commit" else C.split_signed_tag(data, fmt)
        yield {"payload": payload, "sha1_signature": sigs.get("sha1"), "sha256_signature": sigs.get("sha256")}

    source = objects.where(F.col("otype") == otype).select(F.hex("oid").alias("path"), "content")
    return _decoded(source, "path string, payload binary, sha1_signature binary, sha256_signature binary, error string", rows).withColumn("oid", F.unhex("path")).drop("path")
