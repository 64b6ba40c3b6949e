"""Object headers, identifiers, order keys and bodies as column expressions.

Identifiers are BINARY inside; Spark compares BINARY as unsigned bytes, which
is the order of identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = {"sha1": 20, "sha256": 32}
TYPES = ("blob", "tree", "commit", "tag")


def utf8(c: Column) -> Column:
    return c.cast("binary")


def framed(otype: Column | str, content: Column) -> Column:
    """``type SP size NUL content``."""
    name = F.lit(otype) if isinstance(otype, str) else otype
    return F.concat(utf8(F.concat(name, F.lit(" "), F.octet_length(content).cast("string"))), F.lit(b"\0"), content)


def digest_hex(data: Column, fmt: str) -> Column:
    return F.sha1(data) if fmt == "sha1" else F.sha2(data, 256)


def oid_hex(otype: Column | str, content: Column, fmt: str = "sha1") -> Column:
    return digest_hex(framed(otype, content), fmt)


def oid(otype: Column | str, content: Column, fmt: str = "sha1") -> Column:
    return F.unhex(oid_hex(otype, content, fmt))


def parse_oid(text: Column, fmt: str = "sha1") -> Column:
    """BINARY of a hexadecimal identifier in either case, null unless it has exactly the format's length."""
    n = 2 * FORMATS[fmt]
    return F.when(text.rlike(rf"\A[0-9a-fA-F]{{{n}}}\z"), F.unhex(text))


def parse_header(raw: Column) -> Column:
    """struct(otype, size, body, error) of framed bytes."""
    text = raw.cast("string")
    head = F.substring_index(text, "\0", 1)
    otype, size = F.substring_index(head, " ", 1), F.regexp_extract(head, r"\A[a-z]+ ([0-9]{1,20})\z", 1)
    n = size.try_cast("bigint")
    body = F.substring(raw, F.octet_length(utf8(head)) + 2, F.octet_length(raw))
    nul = F.locate("\0", text) > 0
    error = (
        F.when(~nul | (size == ""), "ErrInvalidHeader").when(~otype.isin(*TYPES), "ErrInvalidType").when(n != F.octet_length(body), "ErrSizeMismatch")
    )
    return F.struct(F.when(error.isNull() | (error == "ErrSizeMismatch"), otype).alias("otype"), n.alias("size"), body.alias("body"), error.alias("error"))


def tree_key(name: Column, mode: Column) -> Column:
    """The order of tree entries: a directory's name compares as though it ended with a slash."""
    return F.concat(name, F.when(mode == "40000", F.lit(b"/")).otherwise(F.lit(b"")))


def tree_entry(mode: Column, name: Column, child: Column) -> Column:
    return F.concat(utf8(mode), F.lit(b" "), name, F.lit(b"\0"), child)


def tree_body(mode: Column, name: Column, child: Column) -> Column:
    """An ordered aggregate: the tree body of a group's entries."""
    rows = F.array_sort(F.collect_list(F.struct(tree_key(name, mode).alias("k"), F.hex(tree_entry(mode, name, child)).alias("e"))))
    return F.unhex(F.array_join(F.transform(rows, lambda r: r["e"]), ""))


def identity(name: Column, email: Column, when: Column, offset: Column) -> Column:
    """``name <email> unix +hhmm``; null for an offset beyond 23:59."""
    minutes = F.abs(offset)
    sign = F.when(offset < 0, "-").otherwise("+")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    line = F.concat(name, F.lit(" <"), email, F.lit("> "), when.cast("string"), F.lit(" "), sign, two(F.floor(minutes / 60)), two(minutes % 60))
    return F.when(minutes <= 23 * 60 + 59, line)


IDENTITY = r"\A([^<]*)<([^>]*)> ([+-]?[0-9]{1,19}) ([+-])([0-9]{2}|[+-][0-9])([0-9]{2}|[+-][0-9])"


def parse_identity(line: Column) -> Column:
    """struct(name, email, when_unix, offset_minutes, error)."""
    g = lambda i: F.regexp_extract(line, "(?s)" + IDENTITY, i)
    when, hh, mm = g(3).try_cast("bigint"), g(5).try_cast("int"), g(6).try_cast("int")
    good = line.rlike("(?s)" + IDENTITY) & when.isNotNull() & hh.between(0, 23) & mm.between(0, 59)
    ok = lambda c: F.when(good, c)
    return F.struct(
        ok(F.rtrim(g(1))).alias("name"), ok(g(2)).alias("email"), ok(when).alias("when_unix"),
        ok(F.when(g(4) == "-", -(hh * 60 + mm)).otherwise(hh * 60 + mm)).alias("offset_minutes"), F.when(~good, "ErrInvalidSignature").alias("error"),
    )


def instant(when: Column) -> Column:
    return F.timestamp_seconds(when)


def commit_body(tree_hex: Column, parents: Column, author: Column, committer: Column, message: Column, change_id: Column | None = None) -> Column:
    """The text of a commit; parents is an array of hexadecimal identifiers."""
    change = F.when(change_id.isNotNull(), F.concat(F.lit("change-id "), change_id, F.lit("\n"))).otherwise("") if change_id is not None else F.lit("")
    return F.concat(
        F.lit("tree "), tree_hex, F.lit("\n"), F.array_join(F.transform(parents, lambda p: F.concat(F.lit("parent "), p, F.lit("\n"))), ""),
        F.lit("author "), author, F.lit("\ncommitter "), committer, F.lit("\n"), change, F.lit("\n"), message,
    )


def tag_body(target_hex: Column, target_type: Column, name: Column, tagger: Column, message: Column) -> Column:
    return F.concat(F.lit("object "), target_hex, F.lit("\ntype "), target_type, F.lit("\ntag "), name, F.lit("\ntagger "), tagger, F.lit("\n\n"), message)


#: Octal mode, object type, blob-like, regular file.
MODES = [("40000", "tree", False, False), ("100644", "blob", True, True), ("100755", "blob", True, True), ("120000", "blob", True, False), ("160000", "commit", False, False)]


def mode_row(octal: Column) -> Column:
    """struct(mode, object_type, blob_like, regular, error) of canonical octal text."""
    known = octal.isin(*[m[0] for m in MODES])
    pick = lambda i: F.coalesce(*[F.when(octal == m[0], F.lit(m[i])) for m in MODES])
    return F.struct(
        F.when(known, F.conv(octal, 8, 10).cast("int")).alias("mode"), pick(1).alias("object_type"), pick(2).alias("blob_like"), pick(3).alias("regular"),
        F.when(~known | octal.isNull(), "ErrInvalidMode").alias("error"),
    )


def with_adler32(df, data: str, name: str = "adler32"):
    """df with the Adler-32 of a binary column of any length, by an Arrow function; null stays null."""
    import zlib

    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        for b in batches:
            made = [None if x is None else zlib.adler32(x) for x in b.column(data).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)


def adler32(data: Column) -> Column:
    """Adler-32 by a fold over the bytes, for short values (see with_adler32)."""
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1))), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    done = F.aggregate(
        bytes_, F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
        lambda s, x: F.struct(((s["a"] + x) % 65521).alias("a"), ((s["b"] + s["a"] + x) % 65521).alias("b")),
    )
    return F.when(F.octet_length(data) == 0, F.lit(1).cast("long")).otherwise(done["b"] * 65536 + done["a"])
