r"""Operator 1 [native]: secret scans.

Three pattern kinds (``assign``, ``access``, ``hex``) and the entropy kind, all
by Spark SQL expressions: no Python runs on executors, and nothing is shuffled.

*Entropy*: candidates are runs of 20 or more of ``[A-Za-z0-9+/_=-]``.  Each has
a character class (hex, alphanumeric or base64) with its own threshold.  A
window of 20 characters slides over the candidate, keeping a count for each
letter of the alphabet and the sum of c*log2(c) over the counts; a step adds
one character and takes one away, so it changes two counts and two terms.  The
entropy is log2(20) - sum/20.  Windows at or over the class's threshold are
merged where they overlap, and each merged stretch is a span.  A part of 20 or
more hex digits of one case beside a delimiter (``+/_=-``) is a candidate too,
with its own class, so ``sig=`` or a path before a hex secret doesn't raise its
threshold; its spans are merged with those of the whole.  *Allow-list*: a
candidate, whole or part, is suppressed if it matches a pattern of ``ALLOW``: plain words
(no digit), numbers, UUIDs, words and numbers joined by ``-``, ``_`` or ``/``
(paths, slugs, dates), or documented example values.

Positions are code points, ends exclusive.  They come from splitting the text
at the pattern: the lengths of the pieces between matches and of the matches
add up to the starts.

Defined results: null is the empty text; no spans give the empty string and
the SHA-256 of it; repeated rows give repeated rows; extra columns are kept,
those with a name of the results as ``input_<name>``; an empty table gives no
rows.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objloom.llm.common import column, plainly, set_aside

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Hex digits beside a delimiter: the part of a candidate that has a class of its own.
PART = r"(?<=[+/_=-])(?:[0-9a-f]{20,}+|[0-9A-F]{20,}+)(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:[0-9a-f]{20,}+|[0-9A-F]{20,}+)(?=[+/_=-])"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least entropy in bits of a window: 20 random hex digits have about 3.2, random letters and digits about 4.0.
THRESHOLDS = {"hex": 2.71, "alnum": 3.43, "base64": 3.57}
ALLOW = (
    r"^[^0-9]+$",
    r"^[0-9_=+/-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?(?:[a-z]+|[A-Z][a-z]*|[0-9]{1,8})(?:[-_/]+(?:[a-z]+|[A-Z][a-z]*|[0-9]{1,8}))+/?$",
    r"(?i)example|placeholder|your[-_]?(?:key|token|secret)|x{6,}|0{8,}|abcdefghij|0123456789",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: c*log2(c) for counts 0 to WINDOW.
TERMS = [0.0, *(c * log2(c) for c in range(1, WINDOW + 1))]


def _term(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TERMS)), c.cast("int") + 1)


def _matches(text: Column, pattern: str, kind: str, keep=None, also: dict[str, int] | None = None) -> Column:
    """Array of struct(start, end, kind, value) of the pattern's matches, leftmost first and not overlapping."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    parts = {"v": found} | {k: F.regexp_extract_all(text, p, F.lit(g)) for k, g in (also or {}).items()}
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(between.alias("b"), *[c.alias(k) for k, c in parts.items()])
    kept = keep or (lambda r: F.lit(True))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")
    span = lambda at, r: F.struct(
        (at + F.length(r["b"])).alias("start"), (at + F.length(r["b"]) + F.length(r["v"])).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), r["v"].alias("value")
    )
    done = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), empty.alias("got")),
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r["b"]) + F.coalesce(F.length(r["v"]), F.lit(0))).alias("at"),
            F.when(r["v"].isNotNull() & kept(r), F.concat(acc["got"], F.array(span(acc["at"], r)))).otherwise(acc["got"]).alias("got"),
        ),
        lambda acc: acc["got"],
    )
    return F.when(F.regexp_like(text, p), done).otherwise(empty)


def _entropy_spans(candidates: Column) -> Column:
    """Spans of the stretches of high entropy in an array of candidates."""
    sums = lambda c: F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda i: F.lit(0))  # noqa: E731, ARG005

    def one(c: Column) -> Column:
        v = c["value"]
        limit = (
            F.when(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), THRESHOLDS["hex"]).when(v.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
        )
        letter = lambda i: F.instr(F.lit(ALPHABET), F.substr(v, i, F.lit(1)))

        def step(acc: Column, i: Column) -> Column:
            new, old = letter(i), F.when(i > WINDOW, letter(i - WINDOW)).otherwise(F.lit(0))
            # counts before the step; a letter that both comes and goes keeps its count
            c_new = F.element_at(acc["n"], new)
            c_old = F.when(old > 0, F.element_at(acc["n"], F.greatest(old, F.lit(1)))).otherwise(F.lit(0))
            moved = F.when(
                new == old, acc["s"]
            ).otherwise(
                acc["s"] + _term(c_new + 1) - _term(c_new) + F.when(old > 0, _term(c_old - 1) - _term(c_old)).otherwise(0.0)
            )
            counts = F.when(new == old, acc["n"]).otherwise(F.transform(acc["n"], lambda x, j: x + F.when(j + 1 == new, 1).otherwise(0) - F.when(j + 1 == old, 1).otherwise(0)))
            high = (i >= WINDOW) & (F.lit(log2(WINDOW)) - moved / WINDOW >= limit)
            a, b = c["start"] + i - WINDOW, c["start"] + i
            joins = (F.size(acc["got"]) > 0) & (F.coalesce(F.try_element_at(acc["got"], F.lit(-1))["end"], F.lit(-1)) >= a)
            last = F.try_element_at(acc["got"], F.lit(-1))
            new_span = F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
            longer = F.concat(F.slice(acc["got"], 1, F.size(acc["got"]) - 1), F.array(F.struct(last["start"].alias("start"), b.cast("int").alias("end"))))
            got = F.when(~high, acc["got"]).when(joins, longer).otherwise(F.concat(acc["got"], F.array(new_span)))
            return F.struct(counts.alias("n"), moved.alias("s"), got.alias("got"))

        start = F.struct(sums(c).alias("n"), F.lit(0.0).alias("s"), F.array().cast("array<struct<start:int,end:int>>").alias("got"))
        return F.aggregate(F.sequence(F.lit(1), F.length(v)), start, step, lambda acc: F.transform(acc["got"], lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), F.lit(KINDS.index("entropy")).alias("kind"))))

    return F.flatten(F.transform(candidates, one))


def _merged(spans: Column) -> Column:
    """Spans of one kind with those that overlap or touch made one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(F.coalesce(last["end"], F.lit(-1)) >= s["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int,kind:int>>"), step)


def _allowed(v: Column) -> Column:
    out = F.lit(False)
    for p in ALLOW:
        out = out | v.rlike(p)
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans and secret_spans (array of start, end, kind)."""
    docs[f"`{text_col}`"]
    made = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "secret_spans")
    steps = ("_assign", "_access", "_hex", "_cand", "_part", "_base")
    docs, names = set_aside(docs, made + steps)
    text = F.coalesce(column(names[text_col]), F.lit(""))
    found = docs.withColumns({
        "_assign": _matches(text, ASSIGN, "assign", lambda r: F.length(r["g"]) >= 6, {"g": 2}),
        "_access": _matches(text, ACCESS, "access"),
        "_hex": _matches(text, HEX, "hex"),
        "_cand": _matches(text, CANDIDATE, "entropy", lambda r: ~_allowed(r["v"])),
        "_part": _matches(text, PART, "entropy", lambda r: ~_allowed(r["v"])),
    })
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    found = found.withColumns({"_base": F.concat(bare(F.col("_assign")), bare(F.col("_access")), bare(F.col("_hex")))})
    found = found.withColumns({"secret_spans": F.when(F.size("_part") > 0, F.concat(F.col("_base"), _merged(_entropy_spans(F.concat("_cand", "_part"))))).when(F.size("_cand") > 0, F.concat(F.col("_base"), _entropy_spans(F.col("_cand")))).otherwise(F.col("_base"))})
    return found.withColumns({
        "n_assign": F.size("_assign").cast("long"), "n_access": F.size("_access").cast("long"), "n_hex": F.size("_hex").cast("long"),
        "base_sha256": F.sha2(_joined(F.col("_base")).cast("binary"), 256), "spans": _joined(F.col("secret_spans")),
    }).drop(*steps)


def redacted(docs: DataFrame, *, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret span of the text replaced by the mark; overlapping spans become one.  Null stays null.

    length_col, where docs has it, follows the text's length.  The columns and
    their types are those of docs, whatever their names.
    """
    docs[f"`{text_col}`"]
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(acc["text"], acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        acc["text"].alias("text"),
    )

    def use(plain: DataFrame, names: dict[str, str]) -> DataFrame:
        found, own = find_secrets(plain, text_col=names[text_col]), names[text_col]
        text = F.col(own)
        # spans that begin inside what is already replaced only move its end
        clean = F.aggregate(
            F.array_sort(F.col("secret_spans")), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), text.alias("text")), step, lambda acc: F.concat(acc["out"], F.substr(acc["text"], acc["at"] + 1))
        )
        made = found.withColumn(own, F.when(F.size("secret_spans") > 0, clean).otherwise(text))
        if length_col in names:
            made = made.withColumn(names[length_col], F.length(own).cast(docs.schema[length_col].dataType))
        return made

    return plainly(docs, use)
