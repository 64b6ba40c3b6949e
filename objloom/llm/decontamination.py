r"""Operator 8: benchmark decontamination by Wu-Manber multi-pattern search.

Texts become *canonical*: words (``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after
lower-casing A-Z) joined and surrounded by single spaces, in UTF-8.  A pattern
is a window of 8 consecutive words of a benchmark item in the same form, or
all words of a shorter item, so an occurrence always ends at whole words.

Patterns are put into classes by their length; a class has the length m of its
shortest pattern, a block length B, a *shift table* from each block of B bytes
in the first m bytes of a pattern to the distance by which the search may move
on, and *suffix buckets* from the block that ends at m to the patterns that
have it there.  A block that isn't in the table moves the search by m-B+1
bytes at once; a shift of nothing leads to the bucket, whose patterns are
compared directly.

The benchmark is the stated query set.  Its patterns are read in blocks of at
most ``BLOCK_BYTES``, so that a table stays small, and the blocks are tried in
*passes* of at most ``PASS_BYTES``: only one pass's blocks are broadcast and
held by a task.  A pass adds the intervals and items that it finds to those of
the passes before, and its result is written to the shared folder when another
one follows, so memory doesn't grow with the benchmark.  The driver sees the
benchmark as a stream, a pass at a time.

Defined results: null has no words; an item without words has no window and
never occurs; repeated item ids count once, their windows together; items
without an id are one item without a name: it counts in n_items and n_hit and
is left out of the digest; repeated documents give repeated rows; extra columns
are kept, those with a name of the results as ``input_<name>``; empty tables
give no rows, or no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from objloom.llm.common import appended, canonical_words, column, plainly, set_aside, utf8, written

WINDOW_WORDS = 8
BLOCK_BYTES = 2 << 20
#: Bytes of patterns that are broadcast at once.
PASS_BYTES = 32 << 20
#: Least lengths of the classes of patterns.
CLASSES = (40, 24, 12, 0)


def windows(text: bytes, size: int = WINDOW_WORDS) -> set[bytes]:
    """Canonical windows of a text."""
    words = canonical_words(text)
    return {b" %b " % b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Class:
    """Wu-Manber tables for patterns of a class."""

    def __init__(self, patterns: list[bytes]) -> None:
        m = self.m = min(map(len, patterns))
        block = self.block = max(1, min(8, m // 3 + 1))
        self.default = m - block + 1
        shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(block, m + 1):
                k, s = p[end - block : end], m - end
                if shift.get(k, self.default) > s:
                    shift[k] = s
            self.bucket[p[m - block : m]].append(p)
        self.shift, self.bucket = shift, dict(self.bucket)

    def search(self, text: bytes):
        """(start, pattern) of every occurrence, by start."""
        block, m, default, get, bucket = self.block, self.m, self.default, self.shift.get, self.bucket
        end, n = m, len(text)
        while end <= n:
            s = get(text[end - block : end], default)
            if s:
                end += s
                continue
            at = end - m
            for p in bucket[text[end - block : end]]:
                if text.startswith(p, at):
                    yield at, p
            end += 1


class Searcher:
    """All classes of a block of patterns; pattern -> item numbers."""

    def __init__(self, items: dict[bytes, list[int]]) -> None:
        self.items = items
        classes: dict[int, list[bytes]] = defaultdict(list)
        for p in sorted(items):
            classes[next(c for c in CLASSES if len(p) >= c)].append(p)
        self.classes = [Class(x) for x in classes.values()]

    def hits(self, canonical: bytes) -> tuple[list[tuple[int, int]], set[int]]:
        """Intervals of hit words (end exclusive) and the items found."""
        spans, found = [], set()
        for c in self.classes:
            word, at = 0, 0
            for start, p in c.search(canonical):
                word += canonical.count(b" ", at, start)
                at = start
                spans.append((word, word + p.count(b" ") - 1))
                found.update(self.items[p])
        return spans, found


def pattern_blocks(benchmark: DataFrame, *, id_col: str, text_col: str, limit: int) -> Iterator[tuple[int, dict[bytes, list[int]], list[str | None]]]:
    """Blocks of (bytes, pattern -> numbers of items, item ids as text) of at most ``limit`` bytes of patterns, but one item at least, as they come."""
    size, patterns, ids = 0, {}, []
    for row in benchmark.select(column(id_col).cast("string").alias("i"), column(text_col).alias("t")).where("t IS NOT NULL").sort("i").toLocalIterator():
        new = windows(row.t.encode())
        more = sum(map(len, new))
        if size + more > limit and ids and row.i != ids[-1]:
            yield size, patterns, ids
            size, patterns, ids = 0, {}, []
        if not ids or row.i != ids[-1]:
            ids.append(row.i)
        for p in new:
            own = patterns.setdefault(p, [])
            if not own or own[-1] != len(ids) - 1:
                own.append(len(ids) - 1)
        size += more
    yield size, patterns, ids


def passes(blocks: Iterable[tuple], limit: int) -> Iterator[tuple[list[tuple], bool]]:
    """Lists of blocks of at most ``limit`` bytes (one block at least), and whether it is the last."""
    held, size = [], 0
    for b in blocks:
        if held and size + b[0] > limit:
            yield held, False
            held, size = [], 0
        held.append(b)
        size += b[0]
    yield held, True


FIELDS = (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("hit_items", T.ArrayType(T.StringType())))
#: What a pass hands on: the merged intervals of hit words as a flat list, the names found, and whether a nameless item was.
_PARTIAL = (("_spans", T.ArrayType(T.LongType())), ("_names", T.ArrayType(T.StringType())), ("_nameless", T.BooleanType()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_items: int = 2, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, and hit_items (sorted item ids)."""
    sc = docs.sparkSession.sparkContext
    docs, names = set_aside(docs, [n for n, _ in FIELDS + _PARTIAL])
    own, first = docs.columns, True
    for blocks, last in passes(pattern_blocks(benchmark, id_col=item_id, text_col=item_text, limit=block_bytes), pass_bytes):
        held = sc.broadcast([b[1:] for b in blocks])
        # the loop's values, as the function runs later
        made = _pass(held, [docs.columns.index(n) for n, _ in _PARTIAL] if not first else None, last, min_items)
        docs = appended(docs.select(*[column(c).alias(f"{c}_before" if c in dict(_PARTIAL) else c) for c in docs.columns]), [T.StructField(*f) for f in (FIELDS if last else _PARTIAL)], made, names[text_col])
        if not last:
            docs = written(docs.select(*[column(c) for c in own], *(n for n, _ in _PARTIAL)), "contamination")
            held.unpersist()
        first = False
    return docs.select(*[column(c) for c in own], *(n for n, _ in FIELDS))


def _pass(held, before_at: list[int] | None, last: bool, min_items: int):
    """The function of a pass; before_at are the columns of what the passes before found, None in the first.""" 

    def make(text_col):
        searchers = [(Searcher(patterns), names) for patterns, names in held.value]

        def work(batch: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in range(6 if last else 3)]
            before = zip(*(batch.column(i).to_pylist() for i in before_at), strict=True) if before_at is not None else [((), (), False)] * batch.num_rows
            for text, (had, names_had, nameless) in zip(utf8(batch.column(text_col)), before, strict=True):
                words = canonical_words(text)
                canonical = b" %b " % b" ".join(words) if words else b""
                spans, ids = list(zip(had[::2], had[1::2], strict=True)), {*names_had, *([None] if nameless else [])}
                for searcher, names in searchers:
                    got, found = searcher.hits(canonical)
                    spans += got
                    ids.update(names[i] for i in found)
                known = sorted(ids - {None})
                spans = merged(spans)
                if last:
                    row = (len(words), sum(b - a for a, b in spans), len(ids), hashlib.sha256(",".join(known).encode()).hexdigest(), len(ids) >= min_items, known)
                else:
                    row = ([x for s in spans for x in s], known, None in ids)
                for x, v in zip(out, row, strict=True):
                    x.append(v)
            return out

        return work

    return make


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no window of any item, with the columns of docs alone."""
    docs[f"`{text_col}`"]
    return plainly(docs, lambda d, names: contamination(d, benchmark, text_col=names[text_col], min_items=1, **options).where("NOT contaminated"))
