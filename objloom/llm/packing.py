"""Operator 5: best-fit packing of token sequences under vector capacities.

A bin (sequence) has three capacities: tokens, documents, and attention cost
(the sum of squared lengths).  Pieces are placed longest first.  Of the bins
that can take a piece under *every* constraint, the one is chosen whose
residual vector after placing it has the least weighted norm (``rule="norm"``),
or whose residual has the greatest weighted dot-product with the piece
(``rule="dot"``).

Both rules see only a piece's length and a bin's residual vector, so bins in
the same state are interchangeable and so are pieces of one length.  The
packing is therefore computed once, *globally*, over the histogram of lengths:
at most ``capacity`` rows, whatever the corpus size.  Bins are held as runs of
consecutive numbers; the plan is a list of rows "the pieces of length l with
ranks k..k+m go to bins b..b+m at offset o", whose number depends on the
capacities alone.  A piece then finds its bin by its rank among those of its
length, which needs no sort: each task numbers its own pieces by length, and
the tasks' counts (pre-aggregated, a row for each task and length) are summed
into bases.

Defined results: null and empty texts have the end id alone; a text whose ids
with the end id exceed the capacity is cut so that only its first piece may be
shorter; repeated rows are packed each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from objloom.llm.common import written
from objloom.llm.tokens import Encoder, Lookup, pre_tokens

CAPACITY = 1024
END_ID = 2
#: Weights of tokens, documents and attention cost, each as a part of its capacity.  Tokens come first.
WEIGHTS = (1.0, 1e-4, 1e-4)

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("_task", T.LongType()), T.StructField("_rank", T.LongType()),
])


def pieces_of(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many ids."""
    head = (total - 1) % capacity + 1
    cuts = [0, *range(head, total + 1, capacity)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def tokenised(docs: DataFrame, path: str, *, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece, with its rank among those of the same length in its task."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        enc = Encoder(path)
        raw = lambda ids: np.asarray(ids, "<u4").tobytes()
        get = Lookup({}, lambda s: raw(enc.piece(s)))
        end = raw([end_id])
        seen = np.zeros(capacity + 1, np.int64)
        step = 4 * capacity
        for b in batches:
            out: list[list[int]] = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    ids = end
                elif enc.is_special(text):
                    ids = raw(enc.whole(text)) + end
                else:
                    units = pre_tokens(text)
                    ids = b"".join([raw(enc.piece(units[0])), *map(get.__getitem__, units[1:]), end])
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    for x, v in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), int(seen[length])), strict=True):
                        x.append(v)
                    seen[length] += 1
            n = len(out[0])
            cols = [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols[:5], pa.array(np.full(n, task), pa.int64()), cols[5]], names=PIECES.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], *, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights=WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Rows (length, first rank, first bin, offset), sorted, of the packing of so many pieces of each length.

    A state is (tokens, documents, cost) left.  For each state there is a list
    of runs of bins; placing m pieces moves the first m bins to the state that
    results.  With the default limits the other two capacities never bind, so
    no more sequences are used than tokens alone would need.
    """
    docs_cap, cost_cap = max_docs or capacity, max_cost or capacity * capacity
    if counts and (docs_cap < 1 or max(counts) > capacity or max(counts) ** 2 > cost_cap):
        raise ValueError("a piece alone exceeds a bin's capacities")
    caps = np.array([capacity, docs_cap, cost_cap], float)
    wt = np.asarray(weights)
    states: dict[tuple[int, int, int], list[list[int]]] = {}
    by_left: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    lefts: list[int] = []  # tokens left for which by_left isn't empty, sorted
    rows, bins = [], 0

    def put(state, first, n) -> None:
        if state[0] <= 0:
            return
        runs = states.get(state)
        if runs is None:
            runs = states[state] = []
            if not by_left[state[0]]:
                bisect.insort(lefts, state[0])
            by_left[state[0]].append(state)
        runs.append([first, n])

    def drop(state) -> None:
        del states[state]
        by_left[state[0]].remove(state)
        if not by_left[state[0]]:
            lefts.remove(state[0])

    def best(length):
        item = np.array([length, 1, length * length]) / caps
        found, at = None, None
        i = bisect.bisect_left(lefts, length)
        while i < len(lefts):
            left = lefts[i]
            if found is not None and rule == "norm" and wt[0] * ((left - length) / capacity) ** 2 > at:
                break  # the first part of the norm alone is greater from here on
            for s in by_left[left]:
                if s[1] >= 1 and s[2] >= length * length:
                    r = np.array(s) / caps
                    v = float(wt @ (r - item) ** 2) if rule == "norm" else -float(wt @ (r * item))
                    if at is None or v < at or v == at and s < found:
                        found, at = s, v
            i += 1
        return found

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            s = best(length)
            if s is None:  # open as many bins as these pieces fill, or one; the next turns of this loop fill them further
                deep = max(1, min(capacity // length, docs_cap, cost_cap // (length * length)))
                n = max(1, todo // deep)
                rows.append((length, rank, bins, 0))
                put((capacity - length, docs_cap - 1, cost_cap - length * length), bins, n)
                bins, rank, todo = bins + n, rank + n, todo - n
                continue
            first, n = states[s][-1]
            m = min(n, todo)
            rows.append((length, rank, first, capacity - s[0]))
            if m == n:
                states[s].pop()
                if not states[s]:
                    drop(s)
            else:
                states[s][-1] = [first + m, n - m]
            put((s[0] - length, s[1] - 1, s[2] - length * length), first, m)
            rank, todo = rank + m, todo - m
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
         max_docs: int | None = None, max_cost: int | None = None, weights=WEIGHTS, rule: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    made = written(tokenised(docs, path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    per_task = made.groupBy("_task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    steps = spark.sparkContext.broadcast(plan(counts, capacity=capacity, max_docs=max_docs, max_cost=max_cost, weights=weights, rule=rule))
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    bases = per_task.select("_task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = made.join(bases, ["_task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_rank")).alias("_rank"))
    out = T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        rows = steps.value
        shift = np.int64(1) << 48
        keys = rows[:, 0] * shift + rows[:, 1]
        for b in batches:
            if b.num_rows:
                length, rank = (b.column(c).to_numpy() for c in ("length", "_rank"))
                at = np.searchsorted(keys, length * shift + rank, "right") - 1
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])], names=out.names)

    return ranked.mapInArrow(place, out)
