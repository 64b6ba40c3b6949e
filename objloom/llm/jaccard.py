"""Operator 3: n-gram Jaccard self-join by a MinHash LSH forest.

Shingles are five consecutive words (all words of a shorter text); texts are
linked if the Jaccard similarity of their shingle sets is 0.8 or more.

1. *Sketch*: each text gets the 128-bit digest of its shingle set and a
   signature of ``TREES`` x ``DEPTH`` MinHash values, 16 bits of each.  Rows with
   the same digest form a *copy class*; from here on there is one row for each
   class, so copies cost nothing.
2. *Forest*: in each tree, classes are sorted by their path, the tree's 8 values
   in order; equal prefixes of a length are neighbours and form a node of the
   trie.  The walk begins with prefixes of ``FIRST`` values.  In a node, pairs
   are told apart whose coarse signatures (4 bits of each of 64 values) can't
   belong to similar sets, and the rest is linked; a node of over ``NODE_ROWS``
   rows is linked without that test, which loses nothing.  Links span a node's
   parts, they aren't a pair list.
3. *Adaptive depth*: each link's coarse agreement tells its similarity J, and
   with prefixes of d values a pair is met with probability
   p = 1 - (1 - J^d)^TREES.  The links found of similarity 0.8 or more, each
   counted 1/p times, estimate how many there are, and so the recall.  While it
   is under ``RECALL`` (or there are fewer than ``EVIDENCE`` links to tell),
   prefixes are shortened by a value and the tries walked again, down to the
   depth at which even a pair at the threshold is met with that probability (4).
4. *Candidate groups* are the connected components of all links (distributed
   min-label propagation, each round written to the shared folder).
5. *Exact verification*: the shingle sets of a group come together once.  All
   pairs of a group are compared exactly (sparse incidence products), also
   those that no tree brought together.  A group is cut into blocks of about
   ``BLOCK_ROWS`` classes (or ``BLOCK_SHINGLES`` shingles), and each pair of
   blocks is a task's unit of work, so no group has to fit into one task.  A
   set is sent once for each block of its group: a group of m classes moves
   m * m / BLOCK_ROWS sets, the least that exact counts of links take with
   tasks of that size.  A unit gives, for each class, its number of links and a
   link to the least class that it is united with.
6. *Classes* are the components of the verified links.

What a pair can be missed by: no tree (0.0003 at a similarity of 0.8 and depth
4, less above), and the coarse test (``AGREE``; 64 values of which 52 agree at
0.8, 5 standard deviations above it: 2e-6).  Both are missed only if no third
text links them to the same group.

Result, one row for each input row: class_id (the least id of the component),
copy_id (the least id of the copy class), n_copies (rows in the copy class) and
n_links (other copy classes with similarity >= 0.8).

Defined results: null and texts without words have no shingles, no links, and
are classes of their own; repeated rows are copies; ids may repeat, and as
classes are named by their least id, two classes whose least ids are equal then
have the same class_id; ties go to the least id; empty tables give no rows;
extra columns are ignored by join and kept by distinct, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from objloom.llm.common import WORD_TABLE, column, plainly, utf8, written

SHINGLE = 5
#: The least similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
TREES, DEPTH = 16, 8
#: Length of the prefixes that the walk begins with, recall at which it ends, and the links it takes to estimate that.
FIRST, RECALL, EVIDENCE = 6, 0.9995, 200
NODE_ROWS = 2_048
#: Coarse agreement below which a pair isn't similar: 64 values, each by chance equal in 1 of 16; over five standard deviations below the threshold.
COARSE, AGREE = 64, 36
BLOCK_ROWS, BLOCK_SHINGLES = 512, 600_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.frombuffer(b"".join(hashlib.blake2b(b"%d" % b, digest_size=8).digest() for b in range(256)), "<u8") | np.uint64(1)
_MULT = np.frombuffer(b"".join(hashlib.blake2b(b"m%d" % i, digest_size=8).digest() for i in range(TREES * DEPTH)), "<u8") | np.uint64(1)
_STEP = np.frombuffer(b"".join(hashlib.blake2b(b"s%d" % i, digest_size=8).digest() for i in range(SHINGLE)), "<u8") | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1 << 14, np.uint64)
_UNPOWERS = np.ones(1 << 14, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _UNPOWERS
    if n > len(_POWERS) or _POWERS[1] == 1:
        size = max(1 << 14, 1 << n.bit_length())
        up, down = np.full(size, _ODD), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS, _UNPOWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[:n], _UNPOWERS[:n]


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, empty without words."""
    data = np.frombuffer(text.translate(WORD_TABLE), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 0x20
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up, dtype=np.uint64)])
    word = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    n = len(word)
    if n < SHINGLE:
        h = (word * _STEP[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)
    else:
        h = np.zeros(n - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            h += word[i : n - SHINGLE + 1 + i] * _STEP[i]
    return np.unique(mixed(h))


def set_id(s: np.ndarray) -> bytes:
    """The set's digest."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair of that similarity shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, similarity: float = NUMERATOR / DENOMINATOR) -> int:
    """The longest prefix at which a pair at the threshold is found with that probability."""
    while depth > 1 and chance(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def estimated_recall(found: dict[int, int], depth: int) -> tuple[float, int]:
    """The share of all links that was met at a depth, and the number of links it is told from, from their numbers by coarse agreement."""
    similar = {min(1.0, (k / COARSE - 1 / 16) * 16 / 15): n for k, n in found.items() if k / COARSE >= 1 / 16 + 15 / 16 * NUMERATOR / DENOMINATOR}
    n, total = sum(similar.values()), sum(n / chance(j, depth) for j, n in similar.items())
    return (n / total if n else 0.0), n


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values; long sets go through in stretches, so memory is bounded."""
    low = np.full(len(_MULT), 2**64 - 1, np.uint64)
    for a in range(0, len(s), 2048):
        np.minimum(low, (s[None, a : a + 2048] * _MULT[:, None]).min(1), out=low)
    return low


SKETCH = "id long, hash long, set binary, size long, paths array<binary>, coarse binary"


def paths(low: np.ndarray) -> list[bytes]:
    """For each tree its number and its DEPTH values, 16 bits each, so that paths sort as the trie does."""
    values = (low.reshape(DEPTH, TREES).T & np.uint64(0xFFFF)).astype(">u2")
    return [bytes([t]) + values[t].tobytes() for t in range(TREES)]


def _sketches(batches):
    for b in batches:
        out: list[list] = [[] for _ in range(4)]
        for text in utf8(b.column(1)):
            s = shingles(text)
            if len(s):
                low = mixed(signature(s))
                nibble = (low[:COARSE] >> np.uint64(32) & np.uint64(15)).astype(np.uint8)
                row = (set_id(s), len(s), paths(low), (nibble[::2] << 4 | nibble[1::2]).tobytes())
            else:
                row = (None, 0, None, None)
            for x, v in zip(out, row, strict=True):
                x.append(v)
        kinds = (pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=["id", "hash", "set", "size", "paths", "coarse"])


class Union:
    """Union-find over 0..n-1; the least member is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> list[int]:
        return [self.find(i) for i in range(len(self.up))]


def _unpacked(coarse: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(coarse), np.uint8).reshape(len(coarse), COARSE // 2)
    return np.concatenate([x >> 4, x & 15], 1)


def node_links(ids: list[bytes], coarse: list[bytes]) -> list[tuple[bytes, bytes, int]]:
    """Links (class, another, coarse agreement) that span the parts of a trie node."""
    n = len(ids)
    sig = _unpacked(coarse)
    if n == 2:
        k = int((sig[0] == sig[1]).sum())
        return [(ids[1], ids[0], k)] if k >= AGREE else []
    union, out = Union(n), []
    left = np.arange(n)
    while len(left) > 1:  # take the first of what is left, link it to all that agree, and go on with the others against everything
        head, rest = int(left[0]), left[1:]
        agree = (sig[rest] == sig[head]).sum(1)
        near = np.flatnonzero(agree >= AGREE)
        for i in near:
            if union.find(int(rest[i])) != union.find(head):
                union.unite(head, int(rest[i]))
                out.append((ids[rest[i]], ids[head], int(agree[i])))
        left = rest
        if len(out) == n - 1:
            break  # one part
    return out


LINKS = "a binary, b binary, agree int"


def _nodes(depth: int):
    """Rows (path, class, coarse) sorted by path to links; a node that outgrows NODE_ROWS is linked to its first class as it goes by."""
    from itertools import chain

    def run(batches):
        key, ids, coarse, lead = None, [], [], None
        out: list[tuple[bytes, bytes, int]] = []

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.binary(), pa.binary(), pa.int32()))], names=["a", "b", "agree"])
            out.clear()
            return made

        for b in chain(batches, [None]):
            cols = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if b is not None else [(None, None, None)]
            for path, i, c in cols:
                k = path[: 1 + 2 * depth] if path is not None else None
                if k != key:
                    if lead is None and len(ids) > 1:
                        out += node_links(ids, coarse)
                    key, ids, coarse, lead = k, [], [], None
                if k is None:
                    continue
                if lead is not None:
                    out.append((i, lead, 0))
                    continue
                ids.append(i)
                coarse.append(c)
                if len(ids) > NODE_ROWS:
                    lead = ids[0]
                    out += [(x, lead, 0) for x in ids[1:]]
                    ids, coarse = [], []
            yield flush()

    return run


def forest(classes: DataFrame) -> DataFrame:
    """Links of classes (set, paths, coarse), with prefixes shortened until the estimated recall is RECALL."""
    tries, last, links = classes.select(F.explode("paths").alias("path"), "set", "coarse"), depth_for(), None
    for depth in range(max(FIRST, last), last - 1, -1):
        deal = tries.repartition(F.substring("path", 1, 1 + 2 * depth)).sortWithinPartitions("path")
        found = written(deal.mapInArrow(_nodes(depth), LINKS).distinct(), "links")
        links = found if links is None else links.unionAll(found)
        recall, n = estimated_recall({r["agree"]: r["n"] for r in found.groupBy("agree").agg(F.count("*").alias("n")).collect()}, depth)
        if recall >= RECALL and n >= EVIDENCE:
            break
    return links.select("a", "b")


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """node, root (its component's least node) from links a-b, for nodes with links.

    Each round hooks every root to the least root next to it and then halves
    the paths, so long chains take a logarithmic number of rounds.  A round's
    rows are at most the links and nodes; it is written to the shared folder.
    """
    links = written(links.where("a <> b").distinct(), f"{name}-links")
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    label = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), name)
    while True:
        of = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        near = links.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select("a", "b", F.greatest("ra", "rb").alias("hi"), F.least("ra", "rb").alias("lo"))
        # the greater root, and both ends, go to the lesser root
        hooks = near.select(F.explode(F.array("hi", "a", "b")).alias("node"), "lo").groupBy("node").agg(F.min("lo").alias("lo"))
        moved = label.join(hooks, "node", "left").select("node", F.least("root", F.coalesce("lo", "root")).alias("root"), F.col("lo").isNotNull().alias("moved"))
        moved = written(moved, name)
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        # whatever stood below a root that has moved follows it
        up = moved.where("moved").select(F.col("node").alias("root"), F.col("root").alias("up"))
        label = written(moved.select("node", "root").join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), name)


def similar(sets: list[np.ndarray], side: np.ndarray | None) -> tuple[np.ndarray, list[int]]:
    """Links of each set, and the index of the least member it is united with.  side: only pairs of different sides count."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    degree = np.zeros(n, np.int64)
    union = Union(n)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if common * DENOMINATOR >= NUMERATOR * (size.sum() - common) and (side is None or side[0] != side[1]):
            degree += 1
            union.unite(0, 1)
        return degree, union.roots()
    owner = np.repeat(np.arange(n), size)
    joined = np.concatenate(sets)
    _, column, count = np.unique(joined, return_inverse=True, return_counts=True)
    kept = count[column] > 1
    number = np.cumsum(count > 1) - 1
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int((count > 1).sum())
    step = max(256, (16 << 20) // max(1, n))
    common = np.zeros((n, n), np.float32)
    for a in range(0, total, step):
        lo, hi = np.searchsorted(column, (a, a + step))
        block = np.zeros((n, min(step, total - a)), np.float32)
        block[owner[lo:hi], column[lo:hi] - a] = 1
        common += block @ block.T
    ok = common * DENOMINATOR >= NUMERATOR * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(ok, False)
    if side is not None:
        ok &= side[:, None] != side[None, :]
    degree += ok.sum(1)
    todo = np.ones(n, bool)  # breadth-first from each member not reached yet, whole rows at once
    for i in range(n):
        if todo[i]:
            todo[i] = False
            front = [i]
            while front:
                new = ok[front].any(0) & todo
                todo &= ~new
                front = np.flatnonzero(new).tolist()
                for j in front:
                    union.up[j] = i
    return degree, union.roots()


UNIT = ["root", "low", "high"]


def _verify(batches):
    """Sorted rows (root, low, high, set, side, shingles) to (set, links, least set united with)."""
    from itertools import chain

    key, ids, sides, sets = None, [], [], []
    out: list[tuple[bytes, int, bytes]] = []
    for b in chain(batches, [None]):
        rows = zip(*(b.column(i).to_pylist() for i in range(6)), strict=True) if b is not None else [(None,) * 6]
        for root, low, high, i, side, s in rows:
            k = (root, low, high) if root is not None else None
            if k != key:
                if len(ids) > 1:  # sorted by set already
                    cross = np.array(sides)
                    degree, at = similar(sets, cross if cross.any() else None)
                    out += [(ids[j], int(degree[j]), ids[at[j]]) for j in range(len(ids))]
                key, ids, sides, sets = k, [], [], []
            if k is not None and (not ids or i != ids[-1]):  # a class comes twice where ids repeat
                ids.append(i)
                sides.append(side)
                sets.append(np.frombuffer(s, "<u8"))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.binary()))], names=["set", "links", "root"])
        out.clear()


def classified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, class_id, copy_id, n_copies and n_links of every row of docs."""
    source = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    sketch = written(source.withColumn("hash", F.xxhash64("text")).mapInArrow(_sketches, SKETCH), "sketch")
    classes = written(
        sketch.where("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("copy_id"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("coarse").alias("coarse")),
        "classes",
    )
    groups = components(forest(classes), "group")
    # verification
    members = groups.join(classes.select(F.col("set").alias("node"), "copy_id", "size"), "node")
    sizes = members.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks")
    )
    members = members.join(sizes, "root").select(F.col("node").alias("set"), "copy_id", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    texts = source.where("text IS NOT NULL").join(members, F.expr("id <=> copy_id"))

    def sets(batches):
        for b in batches:
            keep, made = [], []
            for i, (text, known) in enumerate(zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True)):
                s = shingles(text)
                if set_id(s) == known:  # else another text of a repeated id
                    keep.append(i)
                    made.append(s.tobytes())
            b = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(made, pa.binary())], names=["set", "root", "blocks", "block", "shingles"])

    held = texts.select("text", "set", "root", "blocks", "block").mapInArrow(sets, "set binary, root binary, blocks int, block int, shingles binary")
    units = held.select(
        "root", "set", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "set",
        # 0: a block by itself, all pairs count; 1 and 2: pairs of different sides count
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"), "shingles",
    )
    verified = written(units.repartition(*UNIT).sortWithinPartitions(*UNIT, "set").mapInArrow(_verify, "set binary, links long, root binary"), "verified")
    # classes; a group in one block already has its components
    degree = verified.groupBy("set").agg(F.sum("links").alias("n_links"))
    final = components(verified.select(F.col("set").alias("a"), F.col("root").alias("b")), "class")
    named = classes.select("set", "copy_id", "n_copies").join(degree, "set", "left").join(final.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = named.join(least, "root").select("set", "class_id", "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sketch.select("id", "hash", "set").join(named, "set", "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("hash").alias("text_hash"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, copy_id, n_copies and n_links of every row of docs."""
    return classified(docs, id_col=id_col, text_col=text_col).drop("text_hash")


def distinct(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, the one of the least id (of equal rows, one)."""
    keep = classified(docs, id_col=id_col, text_col=text_col).where("doc_id <=> class_id").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()

    def use(plain: DataFrame, names: dict[str, str]) -> DataFrame:
        hashed = plain.withColumns({"own_id": F.col(names[id_col]).cast("long"), "own_hash": F.xxhash64(names[text_col])})
        kept = hashed.join(keep, F.expr("own_id <=> kept_id AND own_hash = kept_hash"), "left_semi")
        first = W.partitionBy("own_id", "own_hash").orderBy(F.lit(0))
        return kept.withColumn("own_rank", F.row_number().over(first)).where("own_rank = 1")

    return plainly(docs, use)
