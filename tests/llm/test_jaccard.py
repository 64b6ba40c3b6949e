import itertools
import random

import numpy as np

from objloom.llm import jaccard
from tests.llm.helpers import EDGE_TEXTS, by_id, frame, words


def brute(texts):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else None for t in texts]
    classes = {}
    for i, s in enumerate(sets):
        if s:
            classes.setdefault(s, []).append(i)
    keys = list(classes)
    links = {k: [] for k in keys}
    for a, b in itertools.combinations(keys, 2):
        common = len(a & b)
        if 5 * common >= 4 * len(a | b):
            links[a].append(b)
            links[b].append(a)
    out = {}
    for i, s in enumerate(sets):
        if not s:
            out[i] = (i, i, 1, 0)
            continue
        seen, todo = {s}, [s]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out[i] = (min(min(classes[k]) for k in seen), min(classes[s]), len(classes[s]), len(links[s]))
    return out


def corpus(seed, groups=12, hot=60):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(3000)]
    texts = list(EDGE_TEXTS)
    for g in range(groups):
        base = [r.choice(vocab) for _ in range(r.choice([3, 5, 30, 120, 400]) if g else 400)]
        for _ in range(hot if g == 0 else r.randrange(1, 6)):
            own = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 100))):
                own[r.randrange(len(own))] = r.choice(vocab)
            texts.append(" ".join(own).upper() if r.random() < 0.2 else ", ".join(own))
    texts += [texts[-1]] * 5
    return texts


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        got = by_id(jaccard.join(frame(spark, texts).selectExpr("*", "0 AS class_id", "1 AS id", "2 AS set")))
        want = brute(texts)
        assert {i: (r.class_id, r.copy_id, r.n_copies, r.n_links) for i, r in got.items()} == want
        assert any(v[3] > 20 for v in want.values())


def test_groups_over_several_blocks(spark, monkeypatch):
    """Links and classes don't depend on how a group is cut."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "NODE_ROWS", 5)
    texts = corpus(3)
    got = by_id(jaccard.join(frame(spark, texts)))
    assert {i: (r.class_id, r.copy_id, r.n_copies, r.n_links) for i, r in got.items()} == brute(texts)


def test_distinct_keeps_one_of_each_class(spark):
    texts = corpus(4)
    docs = frame(spark, texts)
    kept = [r.doc_id for r in jaccard.distinct(docs.unionAll(docs)).collect()]
    assert sorted(kept) == sorted({v[0] for v in brute(texts).values()})
    assert jaccard.distinct(docs.where("false")).count() == 0


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "seven eight nine ten eleven twelve"), (None, "one two three four five six"), (3, None)], "doc_id long, text string")
    got = jaccard.join(docs).collect()
    assert len(got) == 5 and sorted(r.n_copies for r in got) == [1, 2, 2, 2, 2]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100}


def test_depth_and_sketch():
    k = jaccard.depth_for()
    assert 1 - (1 - 0.8**k) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** jaccard.TREES
    rng = np.random.default_rng(0)
    s = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    a, b = jaccard.signature(s[:4500]), jaccard.signature(s[500:])
    assert abs((a == b).mean() - 4000 / 5000) < 0.12
    assert jaccard.shingles(b"A b, c! d e").tolist() == jaccard.shingles(b" a B c d  E").tolist()
    assert len(jaccard.shingles("x y z".encode())) == 1 and len(jaccard.shingles(b"?!")) == 0


def walk(rows, depth=2, cut=3):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.binary()) for i in range(3)], names=["p", "s", "c"]) for part in (rows[:cut], rows[cut:])]
    return [tuple(x.values()) for b in jaccard._nodes(depth)(batches) for x in b.to_pylist()]


def linked(links, start):
    up = {}
    for a, b, _ in links:
        up.setdefault(a, set()).add(b)
        up.setdefault(b, set()).add(a)
    seen, todo = {start}, [start]
    while todo:
        for k in up.get(todo.pop(), set()) - seen:
            seen.add(k)
            todo.append(k)
    return seen


def test_large_nodes_are_linked_as_they_go_by(monkeypatch):
    monkeypatch.setattr(jaccard, "NODE_ROWS", 4)
    same, other = bytes(32), bytes([0x12] * 32)
    path = lambda k, rest: bytes([0, 0, k, 0, 1]) + rest
    rows = [(path(7, b"%d" % i), b"%d" % i, same) for i in (1, 2, 3, 5, 7, 8, 9)] + [(path(8, b"1"), b"x", same), (path(8, b"4"), b"y", other), (path(8, b"6"), b"z", same)]
    links = walk(rows)
    assert linked(links, b"3") == {b"1", b"2", b"3", b"5", b"7", b"8", b"9"}
    assert (b"z", b"x", 64) in links and not any(b"y" in x[:2] for x in links)


def test_nodes_are_prefixes_of_sorted_paths():
    """With shorter prefixes more rows meet; longer ones are within them."""
    r = random.Random(2)
    rows = sorted((bytes([0] + [r.randrange(2) for _ in range(8)]), b"%d" % i, bytes(32)) for i in range(60))
    parts = {}
    for depth in (4, 2, 1):
        links = walk(rows, depth, 17)
        got = {frozenset(linked(links, i)) for _, i, _ in rows}
        want = {}
        for p, i, _ in rows:
            want.setdefault(p[: 1 + 2 * depth], set()).add(i)
        assert got == {frozenset(x) for x in want.values()}
        parts[depth] = got
    assert all(any(x <= y for y in parts[1]) for x in parts[4])


def test_estimated_recall():
    """The inverse-probability estimate is the share of pairs met, for pairs of known similarity."""
    rng = np.random.default_rng(1)
    for depth in (6, 4):
        found, met, n = {}, 0, 4000
        for j in rng.choice([0.82, 0.86, 0.95], n):
            same = rng.random((jaccard.DEPTH, jaccard.TREES)) < j
            if same[:depth].all(0).any():
                k = round(64 * (1 / 16 + 15 / 16 * j))
                found[k] = found.get(k, 0) + 1
                met += 1
        assert abs(jaccard.estimated_recall(found, depth)[0] - met / n) < 0.006
    assert jaccard.estimated_recall({}, 5) == (0.0, 0)


def test_depth_adapts(spark, monkeypatch):
    """Pairs that are much alike end the walk early; pairs at the threshold shorten the prefixes to the last depth."""
    seen, keep = [], jaccard._nodes
    monkeypatch.setattr(jaccard, "_nodes", lambda depth: seen.append(depth) or keep(depth))
    r = random.Random(8)
    vocab = ["w%d" % i for i in range(5000)]
    for changes, want in ((1, [6]), (9, [6, 5, 4])):
        texts = []
        for _ in range(400):
            own = [r.choice(vocab) for _ in range(420)]
            texts.append(" ".join(own))
            for k in range(changes):
                own[5 + 46 * k] = r.choice(vocab)
            texts.append(" ".join(own))
        seen.clear()
        got = by_id(jaccard.join(frame(spark, texts)))
        assert seen == want
        assert sum(got[2 * i].class_id == got[2 * i + 1].class_id for i in range(400)) >= 398


def test_measured_recall_of_near_copies(spark):
    """Pairs of every similarity from 0.8 up, each far from all other texts: at least 99.5 % are found, and no pair under 0.8."""
    r = random.Random(11)
    texts, want = [], []
    for i in range(500):
        own = [f"w{i}x{k}" for k in range(r.randrange(60, 300))]
        other = list(own)
        for k in r.sample(range(len(own)), r.randrange(0, 1 + len(own) // 35)):
            other[k] = "new"
        sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (own, other)]
        want.append(5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1]))
        texts += [" ".join(own), " ".join(other)]
    got = by_id(jaccard.join(frame(spark, texts)))
    found = [got[2 * i].class_id == got[2 * i + 1].class_id for i in range(500)]
    assert sum(w and f for w, f in zip(want, found, strict=True)) >= 0.995 * sum(want) > 100
    assert not any(f and not w for w, f in zip(want, found, strict=True))
