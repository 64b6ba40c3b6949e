import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from objloom.llm import packing
from tests.llm.helpers import EDGE_TEXTS, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(rows, texts, capacity):
    ids = {i: LIBRARY.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    bins = {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == i)
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for *_, n in own) == len(x)
        assert all(n == capacity for _, _, n in own[1:]) and (len(x) > capacity or len(own) == 1)
    for x in bins.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    return bins


def test_edges(spark):
    texts = [*EDGE_TEXTS, *(f"document number {i} " * (i % 40) for i in range(200))]
    rows = packing.pack(frame(spark, texts).selectExpr("*", "1 AS piece", "2 AS length").repartition(3), PATH).collect()
    bins = check(rows, texts, 1024)
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 1024) + 1
    assert packing.pack(frame(spark, texts).where("false"), PATH).count() == 0


def test_whole_table_needs_few_sequences(spark, small):
    rows = packing.pack(spark.read.parquet(f"{small}/documents.parquet"), PATH).collect()
    assert len({r.sequence_id for r in rows}) <= 1.01 * -(-sum(r.length for r in rows) // 1024)


def place(counts, rows):
    bins = {}
    for n, c in counts.items():
        own = [r for r in rows if r[0] == n]
        for rank in range(c):
            r = max((x for x in own if x[1] <= rank), key=lambda x: x[1])
            bins.setdefault(r[2] + rank - r[1], []).append((r[3], n))
    return bins


def brute_best_fit(counts, capacity, docs, cost):
    """One bin at a time, over the same order."""
    bins = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = [b for b in bins if b[0] >= n and b[1] >= 1 and b[2] >= n * n]
            b = min(fit, key=lambda b: b[0]) if fit else None
            if b is None:
                bins.append(b := [capacity, docs, cost])
            b[0], b[1], b[2] = b[0] - n, b[1] - 1, b[2] - n * n
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("docs", "cost"), [(None, None), (3, None), (None, 4000), (2, 5000)])
def test_plan_keeps_every_constraint(rule, docs, cost):
    r = random.Random(1)
    for _ in range(20):
        counts = {n: r.randrange(1, 30) for n in r.sample(range(1, 64), 20)}
        bins = place(counts, packing.plan(counts, capacity=64, max_docs=docs, max_cost=cost, rule=rule).tolist())
        assert sum(map(len, bins.values())) == sum(counts.values())
        for x in bins.values():
            at = 0
            for offset, n in sorted(x):
                assert offset == at
                at += n
            assert at <= 64 and len(x) <= (docs or 64) and sum(n * n for _, n in x) <= (cost or 4096)
        if rule == "norm":
            assert len(bins) <= brute_best_fit(counts, 64, docs or 64, cost or 4096) * 1.05 + 2


def test_plan_size_does_not_follow_the_corpus():
    r = random.Random(2)
    counts = {n: r.randrange(1, 50) for n in range(1, 1025)}
    a, b = (len(packing.plan({n: c * k for n, c in counts.items()})) for k in (1, 1000))
    assert b <= 3 * a and b < 60_000


def test_a_piece_beyond_a_capacity_is_refused():
    with pytest.raises(ValueError):
        packing.plan({64: 1}, capacity=64, max_cost=4000)


def brute_vector_fit(counts, caps, rule, weights):
    """Vector best-fit one piece at a time: every open bin that fits, by weighted dot-product or residual norm."""
    bins = []
    for n in sorted(counts, reverse=True):
        item = (n, 1, n * n)
        for _ in range(counts[n]):
            fit = [b for b in bins if all(x >= y for x, y in zip(b, item, strict=True))]
            share = lambda b: [(x / c, y / c) for x, y, c in zip(b, item, caps, strict=True)]
            if rule == "norm":
                key = lambda b: sum(w * (x - y) ** 2 for w, (x, y) in zip(weights, share(b), strict=True))
            else:
                key = lambda b: -sum(w * x * y for w, (x, y) in zip(weights, share(b), strict=True))
            b = min(fit, key=key) if fit else None
            if b is None:
                bins.append(b := list(caps))
            for i in range(3):
                b[i] -= item[i]
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("weights", [packing.WEIGHTS, (1.0, 1.0, 1.0)])
@pytest.mark.parametrize(("docs", "cost"), [(64, 4096), (4, 4096), (64, 1500), (3, 2000)])
def test_rules_against_one_piece_at_a_time(rule, weights, docs, cost):
    r = random.Random(3)
    for _ in range(8):
        counts = {n: r.randrange(1, 12) for n in r.sample(range(1, 38), 14)}
        bins = place(counts, packing.plan(counts, capacity=64, max_docs=docs, max_cost=cost, rule=rule, weights=weights).tolist())
        assert len(bins) <= brute_vector_fit(counts, (64, docs, cost), rule, weights) * 1.1 + 2
