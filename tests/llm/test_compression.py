"""Toxicity and quality."""

import random
import zlib

import pytest

from objloom.llm import quality, toxicity
from objloom.llm.common import labelled_sample
from tests.llm.helpers import EDGE_TEXTS, by_id, frame


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def made(n, seed=0):
    """Texts with a few marked words in one class, among words that both have."""
    r = random.Random(seed)
    vocab = ["".join(r.choice(["ta", "ri", "no", "se", "mo", "lu"]) for _ in range(r.randrange(1, 4))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(40, 160))]
        y = i % 4 == 0
        if y:
            for _ in range(r.randrange(3, 9)):
                w[r.randrange(len(w))] = r.choice(["grobble", "wexford", "quazzick", "plimfty"])
        texts.append(" ".join(w))
        labels.append(int(y))
    return texts, labels


def test_toxicity_finds_marked_texts_and_leaves_clean_ones(spark):
    texts, y = made(1200)
    docs = frame(spark, texts)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = by_id(toxicity.score(docs.selectExpr("*", "3 AS score", "'a' AS Predicted"), model))
    out = [i for i in got if held(i)]
    assert sum(got[i].predicted for i in out if y[i]) / sum(y[i] for i in out) > 0.95
    assert sum(got[i].predicted for i in out if not y[i]) / sum(1 - y[i] for i in out) < 0.02


@pytest.mark.parametrize(("module", "label", "threshold"), [(toxicity, "toxic", 0.7), (quality, "quality", 0.5)])
def test_driver_table(spark, small, module, label, threshold):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    got = by_id(module.score(docs.select("doc_id", "text"), model))
    truth = {r.doc_id: r[label] for r in labels.collect() if held(r.doc_id)}
    assert sum(got[i].predicted == y for i, y in truth.items()) / len(truth) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got.values())
    edge = by_id(module.score(frame(spark, EDGE_TEXTS), model))
    assert len(edge) == len(EDGE_TEXTS) and edge[0].score == edge[1].score
    same = [i for i, t in enumerate(EDGE_TEXTS) if t == "same text here for all of us"]
    assert edge[same[0]].score == edge[same[1]].score
    assert module.score(docs.where("false"), model).count() == 0


@pytest.mark.parametrize(("module", "label", "none"), [(toxicity, "toxic", 0.0), (quality, "quality", 0.5)])
def test_without_labels(spark, module, label, none):
    docs = frame(spark, ["a b c", None])
    for labels in ([], [(0, 1)]):
        model = module.fit(docs, spark.createDataFrame(labels, f"doc_id long, {label} int"))
        assert {r.score for r in module.score(docs, model).collect()} == {none}


def test_sample_is_bounded_and_never_held_out(spark):
    docs = frame(spark, [f"text {i}" for i in range(400)])
    rows = [(i, i % 2) for i in range(400)] + [(0, 1), (2, None)] + [(i, i % 2) for i in range(50)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    texts, y = labelled_sample(docs, labels, "toxic", 30)
    ids = [int(t.split()[1]) for t in texts]
    assert len(ids) == len(set(ids)) == 60 and sum(y) == 30 and not any(map(held, ids)) and 0 not in ids
    assert all(i % 2 == c for i, c in zip(ids, y, strict=True))


def test_windows_cover_the_whole_text():
    r = random.Random(1)
    for _ in range(200):
        data = bytes(r.choice(b"ab c") for _ in range(r.randrange(900))) + b"x" * r.choice([0, 0, 700])
        assert b"".join(toxicity.windows(data, 50)) == data


def test_toxicity_finds_phrases_of_ordinary_words():
    """Toxic texts whose every word is as frequent in ordinary ones; only the order tells."""
    r = random.Random(7)
    vocab = ["".join(r.choice(["ta", "ri", "no", "se", "mo", "lu"]) for _ in range(r.randrange(1, 4))) for _ in range(400)]
    phrases = [" ".join(r.choice(vocab) for _ in range(12)) for _ in range(4)]
    texts, y = [], []
    for i in range(1200):
        w = [r.choice(vocab) for _ in range(r.randrange(40, 160))]
        y.append(int(i % 4 == 0))
        for _ in range(5 * y[-1]):
            w.insert(r.randrange(len(w)), r.choice(phrases))
        texts.append(" ".join(w))
    of = toxicity.scorer(toxicity.train(texts[:800], y[:800]))
    got = [of(t) >= toxicity.THRESHOLD for t in texts[800:]]
    assert sum(g for g, c in zip(got, y[800:], strict=True) if c) > 90
    assert sum(g for g, c in zip(got, y[800:], strict=True) if not c) < 15


def plain_windows(data, size):
    """Windows by walking byte by byte: each ends before the first space at or after its size, at most four sizes on."""
    out, a = [], 0
    while a < len(data):
        b = a + size
        while b <= a + 4 * size and b < len(data) and data[b] != 0x20:
            b += 1
        b = min(b, a + 4 * size, len(data))
        out.append(data[a:b])
        a = b
    return out


def test_toxicity_scores_are_those_of_plain_compression(spark):
    """Every score anew: each window compressed by two fresh compressors, features and logistic by hand."""
    import math

    import zstandard as z

    texts, y = made(500, 3)
    texts += ["", None, "x" * 3000, "ÀÉ grobble wexford " * 90, " lead", "trail "]
    model = toxicity.train(texts[:400], y[:400])
    params = z.ZstdCompressionParameters(compression_level=3, window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=4, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(content, w):
        return len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress(w))

    def plain(t):
        if not t:
            f = [0.0] * 6
        else:
            s = [length(model["base"], w) - length(model["toxic"] + model["base"], w) for w in plain_windows((" " + t.lower() + " ").encode(), toxicity.WINDOW)]
            at = lambda k: sum(x >= k for x in s)
            f = [math.log1p(at(3)), math.log1p(at(4)), math.log1p(max(0, max(s) - 2)), 10 * at(2) / len(s), 10 * at(3) / len(s), math.log1p(sum(x for x in s if x >= 3))]
        v = sum(a * b for a, b in zip(f, model["weights"], strict=False)) + model["weights"][-1]
        return 1 / (1 + math.exp(-max(-35, min(35, v))))

    docs = frame(spark, texts[390:])
    got = by_id(toxicity.score(docs, spark.sparkContext.broadcast(model)))
    for i, t in enumerate(texts[390:]):
        assert got[i].score == pytest.approx(plain(t), abs=1e-9), t
    assert b"grobble" in model["toxic"]


def test_quality_scores_are_those_of_plain_compression(spark):
    import math

    import zstandard as z

    r = random.Random(4)
    good = [" ".join(r.choice(["the", "river", "was", "calm", "and", "we", "walked", "home"]) for _ in range(60)) for _ in range(150)]
    bad = ["".join(r.choice("!!$$ CLICK buy NOW 99 ") for _ in range(200)) for _ in range(150)]
    texts, y = good + bad, [1] * 150 + [0] * 150
    model = quality.train(texts, y)
    probe = ["", None, good[3], bad[3], good[5] + bad[7], "word " * 4000, "é" * 5000]

    def size(content, data):
        return sum(len(z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[a : a + 4096])) for a in range(0, len(data), 4096))

    def plain(t):
        data = (t or "").encode()
        g, b = size(model["good"], data), size(model["bad"], data)
        d = (b - g) / max(g, b, 1)
        v = 10 * d * model["weights"][0] + 20 * d * abs(d) * model["weights"][1] + model["weights"][2]
        return 1 / (1 + math.exp(-max(-35, min(35, v))))

    got = by_id(quality.score(frame(spark, probe), spark.sparkContext.broadcast(model)))
    for i, t in enumerate(probe):
        assert got[i].score == pytest.approx(plain(t), abs=1e-6), t
    assert got[2].score > 0.9 > 0.1 > got[3].score


def test_sample_is_bounded_in_bytes(spark):
    docs = frame(spark, ["x" * 1000] * 50 + ["y" * 70_000] * 50 + ["z" * 100] * 100)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    texts, y = labelled_sample(docs, labels, "toxic", 1000, class_bytes=5000)
    assert all(sum(len(t) for t, c in zip(texts, y, strict=True) if c == k) <= 5000 for k in (0, 1)) and max(map(len, texts)) <= 1000 and len(texts) > 10


def test_clashing_columns_are_kept(spark):
    docs = frame(spark, ["some text", None]).selectExpr("*", "7 AS score", "'p' AS Predicted", "'q' AS `a.b`", "1 AS input_score")
    made_ = toxicity.score(docs, spark.sparkContext.broadcast(None))
    row = made_.collect()[0]
    assert row["input_input_score"] == 7 and row["input_Predicted"] == "p" and row["a.b"] == "q" and row["input_score"] == 1 and row["score"] == 0.0
