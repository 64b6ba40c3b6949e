import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from objloom.llm import language
from tests.llm.helpers import EDGE_TEXTS, by_id, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces or k == 1:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k], *rest]


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "▁ab", "a", "b", "c", "ab", "bc", "abc", "ca"]
    rng = np.random.default_rng(1)
    p = np.zeros((len(pieces) + 1, 2))
    p[1:] = rng.random((len(pieces), 2)) / 10
    floor = np.array([1e-4, 2e-4])
    words = ["abcabc", "b", "xab", "cccc", "a", "abx"]
    got = language.Lattice(words, language.PieceTable(pieces)).forward(p, floor)
    for i, w in enumerate(words):
        for lang in range(2):
            total = sum(math.prod(p[pieces.index(s) + 1, lang] if s in pieces else floor[lang] for s in seg) for seg in segmentations("▁" + w, pieces))
            assert got[i, lang] == pytest.approx(math.log(total))


def test_expected_counts_are_those_of_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba"]
    rng = np.random.default_rng(2)
    p = np.r_[0, rng.random(len(pieces))][:, None]
    floor = np.array([1e-3])
    words, weight = ["abab", "ba", "axb"], np.array([3.0, 1.0, 2.0])
    got = language.Lattice(words, language.PieceTable(pieces)).expected(p, floor, weight)
    want = np.zeros(len(p))
    for w, n in zip(words, weight, strict=True):
        segs = [(seg, math.prod(p[pieces.index(s) + 1, 0] if s in pieces else floor[0] for s in seg)) for seg in segmentations("▁" + w, pieces)]
        total = sum(q for _, q in segs)
        for seg, q in segs:
            for s in seg:
                if s in pieces:
                    want[pieces.index(s) + 1] += n * q / total
    assert got == pytest.approx(want)


def test_piece_table_finds_every_piece():
    pieces = language.vocabulary(PATH)
    table = language.PieceTable(pieces)
    h = np.array([table._hash(p) for p in pieces], np.uint64)
    assert (table.find(h) == np.arange(1, len(pieces) + 1)).all() and table.find(h ^ np.uint64(0x5555555555555555)).max() == 0


def test_held_out_accuracy_and_edges(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.fit(docs, PATH)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = by_id(language.identify(docs.select("doc_id", "text"), model))
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in got.values())
    edge = by_id(language.identify(frame(spark, EDGE_TEXTS).selectExpr("*", "'x' AS lang_pred", "2 AS Score"), model))
    for i, t in enumerate(EDGE_TEXTS):
        assert (edge[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
    assert language.identify(docs.where("false"), model).count() == 0


def test_no_training_rows(spark):
    docs = frame(spark, ["abc", None]).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    got = language.identify(docs, language.fit(docs, PATH)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2


def test_cache_can_be_forgotten():
    model = (["a", "b"], ["▁", "x", "y"], np.array([[0, 0], [0.1, 0.1], [0.8, 0.1], [0.1, 0.8]], np.float32), np.array([1e-6, 1e-6]))
    s = language.Scorer(model)
    first = s.score(["xx xy", "yy", None, "12"])
    language.CACHE_BYTES, kept = 1, language.CACHE_BYTES
    try:
        assert s.score(["xx xy"])[1][0] == first[1][0] and s.score(["yy"])[0] == ["b"]
    finally:
        language.CACHE_BYTES = kept
    assert first[0] == ["a", "b", "und", "und"]


def test_words_of_any_length_are_scored_whole():
    """Long words, by exact fractions over all segmentations; expected counts sum as they must."""
    from fractions import Fraction

    pieces = ["▁", "▁a", "a", "b", "ab", "babab", "ababababababab"]
    rng = np.random.default_rng(3)
    p = np.r_[0, rng.random(len(pieces)) / 50][:, None] * [1.0, 0.7]
    floor = np.array([1e-7, 1e-7])
    words = ["ab" * 400, "z" * 300, "abz" * 90, "a", "zab"]
    lattice = language.Lattice(words, language.PieceTable(pieces))
    got = lattice.forward(p, floor)
    for i, w in enumerate(words):
        marked = "▁" + w
        for lang in range(2):
            total = [Fraction(1)]
            for j in range(1, len(marked) + 1):
                part = Fraction(0)
                for k in range(1, min(j, 14) + 1):
                    s = marked[j - k : j]
                    q = p[pieces.index(s) + 1, lang] if s in pieces else floor[lang] if k == 1 else 0.0
                    part += total[j - k] * Fraction(q)
                total.append(part.limit_denominator(10**3000) if part.denominator > 10**4000 else part)
            want = math.log(total[-1].numerator) - math.log(total[-1].denominator)
            assert got[i, lang] == pytest.approx(want, rel=1e-9)
    counts = lattice.expected(p[:, :1], floor[:1], np.ones(len(words)))
    letters = sum(len(x) * n for x, n in zip(pieces, counts[1:], strict=True))
    assert letters == pytest.approx(sum(1 + len(w) for w in words) - sum(w.count("z") for w in words), rel=1e-6)


def test_prediction_against_plain_sums():
    """Whole texts: the product over words of the sums over segmentations, posterior under equal priors."""
    pieces = ["▁", "▁a", "a", "b", "c", "ab", "bc", "▁c"]
    rng = np.random.default_rng(4)
    p = np.zeros((len(pieces) + 1, 3))
    p[1:] = rng.random((len(pieces), 3)) / 10
    floor = np.full(3, 1e-4)
    s = language.Scorer((["x", "y", "z"], pieces, p.astype(np.float32), floor))
    texts = ["Abc cab, a!", "bc2bc cc", "AB ab aB", "12", None, "xyz abc"]
    p = p.astype(np.float32).astype(float)
    for text, lang, score in zip(texts, *s.score(texts), strict=True):
        words = [w for t in (text or "").lower().split() for w in language.letter_words(t)]
        if not words:
            assert (lang, score) == ("und", 0.0)
            continue
        total = np.array([math.prod(sum(math.prod(p[pieces.index(x) + 1, k] if x in pieces else floor[k] for x in seg) for seg in segmentations("▁" + w, pieces)) for w in words) for k in range(3)])
        assert lang == "xyz"[total.argmax()] and score == pytest.approx(total.max() / total.sum(), rel=1e-4)


def test_many_languages_and_long_texts_stay_small():
    """200 languages: batches are cut so that the forward sums stay within BATCH_CELLS."""
    words = ["ab" * 2000, *("w%d" % i for i in range(3000))]
    parts = language.batches_of(words, 200)
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(words)))
    assert all(len(x) == 1 or len(x) * max(len(words[i]) + 2 for i in x) * 200 <= language.BATCH_CELLS for x in parts)
