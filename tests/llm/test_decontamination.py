import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from objloom.llm import decontamination as D
from tests.llm.helpers import EDGE_TEXTS, by_id, frame, words


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t or "")
        for i in range(max(1, len(v) - 7)) if v else ():
            win = v[i : i + 8]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add(str(name))
    ids = sorted(found)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2


def run(spark, texts, items, **more):
    docs = frame(spark, texts).selectExpr("*", "9 AS n_hit", "'q' AS Contaminated")
    got = by_id(D.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), **more))
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for _, r in sorted(got.items())]


def corpus(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "c", "ab", "bc", "é", "word", "thing", "x1"]
    say = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.randrange(0, 14))) for i in range(12)] + [(12, None), (13, ""), (3, "a second text of item three with enough words in it")]
    texts = [*EDGE_TEXTS]
    for _ in range(60):
        t = say(r.randrange(30))
        for _ in range(r.randrange(3)):
            t += " " + (r.choice(items)[1] or "").upper() + " " + say(3)
        texts.append(t)
    return texts, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts, items = corpus(seed)
        want = [brute(t, items) for t in texts]
        assert run(spark, texts, items) == want
        assert run(spark, texts, items, block_bytes=150) == want  # several blocks
        assert run(spark, texts, items, block_bytes=150, pass_bytes=400) == want  # and passes
        assert any(x[2] > 1 for x in want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc ", min_size=1, max_size=12), min_size=1, max_size=8), st.text("abc ", max_size=200))
def test_wu_manber_finds_every_occurrence(patterns, text):
    patterns = [p.encode() for p in dict.fromkeys(patterns)]
    data = text.encode()
    got = sorted(D.Class(patterns).search(data))
    assert got == sorted((i, p) for p in patterns for i in range(len(data)) if data.startswith(p, i))


def test_empty_tables(spark):
    assert run(spark, ["a b"], []) == [brute("a b", [])]
    assert D.contamination(frame(spark, ["a"]).where("false"), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_items_without_an_id_are_one_without_a_name(spark):
    items = [(None, "alpha beta gamma"), (None, "delta epsilon"), (7, "zeta eta")]
    got = run(spark, ["alpha beta gamma delta epsilon", "zeta eta alpha beta gamma", "none"], items)
    assert [(w, h, n, c) for w, h, n, _, c in got] == [(5, 5, 1, False), (5, 5, 2, True), (1, 0, 0, False)]
    assert got[1][3] == hashlib.sha256(b"7").hexdigest() and got[0][3] == hashlib.sha256(b"").hexdigest()


def test_clean_keeps_columns_of_any_name(spark):
    docs = frame(spark, ["alpha beta gamma here", "nothing"]).selectExpr("*", "1 AS _spans", "2 AS hit_items", "3 AS `x.y`")
    got = D.clean(docs, spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    assert got.columns == docs.columns and [tuple(r)[-3:] for r in got.collect()] == [(1, 2, 3)]
    rows = D.contamination(docs, spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), pass_bytes=1, block_bytes=1).collect()
    assert [(r["input__spans"], r["input_hit_items"], r["x.y"]) for r in rows] == [(1, 2, 3)] * 2
