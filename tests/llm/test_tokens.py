import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from objloom.llm import tokens
from tests.llm.helpers import EDGE_TEXTS, by_id, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tokens.Encoder(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def joined(text):
    if ENCODER.is_special(text):
        return ENCODER.whole(text)
    first, *rest = tokens.pre_tokens(text)
    return ENCODER.piece(first) + [i for u in rest for i in ENCODER.piece(" " + u)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r  \x1c\x85ab'sTé1½²,.<|endoftext|>"), st.characters(codec="utf-8")), max_size=60))
def test_pre_tokens_add_up(text):
    assert joined(text) == library(text)


def test_rank_encoder_is_the_library():
    r = random.Random(3)
    for _ in range(3000):
        word = "".join(chr(r.choice([r.randrange(0x20, 0x7F), r.randrange(0x20, 0x250)])) for _ in range(r.randrange(1, 14)))
        assert ENCODER.ranks(word) == library(word), word


def test_counts(spark):
    got = by_id(tokens.count_tokens(frame(spark, EDGE_TEXTS).selectExpr("*", "7 AS n_tokens", "'x' AS own"), PATH))
    for i, t in enumerate(EDGE_TEXTS):
        n = len(library(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert tokens.count_tokens(frame(spark, EDGE_TEXTS).where("false"), PATH).count() == 0


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = tokens.count_tokens(docs.select("doc_id", "text"), PATH, table_rows=500).collect()
    assert len(got) == len(text) and all(r.n_tokens == len(library(text[r.doc_id])) for r in got)


def test_cache_overflow():
    get = tokens.Lookup({"a": 1}, lambda s: len(s), rows=3)
    assert [get[x] for x in ("bb", "ccc", "dddd", "eeeee", "ffffff", "a", "bb")] == [3, 4, 5, 6, 7, 1, 3] and len(get) <= 4
