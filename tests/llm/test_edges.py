"""Every operator on rows without ids, repeated rows, empty tables and columns whose names clash."""

import public_tokenizers
import pytest

from objloom.llm import decontamination, jaccard, language, licenses, media, packing, quality, secrets, tokens, toxicity
from tests.llm.helpers import EDGE_TEXTS

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def operators(spark):
    items = spark.createDataFrame([(1, "some words of an item that nobody has in any text")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, toxic int, quality int")
    known = spark.createDataFrame([(i, f"{'good words here' if i % 2 else 'bad!! TEXT!!'} {i} " * 9, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    lang, tox, good = language.fit(known, PIECES), toxicity.fit(known, labels), quality.fit(known, labels)
    return {
        "secrets": secrets.find_secrets, "tokens": lambda d: tokens.count_tokens(d, BPE), "jaccard": jaccard.join, "language": lambda d: language.identify(d, lang),
        "media": media.store_media, "toxicity": lambda d: toxicity.score(d, tox), "decontamination": lambda d: decontamination.contamination(d, items),
        "quality": lambda d: quality.score(d, good), "licenses": licenses.recognise, "packing": lambda d: packing.pack(d, BPE),
    }


CLASHES = ["score", "predicted", "spans", "n_tokens", "n_words", "media", "digests", "class_id", "set", "length", "piece", "lang_pred", "licenses", "hash", "prefix"]


@pytest.mark.parametrize("name", ["secrets", "tokens", "jaccard", "language", "media", "toxicity", "decontamination", "quality", "licenses", "packing"])
def test_edges(spark, name):
    f = operators(spark)[name]
    rows = [(i if i % 4 else None, t) for i, t in enumerate(EDGE_TEXTS)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").selectExpr("*", *[f"'x' AS {c}" for c in CLASHES], "named_struct('a', 1) AS nested", "array(1) AS list")
    got = f(docs).collect()
    if name == "packing":
        got = [r for r in got if r.piece == 0]
    assert len(got) == len(rows) + 5 and sum(r.doc_id is None for r in got) == sum(i is None for i, _ in rows + rows[:5])
    assert f(docs.where("false")).collect() == []
