import re

import pytest

import corpus_pipeline
from objloom.llm import queries
from tests.llm.test_decontamination import brute
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_secrets import base


@pytest.fixture(scope="module")
def stages(spark, tiny, tmp_path_factory):
    """Each stage's input and output on sf0.001."""
    docs, out = spark.read.parquet(f"{tiny}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        f(spark, docs, tiny).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def test_columns(stages, spark, tiny):
    want = spark.read.parquet(f"{tiny}/documents.parquet").columns
    assert all(made.columns == want for name, (_, made) in stages.items() if name != "packing")


def test_toxicity_keeps_what_is_not_rejected(stages, spark, tiny):
    docs, made = stages["toxicity"]
    rejected = {r.doc_id for r in queries.op7_toxicity(spark, tiny).where("predicted = 1").collect()}
    assert {r.doc_id for r in docs.collect()} - rejected == {r.doc_id for r in made.collect()}


def test_one_of_each_group_stays(stages):
    docs, made = stages["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    keep = {rows[v[0]][0] for v in classes([t for _, t in rows]).values()}
    assert sorted(r.doc_id for r in made.collect()) == sorted(keep)


def test_contaminated_documents_go(stages, spark, tiny):
    docs, made = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    want = {r.doc_id for r in docs.collect() if not brute(r.text, items)[2]}  # one item is enough
    assert {r.doc_id for r in made.collect()} == want


def test_secrets_are_gone(stages):
    docs, made = stages["secrets"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in made.collect():
        assert not base(r.text) and r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) == (not base(before[r.doc_id])) or re.search(r"\[SECRET\]", r.text)


def test_packing_has_every_document(stages):
    docs, made = stages["packing"]
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in made.collect()}


def test_run_is_the_stages(stages, spark, tiny):
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, tiny)) == key(stages["packing"][1])


def test_one_planted_passage_goes_and_clean_texts_stay(spark, tiny, tmp_path):
    item = next(t for t in (r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").sort("item_id").collect()) if len(t.split()) > 12)
    docs = spark.createDataFrame([(1, "some words first " + item + " and more"), (2, "a clean text of no item at all, with enough words"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, tiny).collect()) == [2, 3, 4]


NAMES = ["spans", "n_hit", "Score", "predicted", "_assign", "_n", "_hash", "set", "id", "hit_items", "a.b", "class_id", "text_hash"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, tiny, stage):
    """Nulls, empty texts, repeated rows and clashing names: values of the user's columns stay what they were."""
    texts = [None, "", "a text of its own with password=abcdef123", "another text that is not like it at all", "another text that is not like it at all", "word " * 3000]
    rows = [(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))
    f = dict(corpus_pipeline.STAGES)[stage]
    for d in (docs, docs.unionAll(docs)):
        made = f(spark, d, tiny)
        got = made.collect()
        assert made.columns == docs.columns and {r.doc_id for r in got} == ({0, 1, 2, 3, 5} if stage == "near_duplicates" else set(range(6)))
        assert all(tuple(r)[2:] == rows[r.doc_id][2:] for r in got)
        if stage == "near_duplicates":
            assert len(got) == 5
    assert f(spark, docs.where("false"), tiny).collect() == []
