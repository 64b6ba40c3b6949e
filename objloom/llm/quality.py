"""Operator 9: text quality by a compression classifier.

One zstandard dictionary is trained on texts labelled good, one on texts
labelled bad.  A text is compressed with each, in stretches of ``STRETCH``
bytes (the whole text, so the dictionaries matter in long texts too).  The
difference of the compressed sizes over the greater of them, the normalised
size difference, is the only input of the score: a logistic regression over it
and its signed square, on the half of the sample that the dictionaries haven't
seen, calibrates it.

The sample has at most ``PER_CLASS`` labelled rows of each class and is bounded
in bytes, only of rows whose crc32(id as text) mod 3 is not 1 (see
``labelled_sample``); labels, lang, source and doc_id are never inputs of a
score.

Defined results: null and empty texts are scored as texts of no size; without
labelled rows of both classes every score is 0.5; repeated rows give repeated
rows; extra columns are kept, those named ``score`` or ``predicted`` as
``input_score`` and ``input_predicted``; equal texts have equal scores; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from objloom.llm.common import appended, labelled_sample, logistic, trained, utf8

PER_CLASS = 2_000
STRETCH = 4_096
DICT_BYTES = 65_536
THRESHOLD = 0.5


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary trained on the texts' stretches."""
    return trained([t[a : a + STRETCH] for t in texts for a in range(0, len(t), STRETCH)], size, level=3)


class Pair:
    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard as z

        self.pair = []
        for content in (good, bad):
            d = z.ZstdCompressionDict(content)
            d.precompute_compress(level=3)
            self.pair.append(z.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def features(self, text: bytes) -> np.ndarray:
        good, bad = self.pair
        parts = [text[a : a + STRETCH] for a in range(0, len(text), STRETCH)]
        g, b = sum(len(good(x)) for x in parts), sum(len(bad(x)) for x in parts)
        d = (b - g) / max(g, b, 1)
        return np.array([d * 10, d * abs(d) * 20])


def train(texts: list[str], y: list[int]) -> dict | None:
    if len(set(y)) < 2:
        return None
    raw = [t.encode() for t in texts]
    part = [[i for i in range(len(y)) if y[i] == c] for c in (0, 1)]
    fit = [i for p in part for i in p[::2]]
    rest = [i for p in part for i in p[1::2]] or fit
    good, bad = (dictionary([raw[i] for i in fit if y[i] == c]) for c in (1, 0))
    pair = Pair(good, bad)
    target = np.array([y[i] for i in rest], float)
    if len(set(target)) < 2:
        return None
    return {"good": good, "bad": bad, "weights": logistic(np.array([pair.features(raw[i]) for i in rest]), target)}


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS):
    return docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, label_col, per_class, id_col, text_col)))


def scorer(model: dict | None):
    if model is None:
        return lambda text: 0.5
    pair, w = Pair(model["good"], model["bad"]), model["weights"]
    return lambda text: float(1 / (1 + np.exp(-np.clip(pair.features(text) @ w[:-1] + w[-1], -35, 35))))


def score(docs: DataFrame, model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 where score >= threshold)."""

    def make(text):
        of = scorer(model.value)

        def work(batch: pa.RecordBatch) -> list:
            s = np.array([of(t) for t in utf8(batch.column(text))], float)
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return work

    return appended(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, text_col)
