"""Operator 7: toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one on ordinary and
one on toxic windows.  A text is cut at spaces into windows of some ``WINDOW``
bytes that cover it whole, and each is compressed twice: with the ordinary
dictionary alone, and with the toxic one before it.  As the shared content lies
at the same distance in both, a window of clean text compresses to much the
same length; one that holds what toxic texts share is shorter under the second.
The difference of the lengths is what the window *saves*.

Toxic documents are mostly ordinary text, so a dictionary of their windows as
they are would be ordinary, too (held-out recall 0.25 on the check tool's larger
table).  Its training windows are therefore reduced to the stretches that
ordinary texts lack: those covered by byte sequences of a few fixed lengths
whose document frequency in toxic texts is ``lift`` times the ordinary one, by a
log-likelihood ratio of ``evidence`` or more.  They may lie inside words, span
words, or be of any script.  ``CHOICES`` lists the lengths, the evidence, the
lift and the dictionary's size; the one that calibrates best is taken.

Calibration: a logistic regression over six numbers of the saved bytes (how
many windows save at least 3 and 4, the rates of those that save 2 and 3, the
best window, the sum), got for each part of the sample with dictionaries
trained on the other parts (``PARTS``-fold).  The final dictionaries are trained
on the whole sample.  Parts and choices are fitted side by side on executors.

The sample has at most ``PER_CLASS`` labelled rows of each class and is bounded
in bytes, only of rows whose crc32(id as text) mod 3 is not 1 (see
``labelled_sample``); labels, lang, source and doc_id are never inputs of a
score.

Defined results: null and empty texts are scored as texts that save nothing;
without labelled rows of both classes every score is 0; repeated rows give
repeated rows; extra columns are kept, those named ``score`` or ``predicted`` as
``input_score`` and ``input_predicted``; equal texts have equal scores; an
empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objloom.llm.common import appended, labelled_sample, logistic, plainly, trained

PER_CLASS = 2_000
WINDOW = 72
BASE_BYTES = 65_536
PARTS = 3
#: Lengths of byte sequences (8 at most), least log-likelihood ratio, lift, bytes of the toxic dictionary.
CHOICES = (((5,), 25.0, 4.0, 8_192), ((5, 8), 16.0, 8.0, 16_384))
#: Saved bytes from which a window counts, for each of the counts that are calibrated.
SAVED = (2, 3, 4)
THRESHOLD = 0.7


def raw(text: str | None) -> bytes:
    return (" " + text.lower() + " ").encode() if text else b""


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """Cuts of about that size; each begins with the space where the last ended."""
    out, a, n = [], 0, len(data)
    while a < n:
        b = data.find(b" ", a + size, a + 4 * size + 1)
        if b < 0:
            b = min(n, a + 4 * size)
        out.append(data[a:b])
        a = b
    return out


class Pair:
    """Compressors with the ordinary dictionary, and with the toxic one before it."""

    def __init__(self, base: bytes, toxic: bytes) -> None:
        import zstandard as z

        self.coders = []
        for content in (base, toxic + base):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            params = z.ZstdCompressionParameters(compression_level=3, window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=4, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            self.coders.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def saved(self, text: str | None) -> np.ndarray:
        """The bytes that each window saves."""
        ordinary, toxic = self.coders
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(raw(text))], float)

    def features(self, text: str | None) -> np.ndarray:
        s = self.saved(text)
        if not len(s):
            return np.zeros(6)
        low, mid, high = (int((s >= k).sum()) for k in SAVED)
        # small savings happen by chance, so of those only the rate tells
        return np.array([np.log1p(mid), np.log1p(high), np.log1p(max(0.0, s.max() - SAVED[0])), 10 * low / len(s), 10 * mid / len(s), np.log1p(s[s >= SAVED[1]].sum())])


def grams(data: bytes, size: int) -> np.ndarray:
    """The byte sequences of a length of at most 8 at each position, as numbers."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(x) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(size if n > 0 else 0):
        out |= x[i : i + n] << np.uint64(8 * i)
    return out


def marking(toxic: list[bytes], ordinary: list[bytes], size: int, evidence: float, lift: float) -> np.ndarray:
    """Sorted sequences of that length that mark toxic texts, by the share of documents that have them."""

    def documents(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.unique(grams(t, size)) for t in texts]
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_counts=True)

    (known, a), (other, count) = documents(toxic), documents(ordinary)
    if not len(known):
        return known
    at = np.minimum(np.searchsorted(other, known), max(0, len(other) - 1))
    b = np.where(other[at] == known, count[at], 0) if len(other) else np.zeros(len(known))
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    share = (a + b) / (n + m)
    part = lambda k, total: k * np.log(np.maximum(k, 1) / total / share)
    return known[(2 * (part(a, n) + part(b, m)) >= evidence) & ((a + 0.5) / (n + 1) >= lift * (b + 0.5) / (m + 1))]


def stretches(window: bytes, marks: list[tuple[int, np.ndarray]]) -> bytes:
    """What is left of a window: the bytes that any of the marking sequences covers."""
    edge = np.zeros(len(window) + 1, np.int64)
    for size, known in marks:
        own = grams(window, size)
        if len(own) and len(known):
            found = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
            np.add.at(edge, found, 1)
            np.add.at(edge, found + size, -1)
    return np.frombuffer(window, np.uint8)[np.cumsum(edge)[:-1] > 0].tobytes()


def dictionaries(texts: list[str], y: list[int], choice: tuple) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of labelled texts."""
    sizes, evidence, lift, limit = choice
    toxic, ordinary = ([raw(t) for t, c in zip(texts, y, strict=True) if c == label] for label in (1, 0))
    marks = [(k, marking(toxic, ordinary, k, evidence, lift)) for k in sizes]
    left = [s for t in toxic for w in windows(t) if (s := stretches(w, marks))]
    return trained([w for t in ordinary for w in windows(t, 1024)], BASE_BYTES), trained(left, limit) if left else b""


def _part(texts: list[str], y: list[int], choice: tuple, part: int):
    """Features of the rows of a part with dictionaries trained on the others; for part -1 the dictionaries of all rows."""
    if part < 0:
        return dictionaries(texts, y, choice)
    fit = [i for i in range(len(y)) if i % PARTS != part]
    pair = Pair(*dictionaries([texts[i] for i in fit], [y[i] for i in fit], choice))
    return [(i, pair.features(texts[i])) for i in range(part, len(y), PARTS)]


def train(texts: list[str], y: list[int], each=None) -> dict | None:
    """Dictionaries and weights.  each(jobs) gives ``_part(texts, y, *job)`` of every job; here by default."""
    if len(set(y)) < 2:
        return None
    order = sorted(range(len(y)), key=lambda i: y[i])  # so that parts have both classes alike
    texts, y = [texts[i] for i in order], [y[i] for i in order]
    jobs = [(choice, part) for choice in CHOICES for part in range(-1, PARTS)]
    done = each(texts, y, jobs) if each else [_part(texts, y, *job) for job in jobs]
    target, best = np.array(y, float), None
    for n in range(0, len(jobs), PARTS + 1):
        x = np.array([f for _, f in sorted((r for got in done[n + 1 : n + 1 + PARTS] for r in got), key=lambda r: r[0])])
        w = logistic(x, target)
        z = x @ w[:-1] + w[-1]
        loss = sum(np.logaddexp(0, np.where(c, -z, z)[target == c]).mean() for c in (0, 1))
        if best is None or loss < best[0]:
            best = loss, {"base": done[n][0], "toxic": done[n][1], "weights": w}
    return best[1]


def _on_executors(spark: SparkSession):
    """Jobs of ``train`` as rows, a task for each."""

    def each(texts: list[str], y: list[int], jobs: list[tuple]) -> list:
        sample = spark.sparkContext.broadcast((texts, y))

        def run(batches):
            for b in batches:
                for k in b.column("id").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(_part(*sample.value, *jobs[k]))], pa.binary())], names=["id", "made"])

        rows = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "id long, made binary").toArrow().sort_by("id")
        sample.unpersist()
        return [pickle.loads(x) for x in rows["made"].to_pylist()]

    return each


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS):
    spark = docs.sparkSession
    return spark.sparkContext.broadcast(train(*labelled_sample(docs, labels, label_col, per_class, id_col, text_col), _on_executors(spark)))


def scorer(model: dict | None):
    """A function from a text to its score."""
    if model is None:
        return lambda text: 0.0
    pair, w = Pair(model["base"], model["toxic"]), model["weights"]
    return lambda text: float(1 / (1 + np.exp(-np.clip(pair.features(text) @ w[:-1] + w[-1], -35, 35))))


def score(docs: DataFrame, model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 where score >= threshold)."""

    def make(text):
        of = scorer(model.value)

        def work(batch: pa.RecordBatch) -> list:
            s = np.array([of(t) for t in batch.column(text).to_pylist()], float)
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return work

    return appended(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, text_col)


def accepted(docs: DataFrame, model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with the columns of docs alone."""
    docs[f"`{text_col}`"]
    return plainly(docs, lambda d, names: score(d, model, text_col=names[text_col], threshold=threshold).where(F.col("predicted") == 0))
