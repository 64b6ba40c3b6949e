"""Operator 4: language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (a ``sentencepiece`` model
file): a word is its letters, lower-cased, after the word mark.  Each language
has a probability for every piece.  The probability of a word is the sum over
*all* its segmentations into pieces of the product of their probabilities, got
by the forward algorithm; a text's is the product over its words.  The language
of the greatest posterior under equal priors is predicted, and the score is
that posterior.

Probabilities are fitted by expectation-maximisation (forward-backward over
the words' counts) on a bounded sample: at most ``FIT_DOCS`` training rows of
each language, those with the least hash of their id, of at most ``TEXT_BYTES``
bytes each.  Every word of the sample counts.  Words are counted on the
executors, and each language is fitted in a task of its own.  lang, source and
doc_id are never inputs of a prediction.

Forward sums run over many words at once in NumPy: a rolling hash finds the
piece that each substring is, of any length that the vocabulary has, and the
pieces that end at a character are summed together.  Sums are rescaled as they
shrink, so words of any length are scored whole.  Batches of words are cut so
that their sums take some ``BATCH_CELLS`` numbers, whatever the number of
languages and the length of words.  Vectors of words already seen are kept in a
cache of at most ``CACHE_BYTES`` in each Python worker.

Defined results: ``und`` and score 0 for null and texts without a letter; ties
go to the first language in text order; without training rows everything is
``und``; repeated rows give repeated rows; extra columns are kept, those named
``lang_pred`` or ``score`` as ``input_lang_pred`` and ``input_score``; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from objloom.llm.common import TEXT_BYTES, appended, column, held_out, least_hashed

FIT_DOCS = 1_500
ROUNDS = 3
#: Numbers in a batch's forward sums: (longest word + 1) x words x languages.
BATCH_CELLS = 8_000_000
CACHE_BYTES = 64 << 20
#: Probability of a single character that is no piece.
FLOOR = 1e-7
UND = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
_MARK = "▁"


def letter_words(token: str) -> list[str]:
    """Runs of letters of a lower-cased token."""
    return ["".join(c for c in w if c.isalpha()) if not w.isalpha() else w for w in _LETTERS.findall(token)]


def vocabulary(path: str) -> list[str]:
    """Pieces made of letters, with or without the word mark before them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    ok = lambda p: p and ((p[1:] if p[0] == _MARK else p).isalpha() or p == _MARK)
    return sorted(p for p in pieces if ok(p))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 19


class PieceTable:
    """Open hash table from rolling hashes of substrings to the vocabulary's trie: ``nodes`` gives 0 for what begins no piece, ``piece`` the piece that a node is."""

    def __init__(self, pieces: list[str]) -> None:
        number = {p: i + 1 for i, p in enumerate(pieces)}
        known = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        hashes = np.array([self._hash(p) for p in known], np.uint64)
        self.longest = max(map(len, pieces), default=1)
        self.piece = np.array([0, *(number.get(p, 0) for p in known)], np.int64)
        self.levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        left = np.arange(len(known))
        mult = _BASE
        while len(left):
            slot = ((hashes[left] * mult) >> np.uint64(64 - _BITS)).astype(np.int64)
            keys, ids = np.zeros(1 << _BITS, np.uint64), np.zeros(1 << _BITS, np.int32)
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], ids[slot[first]] = hashes[left[first]], left[first] + 1
            self.levels.append((mult, keys, ids))
            left = np.delete(left, first)
            mult = np.uint64(int(mult) * 0xD6E8FEB86659FD93 % 2**64 | 1)

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; 0 is 'no piece'."""
        return self.piece[self.nodes(h)]

    def nodes(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        for mult, keys, ids in self.levels:
            slot = ((h * mult) >> np.uint64(64 - _BITS)).astype(np.int64)
            out = np.where(keys[slot] == h, ids[slot], out)
        return out


_TINY, _UP = 1e-100, 1e100


class Lattice:
    """All pieces in a list of words.

    An *edge* is a piece at its place, or any single character; edges are in
    the order of the character at which they end, so the sums at a character
    are one grouped addition.  ``_end[j]:_end[j + 1]`` are those that end at j.
    """

    def __init__(self, words: list[str], table: PieceTable) -> None:
        marked = [_MARK + w for w in words]
        size = np.array([len(w) for w in marked], np.int64)
        self.order = np.argsort(-size, kind="stable")
        chars = np.frombuffer("".join(marked[i] for i in self.order).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.size = size[self.order]
        self.longest = int(self.size[0]) if len(words) else 0
        start = np.concatenate([[0], np.cumsum(self.size)[:-1]]) if len(words) else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(words)), self.size)
        at = np.arange(len(chars)) - start[word]
        found = []
        # places from which the trie still goes on, with the hash of what has been read there
        open_, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for k in range(table.longest):
            inside = at[open_] + k < self.size[word[open_]]
            open_, h = open_[inside], h[inside]
            if not len(open_):
                break
            h = h * _BASE + chars[open_ + k]
            node = table.nodes(h)
            piece = table.piece[node]
            keep = np.flatnonzero(piece) if k else np.arange(len(open_))
            place = open_[keep]
            found.append(np.stack([word[place], at[place], at[place] + k + 1, piece[keep]]))
            open_, h = open_[node > 0], h[node > 0]
        edges = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
        edges = edges[:, np.lexsort((edges[0], edges[2]))]
        self.word, self.begin, self.stop, self.piece = edges
        self._end = np.searchsorted(self.stop, np.arange(self.longest + 2))

    def forward(self, p: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """log of the sum over segmentations, a row for each word in the given order; p: (pieces + 1) x languages, floor for any single character."""
        n, langs = len(self.size), p.shape[1]
        alpha = np.zeros((self.longest + 1, n, langs))
        alpha[0] = 1.0
        self.scale = np.zeros(alpha.shape) if self.longest > 16 else None  # log of what each sum was multiplied by
        for j in range(1, self.longest + 1):
            lo, hi = self._end[j], self._end[j + 1]
            w, i, piece = self.word[lo:hi], self.begin[lo:hi], self.piece[lo:hi]
            part = alpha[i, w] * np.where(piece[:, None] > 0, p[piece], floor)
            if self.scale is not None:
                part *= np.exp(self.scale[j - 1, w] - self.scale[i, w])
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            rows = w[first]
            got = np.add.reduceat(part, first, axis=0)
            if self.scale is not None:
                own = self.scale[j - 1, rows]
                small = got < _TINY
                got = np.where(small, got * _UP, got)
                self.scale[j, rows] = own + np.where(small, np.log(_UP), 0.0)
            alpha[j, rows] = got
        self.alpha = alpha
        out = np.empty((n, langs))
        self.last = self.size, np.arange(n)
        total = np.log(np.maximum(alpha[self.last], 1e-300))
        out[self.order] = total if self.scale is None else total - self.scale[self.last]
        return out

    def expected(self, p: np.ndarray, floor: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of pieces in one language's words, each counted weight times.

        Backward sums are divided by the word's whole sum and held at the
        inverse of the forward scale, so the product of both at an edge is its
        share of the segmentations.
        """
        self.forward(p, floor)
        n, a = len(self.size), self.alpha[:, :, 0]
        scale = None if self.scale is None else self.scale[:, :, 0]
        beta = np.zeros((self.longest + 1, n))
        beta[self.last] = 1.0 / np.maximum(a[self.last], 1e-300)
        counts = np.zeros(len(p))
        own = weight[self.order]
        q = np.where(self.piece > 0, p[self.piece, 0], floor[0])
        for j in range(self.longest, 0, -1):
            lo, hi = self._end[j], self._end[j + 1]
            w, i, piece = self.word[lo:hi], self.begin[lo:hi], self.piece[lo:hi]
            back = q[lo:hi] * beta[j, w]
            if scale is not None:
                back = back * np.exp(scale[j, w] - scale[i, w])
            np.add.at(beta, (i, w), back)
            counts += np.bincount(piece, a[i, w] * back * own[w], len(p))
        counts[0] = 0
        return counts


def batches_of(words: list[str], langs: int) -> list[np.ndarray]:
    """Numbers of words, the longest first, in batches whose sums take some BATCH_CELLS numbers."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    order, out, a = np.argsort(-size, kind="stable"), [], 0
    while a < len(order):
        n = max(1, BATCH_CELLS // int(size[order[a]] * max(1, langs)))
        out.append(order[a : a + n])
        a += n
    return out


def train_language(counts: dict[str, int], pieces: list[str], table: PieceTable, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of (none and) each piece from one language's word counts."""
    words = sorted(counts)
    size = np.array([1, *map(len, pieces)])
    floor = np.full(1, FLOOR)
    parts = [(Lattice([words[i] for i in part], table), np.array([counts[words[i]] for i in part], float)) for part in batches_of(words, 1)]
    p = sum(np.bincount(x.piece, minlength=len(size)) for x, _ in parts) + 0.1
    p = p / size
    p[0] = 0
    p = p[:, None] / p.sum()
    for _ in range(rounds):
        got = sum(x.expected(p, floor, weight) for x, weight in parts) + 0.01
        got[0] = 0
        p = got[:, None] / got.sum()
    return p[:, 0]


def train(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, piece probabilities (pieces + 1) x languages, and the floor of an unknown character, from word counts by language."""
    langs, table = sorted(k for k in counts if counts[k]), PieceTable(pieces)
    out = [train_language(counts[k], pieces, table, rounds) for k in langs]
    return langs, np.stack(out, 1) if out else np.zeros((len(pieces) + 1, 0)), np.full(len(langs), FLOOR)


def fit(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_DOCS):
    """Fit on rows whose crc32(id as text) mod 4 is not 2."""
    spark = docs.sparkSession
    own = docs.select(column(id_col).alias("_id"), column(lang_col).cast("string").alias("_lang"), column(text_col).alias("_text"))
    own = own.where("_lang IS NOT NULL AND _id IS NOT NULL AND _text IS NOT NULL").where(~held_out("_id", 4, 2)).where(F.octet_length("_text") <= TEXT_BYTES)
    # of all texts only those that pass by their hash move, one for each id; about 2 * per_language of a language meet
    passed = least_hashed(own, "_lang", per_language, "_id").groupBy("_lang", "_id", "_h").agg(F.min("_text").alias("_text"))
    first = W.partitionBy("_lang").orderBy("_h", "_id")
    sample = passed.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_language).select("_lang", "_text")

    def count(batches):
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist(), strict=True):
                known = counts.setdefault(lang, Counter())
                for token, n in Counter(text.lower().split()).items():
                    for w in letter_words(token):
                        if w:
                            known[w] += n
        for lang, known in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(known), pa.string()), pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())], names=["lang", "word", "n"])

    def fitted(rows: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for word, n in zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True):
            counts[word] += n
        pieces = vocabulary(path)
        p = train_language(counts, pieces, PieceTable(pieces)).astype("<f4")
        return pa.table({"lang": rows["lang"][:1], "p": pa.array([p.tobytes()], pa.binary())})

    # a language's words meet in one task, at most FIT_DOCS texts of TEXT_BYTES
    words = sample.mapInArrow(count, "lang string, word string, n long")
    got = words.groupBy("lang").applyInArrow(fitted, "lang string, p binary").toArrow().sort_by("lang")
    langs, pieces = got["lang"].to_pylist(), vocabulary(path)
    p = np.stack([np.frombuffer(x, "<f4") for x in got["p"].to_pylist()], 1) if langs else np.zeros((len(pieces) + 1, 0), np.float32)
    return spark.sparkContext.broadcast((langs, pieces, p, np.full(len(langs), FLOOR)))


class Scorer:
    def __init__(self, model) -> None:
        self.langs, pieces, p, self.floor = model
        self.p, self.table = p.astype(np.float64), PieceTable(pieces)
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(self.langs) + 1), np.float32)  # the last column: letters

    def learn(self, tokens: list[str]) -> None:
        parts, owner = [], []
        for i, t in enumerate(tokens):
            for w in letter_words(t):
                parts.append(w)
                owner.append(i)
        new = np.zeros((len(tokens), self.rows.shape[1]))
        if parts and self.langs:
            own = np.array(owner)
            for at in batches_of(parts, len(self.langs)):
                got = Lattice([parts[i] for i in at], self.table).forward(self.p, self.floor)
                np.add.at(new[:, :-1], own[at], got)
            np.add.at(new[:, -1], own, 1.0)
        n = len(self.row)
        while n + len(tokens) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(tokens)] = new
        self.row.update(zip(tokens, range(n, n + len(tokens)), strict=True))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [(t or "").lower().split() for t in texts]
        new = set().union(*split) - self.row.keys() if split else set()
        if (len(self.row) + len(new)) * self.rows.itemsize * self.rows.shape[1] > CACHE_BYTES and self.row:
            self.forget()
            new = set().union(*split)
        if new:
            self.learn(sorted(new))
        langs, scores = [], []
        for tokens in split:
            total = self.rows[np.fromiter(map(self.row.__getitem__, tokens), np.int64, len(tokens))].sum(0, dtype=np.float64)
            if not self.langs or not total[-1]:
                langs.append(UND)
                scores.append(0.0)
                continue
            best = int(total[:-1].argmax())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(np.minimum(total[:-1] - total[best], 0)).sum()))
        return langs, scores


def identify(docs: DataFrame, model, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""

    def make(column):
        scorer = Scorer(model.value)

        def work(batch: pa.RecordBatch) -> list:
            texts = batch.column(column).to_pylist()
            out: tuple[list, list] = ([], [])
            for a in range(0, len(texts), 512):
                for x, got in zip(out, scorer.score(texts[a : a + 512]), strict=True):
                    x += got
            return list(out)

        return work

    return appended(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, text_col)
