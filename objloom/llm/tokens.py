"""Operator 2: token counts by a map-side two-tier lookup.

A text is cut, in one pass and without a regular expression in the usual case,
into *pre-tokens* ``" word,"``: each begins with the last space before a
non-space.  The byte-level BPE pattern never puts a token across such a cut, so
lengths (or ids) of pre-tokens simply add up.

Tier 1 is a broadcast hash table from the frequent pre-tokens to their number
of tokens, of at most ``TABLE_ROWS`` rows.  It is filled from a sample of
``SAMPLE_ROWS`` documents; it only saves work, so results don't depend on it.
Tier 2 is a cache in each Python worker of at most ``CACHE_ROWS`` rows, for
pre-tokens of at most ``CACHE_CHARS`` characters, so it is bounded in bytes,
too.  Only a miss in both is encoded.  No pre-token is ever shuffled.

Misses whose characters are all below U+0250 go to the rank encoder over the
same vocabulary (the same merges in the same order, several times faster);
others, and whole texts that hold a special token's string, go to the
``tokenizers`` library itself, so those strings are handled as its default.

Defined results: null is the empty text, which has no tokens; repeated rows
give repeated rows; extra columns are kept, those
with a name of the results as ``input_<name>``; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from objloom.llm.common import appended, sampled_texts

TABLE_ROWS = 32_768
SAMPLE_ROWS = 500
CACHE_ROWS, CACHE_CHARS = 400_000, 64

_ODD = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")
_WIDE = re.compile(r"[^\x00-ɏ]")
#: The pattern of byte-level BPE pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text; all but the first have lost their leading space."""
    return text.split(" ") if _ODD.search(text) is None else _CUT.split(text)


class Encoder:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        byte_of = _byte_alphabet()
        vocab = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.ranks = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})._core_bpe.encode_ordinary

    def piece(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        return self.library.encode(text, add_special_tokens=False).ids if _WIDE.search(text) else self.ranks(text)

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def is_special(self, text: str) -> bool:
        return self.special_re is not None and self.special_re.search(text) is not None


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level BPE files: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lookup(dict):
    """Pre-token (without its space) to a value; on a miss the value is encoded and kept while there is room."""

    def __init__(self, frequent: dict, value, rows: int = CACHE_ROWS) -> None:
        super().__init__(frequent)
        self.frequent, self.value, self.rows = frequent, value, len(frequent) + rows

    def __missing__(self, key: str):
        got = self.value(" " + key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.rows:
                self.clear()
                self.update(self.frequent)
            self[key] = got
        return got


def frequent_table(docs: DataFrame, path: str, text_col: str = "text", rows: int = TABLE_ROWS, sample: int = SAMPLE_ROWS) -> dict[str, int]:
    """The most frequent pre-tokens of a bounded sample and their token counts."""
    counts: Counter[str] = Counter()
    for t in sampled_texts(docs, text_col, sample):
        counts.update(pre_tokens(t)[1:])
    enc = Encoder(path)
    top = [k for k, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:rows] if len(k) <= 64 and not enc.is_special(" " + k)]
    return {k: len(enc.piece(" " + k)) for k in top}


def count_tokens(docs: DataFrame, path: str, *, text_col: str = "text", limit: int = 1024, table_rows: int = TABLE_ROWS) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    sc = docs.sparkSession.sparkContext
    frequent = sc.broadcast(frequent_table(docs, path, text_col, table_rows))

    def make(column):
        enc = Encoder(path)
        get = Lookup(frequent.value, lambda s: len(enc.piece(s)))
        firsts: dict[str, int] = {}

        def length(text: str) -> int:
            if not text:
                return 0
            if enc.is_special(text):
                return len(enc.whole(text))
            units = pre_tokens(text)
            first = units[0]
            n = firsts.get(first)
            if n is None:
                n = len(enc.piece(first))
                if len(first) <= CACHE_CHARS:
                    if len(firsts) > 50_000:
                        firsts.clear()
                    firsts[first] = n
            return n + sum(map(get.__getitem__, units[1:]))

        def work(batch: pa.RecordBatch) -> list:
            col = batch.column(column)
            n = np.fromiter((length(t or "") for t in col.to_pylist()), np.int64, len(col))
            return [pc.fill_null(pc.binary_length(col), 0).cast(pa.int64()), pa.array(n), pa.array(n > limit)]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return appended(docs, fields, make, text_col)
