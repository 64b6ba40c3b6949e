"""Small inputs that every operator must take, and plain versions of what operators compute."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

EDGE_TEXTS = [
    None, "", " ", "\n\n", "a", "!!! ???", "naïve Straße 東京 𝒳 token=abcdefgh", "x" * 5000, "word " * 20_000, "same text here for all of us", "same text here for all of us",
    "tab\tand  two spaces \n and\r\nlines", "<|endoftext|> inside <|endoftext|>", " nbsp em", "0123456789abcdef0123456789abcdef",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows(texts, first=0):
    return [(first + i, t, None if t is None else "en", "s", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, texts, first=0):
    return spark.createDataFrame(rows(texts, first), SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
