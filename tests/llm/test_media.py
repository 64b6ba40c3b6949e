import hashlib
import random
import zlib

import pytest

from objloom.llm import media
from tests.llm.helpers import EDGE_TEXTS, frame


def check(rows, texts):
    seen = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload)) and len(payload) % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        wav = media.to_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest()) and r.feature == media.features(payload)
        assert seen.setdefault(texts[r.doc_id] or "", r[1:]) == r[1:]


def test_round_trip_with_shared_stretches(spark):
    r = random.Random(1)
    noise = lambda n: "".join(r.choice("abcdefghij klmnop\né") for _ in range(n))
    shared = noise(30_000)
    texts = [*EDGE_TEXTS, *(noise(r.randrange(4000)) + shared + noise(r.randrange(4000)) for _ in range(25)), noise(100_000)]
    texts += [texts[-1]] * 20
    docs = frame(spark, texts).selectExpr("*", "1 AS media", "2 AS digest")
    rows = media.store_media(docs).collect()
    assert sorted(x.doc_id for x in rows) == list(range(len(texts)))
    check(rows, texts)
    again = media.store_media(docs.where("doc_id > 10").unionAll(docs.where("doc_id > 10"))).collect()
    assert len(again) == 2 * (len(texts) - 11)
    check(again, texts)
    assert media.store_media(docs.where("false")).count() == 0


def test_store_alone_gives_every_medium(spark, monkeypatch):
    """Every distinct chunk is written once, and the written tables give back all media, also those that share nothing."""
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    shared = noise(20_000)
    texts = [noise(9000), noise(300), "", shared, noise(3000) + shared, noise(2000) + shared + shared]
    docs = frame(spark, texts)
    paths, keep = {}, media.written
    monkeypatch.setattr(media, "written", lambda df, name: paths.setdefault(name, keep(df, name)))
    check(media.store_media(docs.unionAll(docs)).collect(), texts)
    rows = media.chunk_table(paths["media"].dropDuplicates(["media"]), paths["chunks"]).collect()
    unpack = media._coder(bytes(paths["dictionary"].head().dictionary))[1]
    store = {bytes(x.digest): unpack(bytes(x.data)) for x in rows}
    want = [media.to_wav(media.payload_of(t.encode())) for t in texts]
    assert len(rows) == len(store) and set(store) == {media.digest(c) for w in want for c in media.chunks(w)}
    lists = {x.doc_id: x.digests for x in paths["media"].collect()}
    assert [b"".join(store[bytes(d)] for d in lists[i]) for i in range(len(texts))] == want


@pytest.mark.parametrize("table", ["media", "chunks"])
def test_a_lost_chunk_file_fails_the_job(spark, monkeypatch, table):
    """Results come from the written store: without one of its files there are none."""
    import os

    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    shared = noise(20_000)
    docs = frame(spark, [noise(9000), noise(3000) + shared, noise(2000) + shared])
    paths, keep = {}, media.written
    monkeypatch.setattr(media, "written", lambda df, name: paths.setdefault(name, keep(df, name)))
    made = media.store_media(docs)
    for f in paths[table].inputFiles():
        os.remove(f.removeprefix("file://"))
    with pytest.raises(Exception, match="does not exist|FileNotFound|FAILED_READ_FILE|lacks chunks"):
        made.collect()


def test_a_changed_chunk_is_refused():
    data = media.to_wav(media.payload_of(b"some text"))
    pack, unpack = media._coder(b"")
    key = hashlib.sha256(data).digest()
    have = {media.digest(c): pack(c) for c in media.chunks(data)}
    listed = list(have)
    assert media._described(listed, have, key, unpack)[0] == hashlib.sha256(media.from_wav(data)).hexdigest()
    with pytest.raises(ValueError, match="lacks chunks"):
        media._described(listed, {}, key, unpack)
    with pytest.raises(ValueError, match="not reconstructed"):
        media._described(listed, {listed[0]: pack(b"other")}, key, unpack)


@pytest.mark.parametrize("bits", [1 << 10, 1 << 27])
def test_a_full_filter_changes_nothing(spark, monkeypatch, bits):
    r = random.Random(6)
    texts = ["".join(r.choice("abcdefghij klmnop") for _ in range(r.randrange(6000))) for _ in range(40)]
    texts += texts
    monkeypatch.setattr(media, "BLOOM_BITS", bits)
    monkeypatch.setattr(media, "BITS_EACH", 1 if bits == 1 << 10 else 16)
    rows = media.store_media(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_rows_without_id(spark):
    rows = media.store_media(spark.createDataFrame([(None, "a"), (None, "b"), (1, "b")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and len({r.media_sha256 for r in rows}) == 2


def test_cuts_follow_content():
    r = random.Random(2)
    body = bytes(r.randrange(97, 123) for _ in range(200_000))
    a, b = media.chunks(body), media.chunks(b"inserted" + body)
    assert b"".join(a) == body and b"".join(b) == b"inserted" + body
    assert all(media.LEAST < len(c) <= media.MOST for c in a[:-1])
    assert len(set(a) & set(b)) > 0.8 * len(a)
    # the rolling hash by doubling is the plain one over 32 bytes
    marks = [i + 1 for i in range(31, 5000) if not sum(int(media.GEAR[body[i - k]]) << k for k in range(32)) % 2**32 >> (32 - media.MASK_BITS)]
    want, at = [], 0
    for m in marks:
        if m - at >= media.LEAST:
            want.append(m)
            at = m
    got = media.cuts(body[:5000])
    assert got[:-1] == [m for m in want if m < 5000] or got == [*want, 5000]


def test_wav():
    assert media.from_wav(media.to_wav(b"abcd" * 48)) == b"abcd" * 48
    with pytest.raises(ValueError):
        media.from_wav(media.to_wav(b"ab")[:-1])
