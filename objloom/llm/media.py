"""Operator 6: media columns with content-defined payload chunking.

A payload (a text in UTF-8, padded with spaces to a positive multiple of 192
bytes) is stored losslessly as 8-bit mono PCM samples in a WAV file.  The
file's bytes are cut where a rolling gear hash of the last 32 bytes has
``MASK_BITS`` zero bits, between ``LEAST`` and ``MOST`` bytes after the last
cut, so equal stretches of different payloads give equal chunks.

1. *Repeated chunks*: each text is cut and only the digests of its chunks are
   counted, combined before their shuffle.  Those of two or more texts go into
   a Bloom filter of at most ``BLOOM_BITS`` bits (16 MB), which is broadcast.
2. *Store*: every distinct chunk, compressed with a small shared zstandard
   dictionary, is written once to the shared folder.  A chunk that isn't in the
   filter is in one text only, so the task that cuts the text writes it, with
   its digest, in the row of the medium and its ordered list of digests: its
   bytes are never shuffled.  Chunks in the filter are joined by digest and
   written once each to a second table.  What the filter takes for repeated by
   mistake, or because it is full, only moves more bytes.
3. *Reconstruction*: every medium is rebuilt from the written tables by its
   ordered list.  One whose chunks are all in its row is rebuilt in the task
   that reads it.  To others, repeated chunks are joined by digest (AQE splits
   the join where a chunk is very frequent), once for each different medium,
   and list, own chunks and joined ones are brought together.  Each chunk must
   be there and have its digest, and the joined bytes the medium's, else the
   job fails.  Samples are read from the WAV and features are computed from
   them.

A text that many documents share is reconstructed once: documents get what was
read back of it by the medium's digest.

Defined results: null is the empty text (one block of spaces); equal texts have
equal values; repeated rows give repeated rows; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objloom.llm.common import column, sampled_texts, utf8, written

BLOCK = 192
RATE = 8000
WINDOW, MASK_BITS, LEAST, MOST = 32, 12, 1024, 16_384
LEVEL = 6
SAMPLE_ROWS = 400
DICT_BYTES = 65_536
HEADER = 44
SLICE = 256
#: Most bits of the filter of repeated chunks; bits for each of them where there is room; bits set for each.
BLOOM_BITS, BITS_EACH, PROBES = 1 << 27, 16, 4
#: Digests of repeated chunks that a task remembers having emitted.
EMITTED = 100_000

#: The gear table: a fixed pseudo-random 32-bit number for each byte.
GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=4).digest() for b in range(256)), "<u4")


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b" ")


def to_wav(payload: bytes) -> bytes:
    """8-bit unsigned mono PCM; the payload's length is even, so no pad byte is needed."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", n + 36, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file as made by to_wav."""
    riff, size, wave, fmt, _, code, channels, _, _, width, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, fmt, data, code, channels, width, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 1, 8) or size != n + 36 or len(media) != n + HEADER:
        raise ValueError("not an 8-bit mono PCM file")
    return media[HEADER:]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data, the last its length."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:  # the sum of gear << distance over the last 2*step bytes, from that over the last step
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[i]) if i < len(marks) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def features(payload: bytes) -> str:
    """Integers from the samples (offset by 128): peak, sum of squares per sample, zero crossings, sum of steps, distinct values."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    sign = x >= 0
    n = len(x)
    return f"n={n};peak={int(np.abs(x).max())};mean={int(x.sum()) * 1000 // n};power={int((x * x).sum()) // n};cross={int((sign[1:] != sign[:-1]).sum())};steps={int(np.abs(np.diff(x)).sum())};values={len(np.unique(x))}"


CHUNK = pa.struct([("digest", pa.binary()), ("data", pa.binary())])
STORED = "doc_id long, n_bytes long, payload_bytes long, media_bytes long, media binary, digests array<binary>, chunks array<struct<digest:binary,data:binary>>, complete boolean"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(CHUNK), pa.bool_()]
READ = "payload_sha256 string, tail_crc32 long, feature string"


def _dictionary(docs: DataFrame, text_col: str) -> bytes:
    """A zstandard dictionary from a bounded sample; it affects the stored size, never results."""
    import zstandard as z

    own = [x for t in sampled_texts(docs, text_col, SAMPLE_ROWS) for x in chunks(to_wav(payload_of(t.encode())))]
    try:
        return z.train_dictionary(DICT_BYTES, own, level=LEVEL).as_bytes()
    except z.ZstdError:
        return b""


def _coder(dictionary: bytes):
    import zstandard as z

    if not dictionary:
        return z.ZstdCompressor(level=LEVEL).compress, z.ZstdDecompressor().decompress
    d = z.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return z.ZstdCompressor(level=LEVEL, dict_data=d, write_dict_id=False, write_checksum=False).compress, z.ZstdDecompressor(dict_data=d).decompress


def _slices(batches):
    """Batches of at most SLICE rows, so that a worker holds few decoded payloads at once."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def _probes(digests: list[bytes], bits: int) -> np.ndarray:
    """Positions in a filter of so many bits, a row for each digest."""
    return np.frombuffer(b"".join(digests), "<u4").reshape(len(digests), 4)[:, :PROBES] & np.uint32(bits - 1)


def _filter(repeated: DataFrame) -> np.ndarray:
    """A Bloom filter of the digests as 64-bit words, of a size bounded whatever their number."""
    n = repeated.count()
    bits = min(BLOOM_BITS, max(1 << 10, 1 << (BITS_EACH * max(1, n) - 1).bit_length()))

    def run(batches):
        for b in batches:
            if b.num_rows:
                at = _probes(b.column(0).to_pylist(), bits).ravel().astype(np.int64)
                word, bit = at >> 6, np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bit"])

    rows = repeated.select("digest").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # BLOOM_BITS / 64 rows at most
    out = np.zeros(bits >> 6, np.uint64)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return out


def _among(words: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Which of the digests the filter has."""
    if not digests:
        return np.zeros(0, bool)
    at = _probes(digests, len(words) << 6).astype(np.int64)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)


def _chunk(key: bytes, data: bytes, unpack) -> bytes:
    """The bytes of a stored chunk."""
    raw = unpack(data)
    if digest(raw) != key:
        raise ValueError(f"chunk {key.hex()} was not reconstructed")
    return raw


def _described(listed: list[bytes], have: dict[bytes, bytes], key: bytes, unpack) -> tuple[str, int, str]:
    """What is read back from the stored chunks of a medium."""
    lost = [d.hex() for d in listed if d not in have]
    if lost:
        raise ValueError(f"medium {key.hex()} lacks chunks {', '.join(lost[:3])}")
    raw = {d: _chunk(d, have[d], unpack) for d in set(listed)}
    media = b"".join(raw[d] for d in listed)
    if hashlib.sha256(media).digest() != key:
        raise ValueError(f"medium {key.hex()} was not reconstructed")
    payload = from_wav(media)
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), features(payload)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def chunk_table(media: DataFrame, repeated: DataFrame) -> DataFrame:
    """digest and data of all stored chunks, from the two written tables."""
    return media.select(F.explode("chunks").alias("c")).select("c.digest", "c.data").unionAll(repeated.select("digest", "data"))


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of every row."""
    spark = docs.sparkSession
    source = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("_text"))
    dictionary = written(spark.createDataFrame([(bytearray(_dictionary(docs, text_col)),)], "dictionary binary"), "dictionary")
    coded = spark.sparkContext.broadcast(bytes(dictionary.head().dictionary))

    def cut(batches):
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([d for t in utf8(b.column(0)) for d in {digest(c) for c in chunks(to_wav(payload_of(t)))}], pa.binary())], names=["digest"])

    counted = source.select("_text").mapInArrow(cut, "digest binary").groupBy("digest").agg(F.count("*").alias("n"))
    known = spark.sparkContext.broadcast(_filter(written(counted.where("n > 1").select("digest"), "repeated")))

    def keep(batches):
        """A row for each document: its list, and the chunks that no other text has."""
        pack, among = _coder(coded.value)[0], known.value
        for b in _slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                payload = payload_of(text)
                wav = to_wav(payload)
                cut_up = chunks(wav)
                listed = [digest(c) for c in cut_up]
                moved = _among(among, listed)
                own = {d: c for d, c, away in zip(listed, cut_up, moved, strict=True) if not away}
                rows.append((doc, len(text), len(payload), len(wav), hashlib.sha256(wav).digest(), listed, [{"digest": d, "data": pack(c)} for d, c in own.items()], not moved.any()))
            yield _batch(rows, names, KINDS)

    def emit(batches):
        """Chunks that other texts have, too; a task emits one again only after many others."""
        pack, among, done = _coder(coded.value)[0], known.value, set()
        for b in _slices(batches):
            rows = {}
            for text in utf8(b.column(0)):
                cut_up = chunks(to_wav(payload_of(text)))
                listed = [digest(c) for c in cut_up]
                for i in np.flatnonzero(_among(among, listed)):
                    if listed[i] not in done:
                        done.add(listed[i])
                        rows[listed[i]] = pack(cut_up[i])
            if len(done) > EMITTED:
                done.clear()
            yield _batch(list(rows.items()), ["digest", "data"], [pa.binary(), pa.binary()])

    names = [x.split()[0] for x in STORED.split(", ")]
    media = written(source.mapInArrow(keep, STORED), "media")
    repeated = written(source.select("_text").mapInArrow(emit, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data")), "chunks")

    done = ["doc_id", "n_bytes", "payload_bytes", "media_bytes", "media"]
    found, found_kinds = [*done, "payload_sha256", "tail_crc32", "feature"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string()]

    def read_back(batches):
        """Media whose chunks are all in their row."""
        unpack = _coder(coded.value)[1]
        for b in _slices(batches):
            rows = []
            for *head, key, listed, own in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                rows.append((*head, key, *_described(listed, {c["digest"]: c["data"] for c in own}, key, unpack)))
            yield _batch(rows, found, found_kinds)

    def rebuild(batches):
        """Rows (media, kind, digests, chunks) sorted by the first two: a medium's list and own chunks, then the joined ones."""
        unpack = _coder(coded.value)[1]
        key, listed, have, rows = None, [], {}, []
        close = lambda: (key, *_described(listed, have, key, unpack))
        for b in _slices(batches):
            for m, digests, more in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if m != key:
                    if key is not None:
                        rows.append(close())
                    key, listed, have = m, [], {}
                listed = digests or listed
                have |= {c["digest"]: c["data"] for c in more}
            yield _batch(rows, ["media", *found[5:]], found_kinds[4:])
            rows = []
        if key is not None:
            yield _batch([close()], ["media", *found[5:]], found_kinds[4:])

    whole = media.where("complete").select(*done, "digests", "chunks").mapInArrow(read_back, ", ".join(STORED.split(", ")[:5]) + ", " + READ)
    rest = media.where("NOT complete")
    lists = rest.groupBy("media").agg(F.first("digests").alias("digests"), F.first("chunks").alias("chunks"))
    own = F.transform("chunks", lambda c: c["digest"])
    wanted = lists.select("media", F.explode(F.array_except("digests", own)).alias("digest"))
    joined = wanted.join(repeated, "digest").select("media", F.lit(1).alias("kind"), F.array().cast("array<binary>").alias("digests"), F.array(F.struct("digest", "data")).alias("chunks"))
    parts = lists.select("media", F.lit(0).alias("kind"), "digests", "chunks").unionAll(joined)
    rebuilt = parts.repartition("media").sortWithinPartitions("media", "kind").mapInArrow(rebuild, "media binary, " + READ)
    made = whole.unionAll(rest.select(*done).join(rebuilt, "media").select(*done, *found[5:]))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature")
