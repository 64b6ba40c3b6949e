"""Byte-serial codecs in plain Python, run inside Arrow functions.

Each parser gives a value or raises CodecError with an error code; the Spark
side turns that into an error column, so one bad object never fails a job.
Bodies are parsed by regular expressions over whole headers.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

SIZES = {"sha1": 20, "sha256": 32}
TYPES = (b"blob", b"tree", b"commit", b"tag")
#: Types of pack entries.
ENTRY_TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "ofs", 7: "ref"}
MODES = {b"40000": "tree", b"100644": "blob", b"100755": "blob", b"120000": "blob", b"160000": "commit"}
MAX_DEPTH = 4096


class CodecError(ValueError):
    def __init__(self, code: str, what: str = "") -> None:
        super().__init__(f"{code}: {what}" if what else code)
        self.code = code


def hasher(fmt: str):
    return hashlib.sha1() if fmt == "sha1" else hashlib.sha256()


def sum_of(data: bytes, fmt: str) -> bytes:
    h = hasher(fmt)
    h.update(data)
    return h.digest()


def object_id(otype: str, body: bytes, fmt: str) -> bytes:
    return sum_of(b"%b %d\0" % (otype.encode(), len(body)) + body, fmt)


_HEADER = re.compile(rb"([^ \0]+) ([0-9]+)\0")


def number(digits: bytes, code: str, bits: int = 64) -> int:
    """An unsigned decimal number below 2**bits, of any number of digits."""
    short = digits.lstrip(b"0")
    n = int(short or b"0") if len(short) <= 20 else 2**bits
    if n >= 2**bits:
        raise CodecError(code)
    return n


def parse_header(raw: bytes) -> tuple[str, int, int]:
    """Type, declared size and where the body begins, of the first bytes of a framed object."""
    m = _HEADER.match(raw)
    if not m:
        raise CodecError("ErrInvalidHeader")
    size = number(m[2], "ErrInvalidHeader")
    if m[1] not in TYPES:
        raise CodecError("ErrInvalidType")
    return m[1].decode(), size, m.end()


def parse_framed(raw: bytes) -> tuple[str, bytes]:
    """Type and body of ``type SP size NUL body``."""
    otype, size, at = parse_header(raw)
    if size != len(raw) - at:
        raise CodecError("ErrSizeMismatch")
    return otype, raw[at:]


def framed(otype: str, body: bytes) -> bytes:
    return b"%b %d\0" % (otype.encode(), len(body)) + body


# -- identities, trees, commits, tags

_IDENTITY = re.compile(rb"([^<]*)<([^>]*)> ([+-]?[0-9]+) ([+-])([0-9]{2}|[+-][0-9])([0-9]{2}|[+-][0-9])", re.S)


def parse_identity(line: bytes) -> tuple[bytes, bytes, int, int]:
    m = _IDENTITY.match(line)
    if not m:
        raise CodecError("ErrInvalidSignature")
    when = number(m[3].lstrip(b"+-"), "ErrInvalidSignature") * (-1 if m[3][:1] == b"-" else 1)
    hh, mm = int(m[5]), int(m[6])
    if not (-(2**63) <= when < 2**63 and 0 <= hh <= 23 and 0 <= mm <= 59):
        raise CodecError("ErrInvalidSignature")
    return m[1].rstrip(b" "), m[2], when, (hh * 60 + mm) * (-1 if m[4] == b"-" else 1)


def format_identity(name: bytes, email: bytes, when: int, offset: int) -> bytes:
    if abs(offset) > 23 * 60 + 59:
        raise CodecError("ErrInvalidSignature")
    return b"%b <%b> %d %c%02d%02d" % (name, email, when, b"-" if offset < 0 else b"+", abs(offset) // 60, abs(offset) % 60)


def entry_key(mode: bytes, name: bytes) -> bytes:
    return name + b"/" if mode == b"40000" else name


def parse_tree(body: bytes, fmt: str) -> list[tuple[bytes, bytes, bytes]]:
    """(octal mode, name, id) of each entry, which must be in strict order, without a file and a directory of one name."""
    entry = re.compile(rb"([0-7]+) ([^\0]*)\0(.{%d})" % SIZES[fmt], re.S)
    rows, at, last, names = [], 0, None, set()
    while at < len(body):
        m = entry.match(body, at)
        if not m or not m[2] or b"/" in m[2]:
            raise CodecError("ErrInvalidTree")
        if m[1] not in MODES:
            raise CodecError("ErrInvalidMode")
        key = entry_key(m[1], m[2])
        if last is not None and key <= last or m[2] in names:
            raise CodecError("ErrInvalidTree", "order or duplicate")
        names.add(m[2])
        rows.append((m[1], m[2], m[3]))
        last, at = key, m.end()
    return rows


def build_tree(rows: list[tuple[bytes, bytes, bytes]]) -> bytes:
    return b"".join(b"%b %b\0%b" % r for r in sorted(rows, key=lambda r: entry_key(r[0], r[1])))


def _extra(lines: list[bytes], code: str, own: tuple[bytes, ...]) -> Iterator[tuple[bytes, bytes]]:
    """Key and value of extra header lines.  Signatures are left out with their continuations; other continuations have an empty key."""
    skipping = False
    for line in lines:
        if skipping and line.startswith(b" "):
            continue
        key, space, value = line.partition(b" ")
        if not space or key in own:
            raise CodecError(code)
        skipping = key in (b"gpgsig", b"gpgsig-sha256")
        if not skipping:
            yield key, value


def _hex(size: int) -> bytes:
    return rb"([0-9a-fA-F]{%d})" % (2 * size)


def parse_commit(body: bytes, fmt: str) -> dict:
    h = _hex(SIZES[fmt])
    m = re.match(rb"tree " + h + rb"\n((?:parent " + h + rb"\n)*)author ([^\n]*)\ncommitter ([^\n]*)\n((?:[^\n]+\n)*)\n", body)
    if not m:
        raise CodecError("ErrInvalidCommit")
    extra = list(_extra(m[6].split(b"\n")[:-1], "ErrInvalidCommit", (b"tree", b"parent", b"author", b"committer")))
    changes = [v for k, v in extra if k == b"change-id"]
    try:
        author, committer = parse_identity(m[4]), parse_identity(m[5])
    except CodecError as e:
        raise CodecError("ErrInvalidCommit", e.code) from None
    return {
        "tree": bytes.fromhex(m[1].decode()), "parents": [bytes.fromhex(x.decode()) for x in re.findall(rb"parent ([0-9a-fA-F]+)\n", m[2])],
        "author": author, "committer": committer, "change_id": changes[-1] if changes else None,
        "extra": [(k, v) for k, v in extra if k != b"change-id"], "message": body[m.end() :],
    }


def build_commit(c: dict) -> bytes:
    lines = [b"tree " + c["tree"].hex().encode(), *(b"parent " + p.hex().encode() for p in c["parents"])]
    lines += [b"author " + format_identity(*c["author"]), b"committer " + format_identity(*c["committer"])]
    lines += [b"change-id " + c["change_id"]] if c["change_id"] else []
    lines += [k + b" " + v for k, v in c["extra"]]
    return b"\n".join(lines) + b"\n\n" + c["message"]


def parse_tag(body: bytes, fmt: str, valid_name=None) -> dict:
    m = re.match(rb"object " + _hex(SIZES[fmt]) + rb"\ntype (blob|tree|commit|tag)\ntag ([^\n]*)\ntagger ([^\n]*)\n((?:[^\n]+\n)*)(\n|\Z)", body)
    if not m or valid_name and not valid_name(m[3]):
        raise CodecError("ErrInvalidTag")
    try:
        tagger = parse_identity(m[4])
    except CodecError as e:
        raise CodecError("ErrInvalidTag", e.code) from None
    extra = list(_extra(m[5].split(b"\n")[:-1], "ErrInvalidTag", (b"object", b"type", b"tag", b"tagger")))
    return {"target": bytes.fromhex(m[1].decode()), "target_type": m[2].decode(), "name": m[3], "tagger": tagger, "extra": extra, "message": body[m.end() :]}


def build_tag(t: dict) -> bytes:
    lines = [b"object " + t["target"].hex().encode(), b"type " + t["target_type"].encode(), b"tag " + t["name"], b"tagger " + format_identity(*t["tagger"])]
    return b"\n".join([*lines, *(k + b" " + v for k, v in t["extra"])]) + b"\n\n" + t["message"]


# -- signed payloads

SIGNATURE_HEADERS = {b"gpgsig": "sha1", b"gpgsig-sha256": "sha256"}
# Lines that begin a signature in a tag's body.
SIGNATURE_BEGINS = (b"-----BEGIN PGP SIGNATURE-----", b"-----BEGIN PGP MESSAGE-----", b"-----BEGIN SSH SIGNATURE-----", b"-----BEGIN SIGNED MESSAGE-----")


def _header_blocks(head: bytes) -> list[list[bytes]]:
    """Header lines with their continuation lines."""
    blocks: list[list[bytes]] = []
    for line in head.splitlines(keepends=True) if b"\r" not in head else re.findall(rb"[^\n]*\n|[^\n]+\Z", head):
        if line.startswith(b" ") and blocks:
            blocks[-1].append(line)
        else:
            blocks.append([line])
    return blocks


def _split_head(body: bytes) -> tuple[bytes, bytes]:
    if body.startswith(b"\n"):
        return b"", body
    at = body.find(b"\n\n")
    return (body, b"") if at < 0 else (body[: at + 1], body[at + 1 :])


def split_signed_commit(body: bytes) -> tuple[bytes, dict[str, bytes]]:
    """Payload and signatures: every header that begins with ``gpgsig`` leaves the payload, but only the two known ones are kept."""
    head, rest = _split_head(body)
    payload, sigs = [], {}
    for first, *more in _header_blocks(head):
        if not first.startswith(b"gpgsig"):
            payload += [first, *more]
            continue
        key, space, value = first.partition(b" ")
        fmt = SIGNATURE_HEADERS.get(key) if space else None
        if fmt:
            sigs[fmt] = sigs.get(fmt, b"") + value + b"".join(x[1:] for x in more)
    return b"".join(payload) + rest, sigs


def split_signed_tag(body: bytes, fmt: str) -> tuple[bytes, dict[str, bytes]]:
    """Payload and signatures: known header signatures, and the stored format's from the last line that begins one."""
    starts = [m.start() for m in re.finditer(rb"^(?:" + b"|".join(map(re.escape, SIGNATURE_BEGINS)) + rb")", body, re.M)]
    at = starts[-1] if starts else len(body)
    head, rest = _split_head(body[:at])
    payload, sigs = [], {}
    for first, *more in _header_blocks(head):
        key, space, value = first.partition(b" ")
        known = SIGNATURE_HEADERS.get(key) if space else None
        if known:
            sigs[known] = sigs.get(known, b"") + value + b"".join(x[1:] for x in more)
        else:
            payload += [first, *more]
    if starts:
        sigs[fmt] = sigs.get(fmt, b"") + body[at:]
    return b"".join(payload) + rest, sigs


# -- packs


def little_base128(data: bytes, at: int, limit: int = 10) -> tuple[int, int]:
    """A little-endian base-128 number and where it ends."""
    m = re.compile(rb"[\x80-\xff]*[\x00-\x7f]", re.S).match(data, at)
    if not m or len(m[0]) > limit:
        raise CodecError("ErrMalformedDelta")
    n = sum((b & 0x7F) << 7 * i for i, b in enumerate(m[0]))
    if n >= 2**64:
        raise CodecError("ErrMalformedDelta")
    return n, m.end()


def parse_entry_header(data: bytes, at: int, fmt: str) -> dict:
    """type, size, base offset distance or base id, and where the packed data begins."""
    m = re.compile(rb"[\x80-\xff]*[\x00-\x7f]", re.S).match(data, at)
    if not m or len(m[0]) > 10:
        raise CodecError("ErrMalformedEntryHeader")
    kind, size = m[0][0] >> 4 & 7, m[0][0] & 15
    size += sum((b & 0x7F) << 4 + 7 * i for i, b in enumerate(m[0][1:]))
    if kind not in ENTRY_TYPES or size >= 2**64:
        raise CodecError("ErrMalformedEntryHeader")
    row = {"type": ENTRY_TYPES[kind], "size": size, "distance": None, "base": None, "end": m.end()}
    if kind == 6:
        row["distance"], row["end"] = parse_distance(data, m.end())
    elif kind == 7:
        row["base"], row["end"] = data[m.end() : m.end() + SIZES[fmt]], m.end() + SIZES[fmt]
        if len(row["base"]) < SIZES[fmt]:
            raise CodecError("ErrMalformedEntryHeader")
    return row


def build_entry_header(kind: str, size: int) -> bytes:
    code = next(k for k, v in ENTRY_TYPES.items() if v == kind)
    groups = [size & 15]
    size >>= 4
    while size:
        groups.append(size & 0x7F)
        size >>= 7
    return bytes(g | (0x80 if i < len(groups) - 1 else 0) | (code << 4 if i == 0 else 0) for i, g in enumerate(groups))


def parse_distance(data: bytes, at: int) -> tuple[int, int]:
    """Base-128 with 1 added at each continuation."""
    m = re.compile(rb"[\x80-\xff]*[\x00-\x7f]", re.S).match(data, at)
    if not m or len(m[0]) > 10:
        raise CodecError("ErrMalformedOfsDistance")
    k = len(m[0])
    n = sum((b & 0x7F) << 7 * (k - 1 - i) for i, b in enumerate(m[0])) + sum(1 << 7 * i for i in range(1, k))
    if n >= 2**64:
        raise CodecError("ErrMalformedOfsDistance")
    return n, m.end()


def build_distance(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        n -= 1
        out.append(0x80 | n & 0x7F)
    return bytes(out[::-1])


_SELECTED = {op: [i for i in range(7) if op >> i & 1] for op in range(128)}


def delta_instructions(delta: bytes) -> tuple[int, int, list[tuple[str, int, int, bytes]]]:
    """Base size, result size, and (op, offset, length, literal) rows."""
    base, at = little_base128(delta, 0)
    result, at = little_base128(delta, at)
    rows = []
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            bits = _SELECTED[op & 0x7F]
            raw = delta[at : at + len(bits)]
            if len(raw) < len(bits):
                raise CodecError("ErrMalformedDelta")
            number = sum(b << 8 * i for b, i in zip(raw, bits, strict=True))
            rows.append(("copy", number & 0xFFFFFFFF, number >> 32 or 0x10000, b""))
            at += len(bits)
        elif op:
            literal = delta[at : at + op]
            if len(literal) < op:
                raise CodecError("ErrMalformedDelta")
            rows.append(("insert", 0, op, literal))
            at += op
        else:
            raise CodecError("ErrMalformedDelta")
    return base, result, rows


def delta_sizes(delta: bytes) -> tuple[int, int]:
    """Base size and result size from a delta's first bytes; 20 are enough."""
    base, at = little_base128(delta, 0)
    return base, little_base128(delta, at)[0]


def apply_delta(base: bytes, delta: bytes, max_size: int = 0) -> bytes:
    """The result of a delta; ErrObjectTooLarge, before anything is copied, if it declares more than max_size bytes (no limit if that is 0)."""
    if 0 < max_size < delta_sizes(delta)[1]:
        raise CodecError("ErrObjectTooLarge")
    size, result, rows = delta_instructions(delta)
    if size != len(base) or any(op == "copy" and o + n > len(base) for op, o, n, _ in rows):
        raise CodecError("ErrMalformedDelta")
    out = b"".join(lit if op == "insert" else base[o : o + n] for op, o, n, lit in rows)
    if len(out) != result:
        raise CodecError("ErrMalformedDelta")
    return out


def build_delta(base: bytes, target: bytes) -> bytes:
    """A valid delta: the common head and tail are copied, the middle is literal."""
    head = 0
    most = min(len(base), len(target))
    while head < most and base[head] == target[head]:
        head += 1
    tail = 0
    while tail < most - head and base[-1 - tail] == target[-1 - tail]:
        tail += 1

    def size(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    def copy(off: int, n: int) -> bytes:
        out = b""
        while n:
            step = min(n, 0xFFFFFF)
            op, args = 0x80, b""
            for i, b in enumerate(struct.pack("<IHB", off, step & 0xFFFF, step >> 16)):
                if b:
                    op, args = op | 1 << i, args + bytes([b])
            if step == 0x10000:
                op, args = 0x80 | op & 0x0F, args[: bin(op & 0x0F).count("1")]
            out, off, n = out + bytes([op]) + args, off + step, n - step
        return out

    middle = target[head : len(target) - tail]
    inserts = b"".join(bytes([len(x)]) + x for x in (middle[i : i + 127] for i in range(0, len(middle), 127)))
    return size(len(base)) + size(len(target)) + copy(0, head) + inserts + copy(len(base) - tail, tail)


def inflate(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    """The zlib stream at ``at``, of exactly ``size`` bytes, and where it ends."""
    z = zlib.decompressobj()
    try:
        out = z.decompress(data[at:] if not isinstance(data, memoryview) else data[at:], size + 1)
        if len(out) <= size and not z.eof:
            out += z.decompress(z.unconsumed_tail, 1)
    except zlib.error:
        raise CodecError("ErrMalformedPack") from None
    if not z.eof or len(out) != size:
        raise CodecError("ErrMalformedPack")
    return out, len(data) - len(z.unused_data)


def inflate_head(data: bytes, at: int, most: int) -> bytes:
    """The first bytes of the zlib stream at ``at``, at most that many."""
    try:
        return zlib.decompressobj().decompress(data[at : at + 4096], most)
    except zlib.error:
        raise CodecError("ErrMalformedPack") from None


def complete_pack(data: bytes, bases: list[tuple[str, bytes]], fmt: str) -> bytes:
    """A thin pack with base objects appended as whole entries, its count and trailer written anew."""
    n = SIZES[fmt]
    count = struct.unpack_from(">I", data, 8)[0] + len(bases)
    more = b"".join(build_entry_header(kind, len(body)) + zlib.compress(body) for kind, body in bases)
    out = data[:8] + struct.pack(">I", count) + data[12:-n] + more
    return out + sum_of(out, fmt)


def pack_trailer(data: bytes, fmt: str) -> tuple[int, bytes]:
    """The number of entries and the hash that a pack declares; the hash must be that of its content."""
    n = SIZES[fmt]
    if len(data) < 12 + n or data[:4] != b"PACK" or struct.unpack_from(">I", data, 4)[0] != 2:
        raise CodecError("ErrMalformedPackHeader")
    if sum_of(data[:-n], fmt) != data[-n:]:
        raise CodecError("ErrMalformedPack", "trailer")
    return struct.unpack_from(">I", data, 8)[0], data[-n:]


def scan_pack(data: bytes, fmt: str, max_size: int = 0) -> list[dict]:
    """Rows of a pack's entries in pack order, with inflated payloads; the trailer must match and nothing may follow it."""
    n = SIZES[fmt]
    if len(data) < 12 + n or data[:4] != b"PACK" or struct.unpack_from(">I", data, 4)[0] != 2:
        raise CodecError("ErrMalformedPackHeader")
    body = data[:-n]
    if sum_of(body, fmt) != data[-n:]:
        raise CodecError("ErrMalformedPack", "trailer")
    at, rows = 12, []
    for pos in range(struct.unpack_from(">I", data, 8)[0]):
        e = parse_entry_header(body, at, fmt)
        if 0 < max_size < e["size"]:
            raise CodecError("ErrObjectTooLarge")
        if e["distance"] is not None and not 0 < e["distance"] <= at:
            raise CodecError("ErrMalformedOfsDistance")
        payload, end = inflate(body, e["end"], e["size"])
        rows.append({
            "pack_pos": pos, "offset": at, "header_len": e["end"] - at, "packed_len": end - at, "crc32": zlib.crc32(body[at:end]), "entry_type": e["type"], "size": e["size"],
            "base_offset": at - e["distance"] if e["distance"] else None, "base_oid": e["base"], "payload": payload,
        })
        at = end
    if at != len(body):
        raise CodecError("ErrMalformedPack", "trailing bytes")
    return rows


def build_pack(entries: list[tuple], fmt: str) -> bytes:
    """A pack of (type, payload) rows; ``("ofs", delta, index of the base)`` and ``("ref", delta, base id)`` for deltas."""
    out, offsets = bytearray(b"PACK" + struct.pack(">II", 2, len(entries))), []
    for kind, payload, *base in entries:
        offsets.append(len(out))
        out += build_entry_header(kind, len(payload))
        if kind == "ofs":
            out += build_distance(offsets[-1] - offsets[base[0]])
        elif kind == "ref":
            out += base[0]
        out += zlib.compress(payload)
    return bytes(out) + sum_of(bytes(out), fmt)


# -- pack index, reverse index, Bloom filter

_MAGIC_IDX, _MAGIC_REV, _MAGIC_BLOOM = b"\xfftOc", b"RIDX", b"IDBL"
_CODE = {"sha1": 1, "sha256": 2}


def build_index(rows: list[tuple[bytes, int, int]], pack_hash: bytes, fmt: str) -> bytes:
    """rows: (id, crc32, offset)."""
    rows = sorted(rows)
    ends = [sum(r[0][0] <= b for r in rows) for b in range(256)]
    large = [r[2] for r in rows if r[2] >= 2**31]
    slot = iter(range(len(large)))
    small = [2**31 | next(slot) if r[2] >= 2**31 else r[2] for r in rows]
    n = len(rows)
    out = _MAGIC_IDX + struct.pack(">I256I", 2, *ends) + b"".join(r[0] for r in rows) + struct.pack(f">{n}I{n}I{len(large)}Q", *(r[1] for r in rows), *small, *large) + pack_hash
    return out + sum_of(out, fmt)


def parse_index(data: bytes, fmt: str) -> tuple[list[tuple[bytes, int, int]], bytes]:
    """(id, crc32, offset) rows by id, and the pack's hash."""
    h = SIZES[fmt]
    if len(data) < 1032 + 2 * h or data[:4] != _MAGIC_IDX or struct.unpack_from(">I", data, 4)[0] != 2:
        raise CodecError("ErrMalformedIndex")
    ends = struct.unpack_from(">256I", data, 8)
    n = ends[-1]
    large = (len(data) - 1032 - n * (h + 8) - 2 * h) / 8
    if any(a > b for a, b in zip(ends, ends[1:], strict=False)) or large < 0 or large != int(large):
        raise CodecError("ErrMalformedIndex")
    at = 1032 + n * h
    crcs, small = struct.unpack_from(f">{n}I", data, at), struct.unpack_from(f">{n}I", data, at + 4 * n)
    wide = struct.unpack_from(f">{int(large)}Q", data, at + 8 * n)
    if sum(s >= 2**31 for s in small) > len(wide) or any(s >= 2**31 and s - 2**31 >= len(wide) for s in small):
        raise CodecError("ErrMalformedIndex")
    offsets = [wide[s - 2**31] if s >= 2**31 else s for s in small]
    return [(data[1032 + i * h : 1032 + (i + 1) * h], crcs[i], offsets[i]) for i in range(n)], data[-2 * h : -h]


def build_reverse(positions: list[int], pack_hash: bytes, fmt: str) -> bytes:
    out = _MAGIC_REV + struct.pack(f">II{len(positions)}I", 1, _CODE[fmt], *positions) + pack_hash
    return out + sum_of(out, fmt)


def parse_reverse(data: bytes, fmt: str) -> tuple[list[int], bytes]:
    h = SIZES[fmt]
    n, odd = divmod(len(data) - 12 - 2 * h, 4)
    if n < 0 or odd or data[:4] != _MAGIC_REV or struct.unpack_from(">II", data, 4) != (1, _CODE[fmt]):
        raise CodecError("ErrMalformedReverseIndex")
    positions = list(struct.unpack_from(f">{n}I", data, 12))
    if any(p >= n for p in positions):
        raise CodecError("ErrMalformedReverseIndex")
    return positions, data[-2 * h : -h]


PROBES, BUCKET_BITS, PER_BUCKET = 8, 512, 48


def bloom_buckets(n: int) -> int:
    """The next power of two of n/48, at most 2**31."""
    need = max(1, -(-n // PER_BUCKET))
    return min(1 << 31, 1 << (need - 1).bit_length())


def bloom_probes(oid: bytes, buckets: int, probes: int = PROBES) -> tuple[int, list[int]]:
    """The bucket (top bits of the id) and bit numbers (9-bit fields that follow)."""
    bits, total = int.from_bytes(oid, "big"), 8 * len(oid)
    lead = buckets.bit_length() - 1
    return bits >> (total - lead), [bits >> (total - lead - 9 * (i + 1)) & 511 for i in range(probes)]


def build_bloom(oids: list[bytes], pack_hash: bytes, fmt: str, buckets: int | None = None, probes: int = PROBES) -> bytes:
    b = buckets or bloom_buckets(len(oids))
    if b & (b - 1) or (b.bit_length() - 1) + 9 * probes > 8 * SIZES[fmt]:
        raise CodecError("ErrInvalidBloomParameters")
    table = [0] * b
    for o in oids:
        k, bits = bloom_probes(o, b, probes)
        for bit in bits:
            table[k] |= 1 << (BUCKET_BITS - 1 - bit)
    out = _MAGIC_BLOOM + struct.pack(">IIIH", 1, _CODE[fmt], b, probes) + bytes(46) + b"".join(x.to_bytes(64, "big") for x in table) + pack_hash
    return out + sum_of(out, fmt)


def parse_bloom(data: bytes, fmt: str, verify: bool = False) -> tuple[int, int, bytes, bytes]:
    """Buckets, probes, the table's bytes and the pack's hash."""
    h = SIZES[fmt]
    if len(data) < 64 + 2 * h or data[:4] != _MAGIC_BLOOM:
        raise CodecError("ErrMalformedBloom")
    version, code, b, k = struct.unpack_from(">IIIH", data, 4)
    bad = version != 1 or code != _CODE[fmt] or not b or b & (b - 1) or not k or (b.bit_length() - 1) + 9 * k > 8 * h or any(data[18:64]) or len(data) != 64 + 64 * b + 2 * h
    if bad or verify and sum_of(data[:-h], fmt) != data[-h:]:
        raise CodecError("ErrMalformedBloom")
    return b, k, data[64 : 64 + 64 * b], data[-2 * h : -h]


def may_contain(table: bytes, buckets: int, probes: int, oid: bytes) -> bool:
    k, bits = bloom_probes(oid, buckets, probes)
    word = int.from_bytes(table[64 * k : 64 * (k + 1)], "big")
    return all(word >> (BUCKET_BITS - 1 - b) & 1 for b in bits)


# -- references and alternates as text

_PACKED = re.compile(rb"([0-9a-fA-F]+) (\S.*)\Z", re.S)


def parse_packed_refs(data: bytes, fmt: str) -> list[tuple[bytes, bytes, str, bytes | None]]:
    """(name, id, peel state, peeled id) rows.  Traits stand on the first line only; a ``^`` line peels the entry above it."""
    if data and not data.endswith(b"\n"):
        raise CodecError("ErrMalformedPackedRefs", "unterminated line")
    n, rows, traits = 2 * SIZES[fmt], [], set()
    for i, line in enumerate(data.split(b"\n")[:-1]):
        if line.startswith(b"#"):
            if i == 0 and line.startswith(b"# pack-refs with:"):
                traits = set(line.removeprefix(b"# pack-refs with:").split())
            continue
        if line.startswith(b"^"):
            if not rows or rows[-1][3] is not None or not re.fullmatch(rb"[0-9a-fA-F]{%d}" % n, line[1:]):
                raise CodecError("ErrMalformedPackedRefs", "peel line")
            rows[-1] = (*rows[-1][:2], "peeled", bytes.fromhex(line[1:].decode()))
            continue
        m = _PACKED.match(line)
        if not m or len(m[1]) != n:
            raise CodecError("ErrMalformedPackedRefs", "entry")
        known = b"fully-peeled" in traits or b"peeled" in traits and m[2].startswith(b"refs/tags/")
        rows.append((m[2], bytes.fromhex(m[1].decode()), "none" if known else "unknown", None))
    if len({r[0] for r in rows}) != len(rows):
        raise CodecError("ErrMalformedPackedRefs", "duplicate")
    return rows


def parse_loose_ref(data: bytes, fmt: str) -> tuple[str, bytes]:
    """("symbolic", target) or ("direct", id)."""
    if data.startswith(b"ref:"):
        return "symbolic", data[4:].strip(b" \t\n\r\v\f")
    m = re.match(rb"([0-9a-fA-F]{%d})(?:[ \t\n\r\v\f]|\Z)" % (2 * SIZES[fmt]), data)
    if not m:
        raise CodecError("ErrInvalidValue")
    return "direct", bytes.fromhex(m[1].decode())


_QUOTED = re.compile(r'"((?:[^"\\]|\\(?:[abfnrtv\\"]|[0-3][0-7]{2}))*)"')
_ESCAPE = re.compile(r"\\([0-3][0-7]{2}|.)", re.S)
_PLAIN = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def parse_alternates(data: bytes, base: str) -> list[bytes]:
    """Paths of an alternates file: comments are skipped, well-quoted lines unquoted, relative paths joined to base."""
    import posixpath

    paths = []
    for line in data.decode("latin-1").split("\n"):
        if not line or line.startswith("#"):
            continue
        m = _QUOTED.match(line)
        path = _ESCAPE.sub(lambda e: chr(int(e[1], 8)) if len(e[1]) == 3 else _PLAIN.get(e[1], e[1]), m[1]) if m else line
        raw = path.encode("latin-1")
        if raw:
            paths.append(raw if raw.startswith(b"/") else posixpath.normpath(posixpath.join(base.encode("utf-8", "surrogateescape"), raw)))
    return paths
