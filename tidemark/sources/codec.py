"""Pure functions for the wire formats of logs, tables, catalogs and batches.

Nothing here imports Spark: Python data sources and tests use it alike.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np

from ..schema import DELETE, MAX_SEQUENCE, PUT, Corruption

# Fixed values of the formats.
LOG_BLOCK = 32768
LOG_HEADER = 7
ZERO, FULL, FIRST, MIDDLE, LAST = range(5)
BATCH_HEADER = 12
BLOCK_TRAILER = 5
FOOTER = 48
TABLE_MAGIC = 0xDB4775248B80FB57
CRC_MASK = 0xA282EAD8
CRC_POLYNOMIAL = 0x82F63B78
FILTER_BASE_LG = 11
COMPARATOR, LOG_NUMBER, NEXT_FILE, LAST_SEQUENCE, COMPACT_POINTER, DELETED_FILE, NEW_FILE, PREV_LOG_NUMBER = 1, 2, 3, 4, 5, 6, 7, 9
NO_COMPRESSION, SNAPPY = 0, 1


# ------------------------------------------------------------------ integers
def put_varint(value: int) -> bytes:
    out = bytearray()
    while value >= 128:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def get_varint(data: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """(value, next place). At most 5 bytes for 32 bits, 10 for 64; longer or
    cut-off ones are corrupt."""
    value = 0
    for k in range(5 if bits == 32 else 10):
        if at + k >= len(data):
            raise Corruption("truncated varint")
        value |= (data[at + k] & 127) << 7 * k
        if data[at + k] < 128:
            return value & (1 << bits) - 1, at + k + 1
    raise Corruption("varint too long")


def put_slice(data: bytes) -> bytes:
    return put_varint(len(data)) + data


def get_slice(data: bytes, at: int = 0) -> tuple[bytes, int]:
    size, at = get_varint(data, at, 32)
    if at + size > len(data):
        raise Corruption("truncated slice")
    return data[at : at + size], at + size


def fixed32(value: int) -> bytes:
    return struct.pack("<I", value & 0xFFFFFFFF)


def fixed64(value: int) -> bytes:
    return struct.pack("<Q", value & (1 << 64) - 1)


# ----------------------------------------------------------------- checksums
def _crc_tables(n: int = 8) -> list[list[int]]:
    tables = [[0] * 256 for _ in range(n)]
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (CRC_POLYNOMIAL if c & 1 else 0)
        tables[0][i] = c
    for k in range(1, n):
        for i in range(256):
            tables[k][i] = tables[k - 1][i] >> 8 ^ tables[0][tables[k - 1][i] & 255]
    return tables


_TABLES = _crc_tables()


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C, eight bytes a step; ``crc`` goes on from an earlier part."""
    t0, t1, t2, t3, t4, t5, t6, t7 = _TABLES
    c = crc ^ 0xFFFFFFFF
    whole = len(data) // 8
    for low, high in struct.iter_unpack("<II", data[: whole * 8]):
        low ^= c
        c = t7[low & 255] ^ t6[low >> 8 & 255] ^ t5[low >> 16 & 255] ^ t4[low >> 24] ^ t3[high & 255] ^ t2[high >> 8 & 255] ^ t1[high >> 16 & 255] ^ t0[high >> 24]
    for b in data[whole * 8 :]:
        c = c >> 8 ^ t0[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def mask_crc(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + CRC_MASK) & 0xFFFFFFFF


def unmask_crc(masked: int) -> int:
    rotated = masked - CRC_MASK & 0xFFFFFFFF
    return (rotated >> 17 | rotated << 15) & 0xFFFFFFFF


def hash32(data: bytes, seed: int) -> int:
    """The formats' 32-bit hash: words of 4 bytes are added and multiplied."""
    m, mask = 0xC6A4A793, 0xFFFFFFFF
    h = seed ^ len(data) * m & mask
    words = len(data) // 4 * 4
    for (w,) in struct.iter_unpack("<I", data[:words]):
        h = (h + w) * m & mask
        h ^= h >> 16
    if words < len(data):
        h = (h + int.from_bytes(data[words:], "little")) * m & mask
        h ^= h >> 24
    return h


#: Values of one length from which on columns of bytes are worked on at once.
_MANY = 8


def _by_length(values: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, bytes as rows) of the values of each length."""
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, np.frombuffer(b"".join([values[i] for i in at.tolist()]), dtype=np.uint8).reshape(len(at), size)


def hash32_many(values: list[bytes], seed: int) -> np.ndarray:
    """``hash32`` of many values: values of one length together, a word of each
    a step."""
    out = np.empty(len(values), dtype=np.uint32)
    m = np.uint32(0xC6A4A793)
    for size, at, rows in _by_length(values):
        if len(at) < _MANY:
            out[at] = [hash32(values[i], seed) for i in at.tolist()]
            continue
        h = np.full(len(at), seed ^ size * int(m) & 0xFFFFFFFF, dtype=np.uint32)
        whole = size // 4
        words = np.ascontiguousarray(rows[:, : 4 * whole]).view("<u4")
        for k in range(whole):
            h = (h + words[:, k]) * m
            h ^= h >> np.uint32(16)
        if size % 4:
            rest = np.zeros((len(at), 4), dtype=np.uint8)
            rest[:, : size % 4] = rows[:, 4 * whole :]
            h = (h + rest.view("<u4")[:, 0]) * m
            h ^= h >> np.uint32(24)
        out[at] = h
    return out


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """``crc32c`` of many values: values of one length together, a byte of each
    a step."""
    table, out = np.array(_TABLES[0], dtype=np.uint32), np.empty(len(values), dtype=np.uint32)
    for size, at, rows in _by_length(values):
        if len(at) < _MANY:
            out[at] = [crc32c(values[i]) for i in at.tolist()]
            continue
        c = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(size):
            c = c >> np.uint32(8) ^ table[(c ^ rows[:, k]) & np.uint32(255)]
        out[at] = c ^ np.uint32(0xFFFFFFFF)
    return out


# --------------------------------------------------------------------- bloom
class FilterPolicy(Protocol):
    """What a table's filters need of a policy. ``create`` makes a filter of a
    table's keys; ``may_match`` may be wrong only by saying yes."""

    name: str

    def create(self, keys: Iterable[bytes]) -> bytes: ...

    def may_match(self, key: bytes, filter_: bytes) -> bool: ...


class BloomPolicy:
    """Membership filter over user keys, ``bits`` a key."""

    name = "bloom"
    seed = 0xBC9F1D34

    def __init__(self, bits: int = 10):
        self.bits = bits
        self.probes = min(30, max(1, int(bits * 0.69)))

    def may_match_many(self, keys: list[bytes], filter_: bytes) -> np.ndarray:
        """``may_match`` of many keys with one filter."""
        if len(filter_) < 2 or filter_[-1] > 30:
            return np.full(len(keys), len(filter_) >= 2)
        h = hash32_many(keys, self.seed)
        steps = (h >> np.uint32(17)) | (h << np.uint32(15))
        on = np.unpackbits(np.frombuffer(filter_[:-1], np.uint8), bitorder="little").astype(bool)
        good = np.ones(len(keys), dtype=bool)
        for k in range(filter_[-1]):
            good &= on[(h + np.uint32(k) * steps) % np.uint32(len(on))]
        return good

    def create(self, keys: Iterable[bytes]) -> bytes:
        hashes = hash32_many(list(keys), self.seed)
        size = (max(64, len(hashes) * self.bits) + 7) // 8
        steps = (hashes >> np.uint32(17)) | (hashes << np.uint32(15))
        on = np.zeros(size * 8, dtype=np.uint8)
        for k in range(self.probes):
            on[(hashes + np.uint32(k) * steps) % np.uint32(size * 8)] = 1
        return np.packbits(on, bitorder="little").tobytes() + bytes([self.probes])

    def may_match(self, key: bytes, filter_: bytes) -> bool:
        if len(filter_) < 2:
            return False
        probes = filter_[-1]
        if probes > 30:
            return True  # a later encoding
        h = hash32(key, self.seed)
        step = (h >> 17 | h << 15) & 0xFFFFFFFF
        size = (len(filter_) - 1) * 8
        at = ((h + k * step & 0xFFFFFFFF) % size for k in range(probes))
        return all(filter_[i >> 3] >> (i & 7) & 1 for i in at)


def filter_block(groups: list[tuple[int, list[bytes]]], policy: FilterPolicy) -> bytes:
    """Filters for data blocks (offset, keys): one for each 2 KiB of offsets."""
    at: dict[int, list[bytes]] = {}
    for offset, keys in groups:
        at.setdefault(offset >> FILTER_BASE_LG, []).extend(keys)
    out, offsets = bytearray(), []
    for index in range(max(at) + 1 if at else 0):
        offsets.append(len(out))
        if at.get(index):
            out += policy.create(at[index])
    return bytes(out) + b"".join(map(fixed32, offsets)) + fixed32(len(out)) + bytes([FILTER_BASE_LG])


def filter_may_match(block: bytes, offset: int, key: bytes, policy: FilterPolicy) -> bool:
    if len(block) < 5:
        return True
    start = struct.unpack_from("<I", block, len(block) - 5)[0]
    index = offset >> block[-1]
    if start > len(block) - 5 or index >= (len(block) - 5 - start) // 4:
        return True  # errors are potential matches
    a, b = struct.unpack_from("<II", block, start + 4 * index)
    return a < b <= start and policy.may_match(key, block[a:b])


# -------------------------------------------------------------------- snappy
def snappy_decompress(data: bytes) -> bytes:
    size, at = get_varint(data, 0, 32)
    out = bytearray()
    try:
        while at < len(data):
            tag = data[at]
            at += 1
            if tag & 3 == 0:
                n = (tag >> 2) + 1
                if n > 60:
                    more = n - 60
                    n, at = int.from_bytes(data[at : at + more], "little") + 1, at + more
                if at + n > len(data):
                    raise Corruption("truncated literal")
                out += data[at : at + n]
                at += n
                continue
            if tag & 3 == 1:
                n, back, at = (tag >> 2 & 7) + 4, tag >> 5 << 8 | data[at], at + 1
            else:
                width = 2 if tag & 3 == 2 else 4
                n, back, at = (tag >> 2) + 1, int.from_bytes(data[at : at + width], "little"), at + width
            if not 0 < back <= len(out):
                raise Corruption("bad copy offset")
            for _ in range(n):
                out.append(out[-back])
    except IndexError:
        raise Corruption("truncated snappy data") from None
    if len(out) != size:
        raise Corruption("snappy length differs")
    return bytes(out)


def snappy_compress(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.compress(data, codec="snappy", asbytes=True)


# ----------------------------------------------------------------- log files
def write_log(records: Iterable[bytes], offset: int = 0) -> bytes:
    """Records as fragments in 32 KiB blocks; ``offset`` is the length of the
    file that is gone on with."""
    out = bytearray()
    used = offset % LOG_BLOCK
    for record in records:
        rest, begin = memoryview(record), True
        while begin or rest:
            room = LOG_BLOCK - used
            if room < LOG_HEADER:
                out += b"\0" * room
                used, room = 0, LOG_BLOCK
            part, rest = rest[: room - LOG_HEADER], rest[room - LOG_HEADER :]
            kind = (FULL if not rest else FIRST) if begin else (LAST if not rest else MIDDLE)
            body = bytes([kind]) + part
            out += fixed32(mask_crc(crc32c(body))) + struct.pack("<H", len(part)) + body
            used += LOG_HEADER + len(part)
            begin = False
    return bytes(out)


def log_fragments(data: bytes, start: int = 0) -> Iterator[tuple[int, int, int, bool, bytes]]:
    """(offset, type, length, crc_ok, payload) of physical records. Zero-filled
    space is skipped; a bad checksum or length drops the rest of its block; a
    torn tail ends the file silently."""
    for block in range(start - start % LOG_BLOCK, len(data), LOG_BLOCK):
        end, at = min(block + LOG_BLOCK, len(data)), block
        while at + LOG_HEADER <= end:
            masked, size, kind = struct.unpack_from("<IHB", data, at)
            if kind == ZERO and size == 0:
                break
            if at + LOG_HEADER + size > end:
                if end % LOG_BLOCK == 0:
                    yield at, kind, size, False, b""
                break
            payload = data[at + LOG_HEADER : at + LOG_HEADER + size]
            good = crc32c(data[at + 6 : at + LOG_HEADER + size]) == unmask_crc(masked)
            yield at, kind, size, good, payload
            if not good:
                break
            at += LOG_HEADER + size


def read_log(data: bytes, initial_offset: int = 0, report=None) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of whole records that begin at or after an offset;
    ``report(bytes, reason)`` hears of what is dropped."""
    report = report or (lambda size, reason: None)
    inside = initial_offset % LOG_BLOCK
    first = initial_offset - inside + (LOG_BLOCK if inside > LOG_BLOCK - 6 else 0)
    parts: list[bytes] = []
    began, resync, expected = -1, initial_offset > 0, None
    for at, kind, size, good, payload in log_fragments(data, first):
        if expected is not None and at != expected and parts and at - expected >= LOG_HEADER:
            report(sum(map(len, parts)), "a record has no last fragment")
            parts = []
        expected = at + LOG_HEADER + size
        if not good:
            report(size, "checksum mismatch" if payload else "bad record length")
            parts, began = [], -1
            continue
        if resync:
            if kind == MIDDLE or kind == LAST:
                resync = kind == MIDDLE
                continue
            resync = False
        if at < initial_offset:
            parts, began = [], -1
            continue
        if kind in (FULL, FIRST):
            if parts:
                report(sum(map(len, parts)), "a record has no last fragment")
            parts, began = [payload], at
            if kind == FULL:
                yield at, payload
                parts, began = [], -1
        elif kind in (MIDDLE, LAST):
            if began < 0:
                report(size, "a fragment has no first one before it")
                continue
            parts.append(payload)
            if kind == LAST:
                yield began, b"".join(parts)
                parts, began = [], -1
        else:
            report(size, f"fragment of kind {kind}")
            parts, began = [], -1


# ------------------------------------------------------------- write batches
def encode_batch(sequence: int, ops: Iterable[tuple[int, bytes, bytes]]) -> bytes:
    ops = list(ops)
    body = b"".join(bytes([op]) + put_slice(k) + (put_slice(v) if op == PUT else b"") for op, k, v in ops)
    return fixed64(sequence) + fixed32(len(ops)) + body


def decode_batch(data: bytes, strict: bool = True) -> tuple[int, list[tuple[int, bytes, bytes]]]:
    """(sequence, operations). Not strict: what was read before damage counts."""
    ops: list[tuple[int, bytes, bytes]] = []
    if len(data) < BATCH_HEADER:
        raise Corruption("batch shorter than its header")
    sequence, count = struct.unpack_from("<QI", data)
    at = BATCH_HEADER
    try:
        while at < len(data):
            op, at = data[at], at + 1
            if op not in (PUT, DELETE):
                raise Corruption("unknown operation in batch")
            key, at = get_slice(data, at)
            value, at = get_slice(data, at) if op == PUT else (b"", at)
            ops.append((op, key, value))
        if len(ops) != count:
            raise Corruption("batch has another count")
    except Corruption:
        if strict:
            raise
    return sequence, ops


# ------------------------------------------------------------- internal keys
def pack_tag(sequence: int, op: int) -> int:
    return sequence << 8 | op


def encode_key(key: bytes, sequence: int, op: int) -> bytes:
    if not 0 <= sequence <= MAX_SEQUENCE:
        raise Corruption("sequence out of range")
    return key + fixed64(pack_tag(sequence, op))


def decode_key(data: bytes) -> tuple[bytes, int, int]:
    if len(data) < 8:
        raise Corruption("internal key too short")
    tag = struct.unpack_from("<Q", data, len(data) - 8)[0]
    if tag & 255 > PUT:
        raise Corruption("bad operation in key")
    return data[:-8], tag >> 8, tag & 255


def internal_order(key: bytes, sequence: int, op: int) -> tuple:
    """Sort key: user key ascending, then newest first."""
    return key, -pack_tag(sequence, op)


# -------------------------------------------------------------------- blocks
def encode_handle(offset: int, size: int) -> bytes:
    return put_varint(offset) + put_varint(size)


def decode_handle(data: bytes, at: int = 0) -> tuple[int, int, int]:
    offset, at = get_varint(data, at)
    size, at = get_varint(data, at)
    return offset, size, at


def encode_footer(metaindex: tuple[int, int], index: tuple[int, int]) -> bytes:
    return (encode_handle(*metaindex) + encode_handle(*index)).ljust(40, b"\0") + fixed64(TABLE_MAGIC)


def decode_footer(data: bytes) -> tuple[tuple[int, int], tuple[int, int]]:
    if len(data) < FOOTER or struct.unpack_from("<Q", data, len(data) - 8)[0] != TABLE_MAGIC:
        raise Corruption("not a table (bad magic number)")
    data = data[-FOOTER:]
    a, b, at = decode_handle(data)
    c, d, _ = decode_handle(data, at)
    return (a, b), (c, d)


def build_block(entries: Iterable[tuple[bytes, bytes]], restart_interval: int = 16) -> bytes:
    out, restarts, before = bytearray(), [], b""
    n = 0
    for key, value in entries:
        shared = 0
        if n % restart_interval == 0:
            restarts.append(len(out))
        else:
            limit = min(len(key), len(before))
            while shared < limit and key[shared] == before[shared]:
                shared += 1
        out += put_varint(shared) + put_varint(len(key) - shared) + put_varint(len(value)) + key[shared:] + value
        before, n = key, n + 1
    return bytes(out) + b"".join(map(fixed32, restarts or [0])) + fixed32(len(restarts) or 1)


def read_block(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    if len(block) < 4:
        raise Corruption("bad block contents")
    n = struct.unpack_from("<I", block, len(block) - 4)[0]
    end = len(block) - 4 * (n + 1)
    if end < 0:
        raise Corruption("bad block contents")
    at, key = 0, b""
    while at < end:
        shared, at = get_varint(block, at, 32)
        own, at = get_varint(block, at, 32)
        size, at = get_varint(block, at, 32)
        if shared > len(key) or at + own + size > end:
            raise Corruption("bad entry in block")
        key = key[:shared] + block[at : at + own]
        at += own
        yield key, block[at : at + size]
        at += size


def seal_block(raw: bytes, compression: int = NO_COMPRESSION) -> bytes:
    """Block with its trailer: kind and checksum. Compression is kept only
    where it saves an eighth."""
    kind = NO_COMPRESSION
    if compression == SNAPPY:
        small = snappy_compress(raw)
        if len(small) < len(raw) - len(raw) // 8:
            raw, kind = small, SNAPPY
    return raw + bytes([kind]) + fixed32(mask_crc(crc32c(raw + bytes([kind]))))


def open_block(file: bytes, offset: int, size: int, verify: bool = True) -> bytes:
    raw = file[offset : offset + size + BLOCK_TRAILER]
    if len(raw) < size + BLOCK_TRAILER:
        raise Corruption("truncated block read")
    kind, masked = raw[size], struct.unpack_from("<I", raw, size + 1)[0]
    if verify and crc32c(raw[: size + 1]) != unmask_crc(masked):
        raise Corruption("block checksum mismatch")
    if kind == NO_COMPRESSION:
        return raw[:size]
    if kind == SNAPPY:
        return snappy_decompress(raw[:size])
    raise Corruption("bad block type")


# -------------------------------------------------------------------- tables
def write_table(entries: Iterable[tuple[bytes, int, int, bytes]], block_size: int = 4096, restart_interval: int = 16, compression: int = SNAPPY, policy: FilterPolicy | None = None) -> bytes:
    """A table file from (key, sequence, op, value) in internal order."""
    from ..functions.keys import short_successor, shortest_separator

    out = bytearray()
    index: list[tuple[bytes, bytes]] = []
    groups: list[tuple[int, list[bytes]]] = []
    block: list[tuple[bytes, bytes]] = []
    size, keys, pending = 0, [], None

    def flush() -> tuple[bytes, tuple[int, int]]:
        sealed = seal_block(build_block(block, restart_interval), compression)
        handle = len(out), len(sealed) - BLOCK_TRAILER
        groups.append((len(out), list(keys)))
        out.extend(sealed)
        return block[-1][0], handle

    def between(last: bytes, following: bytes | None) -> bytes:
        user = last[:-8]
        short = shortest_separator(user, following[:-8]) if following is not None else short_successor(user)
        return short + fixed64(pack_tag(MAX_SEQUENCE, PUT)) if len(short) < len(user) and short > user else last

    for key, sequence, op, value in entries:
        internal = encode_key(key, sequence, op)
        if pending:
            index.append((between(pending[0], internal), encode_handle(*pending[1])))
            pending = None
        block.append((internal, value))
        keys.append(key)
        size += len(internal) + len(value) + 3
        if size >= block_size:
            pending = flush()
            block, size, keys = [], 0, []
    if block:
        pending = flush()
    if pending:
        index.append((between(pending[0], None), encode_handle(*pending[1])))
    meta = []
    if policy:
        raw = filter_block(groups, policy)
        meta.append((b"filter." + policy.name.encode(), encode_handle(len(out), len(raw))))
        out += seal_block(raw)
    handles = []
    for part in (meta, index):
        sealed = seal_block(build_block(part, 1 if part is index else restart_interval), compression)
        handles.append((len(out), len(sealed) - BLOCK_TRAILER))
        out += sealed
    return bytes(out) + encode_footer(*handles)


def read_table(file: bytes, verify: bool = True, salvage: bool = False) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(key, sequence, op, value) in file order. ``salvage`` passes over blocks
    that can't be read instead of raising."""
    _, index = decode_footer(file)
    for _, handle in read_block(open_block(file, *index, verify)):
        offset, size, _ = decode_handle(handle)
        try:
            rows = [(*decode_key(k), v) for k, v in read_block(open_block(file, offset, size, verify))]
        except Corruption:
            if not salvage:
                raise
            continue
        yield from rows


def table_get(file: bytes, key: bytes, sequence: int = MAX_SEQUENCE, policy: FilterPolicy | None = None, verify: bool = False) -> tuple[int, int, bytes] | None:
    """Newest (sequence, op, value) of a key at or below a sequence number: the
    index names one block, the filter may spare it."""
    metaindex, index = decode_footer(file)
    filters = None
    if policy:
        for name, handle in read_block(open_block(file, *metaindex, verify)):
            if name == b"filter." + policy.name.encode():
                filters = open_block(file, *decode_handle(handle)[:2], verify)
    target = internal_order(key, sequence, PUT)
    for last, handle in read_block(open_block(file, *index, verify)):
        if internal_order(*decode_key(last)) < target:
            continue
        offset, size, _ = decode_handle(handle)
        if filters is not None and not filter_may_match(filters, offset, key, policy):
            return None
        for k, v in read_block(open_block(file, offset, size, verify)):
            found = decode_key(k)
            if internal_order(*found) >= target:
                return (found[1], found[2], v) if found[0] == key else None
    return None


def approximate_offset(file: bytes, key: bytes) -> int:
    """File offset near which a key's versions start."""
    metaindex, index = decode_footer(file)
    target = internal_order(key, MAX_SEQUENCE, PUT)
    for last, handle in read_block(open_block(file, *index, False)):
        if internal_order(*decode_key(last)) >= target:
            return decode_handle(handle)[0]
    return metaindex[0]


# ------------------------------------------------------------- catalog edits
def encode_edit(edit: dict) -> bytes:
    """A catalog edit: comparator, log_number, prev_log_number, next_file,
    last_sequence, compact_pointers, deleted, added; absent ones are left out."""
    out = bytearray()
    if edit.get("comparator") is not None:
        out += put_varint(COMPARATOR) + put_slice(edit["comparator"].encode())
    for name, tag in (("log_number", LOG_NUMBER), ("prev_log_number", PREV_LOG_NUMBER), ("next_file", NEXT_FILE), ("last_sequence", LAST_SEQUENCE)):
        if edit.get(name) is not None:
            out += put_varint(tag) + put_varint(edit[name])
    for level, key in edit.get("compact_pointers", ()):
        out += put_varint(COMPACT_POINTER) + put_varint(level) + put_slice(key)
    for level, number in edit.get("deleted", ()):
        out += put_varint(DELETED_FILE) + put_varint(level) + put_varint(number)
    for level, number, size, smallest, largest in edit.get("added", ()):
        out += put_varint(NEW_FILE) + put_varint(level) + put_varint(number) + put_varint(size) + put_slice(smallest) + put_slice(largest)
    return bytes(out)


def _level(data: bytes, at: int) -> tuple[int, int]:
    value, at = get_varint(data, at, 32)
    if value >= 7:
        raise Corruption("an edit names a level that isn't there")
    return value, at


#: By tag: the edit's entry, whether it is a list, and how its fields are read.
_FIELDS = {
    COMPARATOR: ("comparator", False, (get_slice,)),
    LOG_NUMBER: ("log_number", False, (get_varint,)),
    PREV_LOG_NUMBER: ("prev_log_number", False, (get_varint,)),
    NEXT_FILE: ("next_file", False, (get_varint,)),
    LAST_SEQUENCE: ("last_sequence", False, (get_varint,)),
    COMPACT_POINTER: ("compact_pointers", True, (_level, get_slice)),
    DELETED_FILE: ("deleted", True, (_level, get_varint)),
    NEW_FILE: ("added", True, (_level, get_varint, get_varint, get_slice, get_slice)),
}


def decode_edit(data: bytes) -> dict:
    edit: dict = {name: [] for name, many, _ in _FIELDS.values() if many}
    at = 0
    while at < len(data):
        tag, at = get_varint(data, at, 32)
        if tag not in _FIELDS:
            raise Corruption(f"an edit has a field {tag}")
        name, many, readers = _FIELDS[tag]
        values = []
        for read in readers:
            value, at = read(data, at)
            values.append(value)
        if many:
            edit[name].append(tuple(values))
        else:
            edit[name] = values[0].decode() if tag == COMPARATOR else values[0]
    return edit


# ---------------------------------------------------------------- file names
_NAMES = (("current", re.compile("CURRENT")), ("lock", re.compile("LOCK")), ("info_log", re.compile(r"LOG(?:\.old)?")), ("catalog", re.compile(r"MANIFEST-(\d+)")), ("log", re.compile(r"(\d+)\.log")), ("table", re.compile(r"(\d+)\.(?:ldb|sst)")), ("temp", re.compile(r"(\d+)\.dbtmp")))


def parse_file_name(name: str) -> tuple[str, int] | None:
    """(kind, number) of a file in a store's folder, None for others."""
    for kind, pattern in _NAMES:
        m = pattern.fullmatch(name)
        if m:
            number = int(m[1]) if pattern.groups else 0
            return (kind, number) if number < 1 << 64 else None
    return None


def file_name(kind: str, number: int = 0) -> str:
    return {"current": "CURRENT", "lock": "LOCK", "info_log": "LOG", "catalog": f"MANIFEST-{number:06d}", "log": f"{number:06d}.log", "table": f"{number:06d}.ldb", "legacy_table": f"{number:06d}.sst", "temp": f"{number:06d}.dbtmp"}[kind]


def escape(data: bytes) -> str:
    """Printable form: other bytes as \\xNN."""
    return "".join(chr(b) if 32 <= b <= 126 else f"\\x{b:02x}" for b in data)


def consume_decimal(text: str) -> tuple[int, str] | None:
    """(number, rest) of leading digits; None without digits or beyond 64 bits."""
    m = re.match(r"[0-9]+", text)
    return (int(m[0]), text[m.end() :]) if m and int(m[0]) < 1 << 64 else None
