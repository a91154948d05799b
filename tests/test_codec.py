"""Wire formats: golden bytes, round trips, damage."""

import random
import struct

import pytest

from tidemark.functions import keys as K
from tidemark.schema import Corruption
from tidemark.sources import codec as c


def test_crc32c_vectors():
    assert c.crc32c(bytes(32)) == 0x8A9136AA
    assert c.crc32c(b"\xff" * 32) == 0x62A8AB43
    assert c.crc32c(bytes(range(32))) == 0x46DD794E
    assert c.crc32c(bytes(range(31, -1, -1))) == 0x113FDB5C
    assert c.crc32c(b"a") != c.crc32c(b"foo")
    assert c.crc32c(b"hello world") == c.crc32c(b" world", c.crc32c(b"hello "[:5]))
    crc = c.crc32c(b"foo")
    assert crc != c.mask_crc(crc) != c.mask_crc(c.mask_crc(crc))
    assert c.unmask_crc(c.mask_crc(crc)) == crc == c.unmask_crc(c.unmask_crc(c.mask_crc(c.mask_crc(crc))))


def test_varints():
    for value in [0, 1, 127, 128, 255, 16383, 16384, (1 << 32) - 1, 1 << 32, (1 << 64) - 1]:
        data = c.put_varint(value)
        assert c.get_varint(data) == (value, len(data))
        for cut in range(len(data)):
            with pytest.raises(Corruption):
                c.get_varint(data[:cut])
    assert c.put_varint(300) == b"\xac\x02"
    for bad, bits in ((b"\x81\x82\x83\x84\x85\x11", 32), (b"\xff" * 10 + b"\x11", 64)):
        with pytest.raises(Corruption):
            c.get_varint(bad, 0, bits)
    assert c.get_slice(c.put_slice(b"a\0b")) == (b"a\0b", 4)
    with pytest.raises(Corruption):
        c.get_slice(b"\x05ab")


def test_hash_is_stable():
    data = [b"", b"\x62", b"\xc3\x97", b"\xe2\x99\xa5", b"\xe1\x80\xb9\x32"]
    want = [0xBC9F1D34, 0xEF1345C4, 0x5B663814, 0x323C078F, 0xED21633A]
    assert [c.hash32(d, 0xBC9F1D34) for d in data] == want
    assert c.hash32(bytes.fromhex("01c00000000000000000000000000000140000000000040000000014000000182800000000000000020000000000000" + "0"), 0x12345678) == 0xF333DABB


@pytest.mark.parametrize("n", [1, 10, 100, 1000, 10000])
def test_bloom(n):
    policy = c.BloomPolicy(10)
    assert policy.probes == 6
    filter_ = policy.create(b"key%d" % i for i in range(n))
    assert len(filter_) <= n * 10 // 8 + 40
    assert all(policy.may_match(b"key%d" % i, filter_) for i in range(n))
    assert sum(policy.may_match(b"other%d" % i, filter_) for i in range(5000)) <= 100
    assert not policy.may_match(b"x", b"") and not policy.may_match(b"hello", policy.create([]))


def test_log_round_trip_and_blocks():
    rng = random.Random(1)
    records = [bytes([i % 251]) * n for i, n in enumerate([10000, 10000, 2 * c.LOG_BLOCK - 1000, 1, 13716, c.LOG_BLOCK - c.LOG_HEADER, 0])]
    records += [rng.randbytes(rng.randrange(3000)) for _ in range(200)]
    data = c.write_log(records)
    assert [r for _, r in c.read_log(data)] == records
    joined = c.write_log(records[:3])
    assert [r for _, r in c.read_log(joined + c.write_log(records[3:], len(joined)))] == records
    starts = [at for at, _ in c.read_log(data)]
    for k in (0, 1, 2, 5):
        assert [r for _, r in c.read_log(data, starts[k])] == records[k:]
        assert [r for _, r in c.read_log(data, starts[k] + 1)] == records[k + 1 :]
    assert list(c.read_log(data, len(data))) == list(c.read_log(data, len(data) + 5)) == []


def test_log_damage():
    records = [b"a" * 100, b"b" * 40000, b"c" * 50]
    data = bytearray(c.write_log(records))
    for cut in (1, 3, 10, 55):
        assert [r for _, r in c.read_log(bytes(data[:-cut]))] == records[:2]  # a torn tail is silent
    heard = []
    data[20] ^= 1
    got = [r for _, r in c.read_log(bytes(data), report=lambda n, why: heard.append(why))]
    assert got == [records[2]] and heard[0] == "checksum mismatch"


def test_batches():
    ops = [(1, b"foo", b"bar"), (0, b"box", b""), (1, b"", b"\0\xff")]
    data = c.encode_batch(100, ops)
    assert data[:12] == struct.pack("<QI", 100, 3) and c.decode_batch(data) == (100, ops)
    with pytest.raises(Corruption):
        c.decode_batch(data[:-1])
    assert c.decode_batch(data[:-1], strict=False)[1] == ops[:2]
    with pytest.raises(Corruption):
        c.decode_batch(data[:8] + struct.pack("<I", 9) + data[12:])
    assert c.decode_batch(c.encode_batch(7, [])) == (7, [])


def test_internal_keys():
    assert c.encode_key(b"k", 5, 1) == b"k" + (5 << 8 | 1).to_bytes(8, "little")
    assert c.decode_key(c.encode_key(b"", c.MAX_SEQUENCE, 0)) == (b"", c.MAX_SEQUENCE, 0)
    rows = [(b"b", 1, 1), (b"a", 1, 0), (b"a", 1, 1), (b"a", 7, 1)]
    assert sorted(rows, key=lambda r: c.internal_order(*r)) == [(b"a", 7, 1), (b"a", 1, 1), (b"a", 1, 0), (b"b", 1, 1)]
    for bad in (b"short", b"k" + b"\x09" + bytes(7)):
        with pytest.raises(Corruption):
            c.decode_key(bad)


@pytest.mark.parametrize("compression", [c.NO_COMPRESSION, c.SNAPPY])
@pytest.mark.parametrize("bits", [0, 10])
def test_tables(compression, bits):
    policy = c.BloomPolicy(bits) if bits else None
    rows = [(b"key%06d" % i, i + 1, int(i % 7 > 0), b"v" * (i % 90)) for i in range(1500)]
    rows[3:4] = [(b"key000003", 9999, 1, b"new"), (b"key000003", 4, 1, b"old")]
    file = c.write_table(rows, block_size=1024, compression=compression, policy=policy)
    assert list(c.read_table(file)) == rows
    assert c.table_get(file, b"key000003", policy=policy) == (9999, 1, b"new")
    assert c.table_get(file, b"key000003", 10, policy) == (4, 1, b"old")
    assert c.table_get(file, b"key000700", policy=policy)[1] == 0
    assert c.table_get(file, b"key0000030", policy=policy) is None and c.table_get(file, b"zz", policy=policy) is None
    offsets = [c.approximate_offset(file, k) for k in (b"", b"key000100", b"key000900", b"zzz")]
    assert offsets[0] == 0 and offsets == sorted(offsets) and offsets[-1] < len(file)
    broken = bytearray(file)
    broken[10] ^= 255
    with pytest.raises(Corruption):
        list(c.read_table(bytes(broken)))
    assert 0 < len(list(c.read_table(bytes(broken), salvage=True))) < len(rows)
    with pytest.raises(Corruption):
        list(c.read_table(file[:-1]))


def test_blocks_and_footers():
    entries = [(b"abc", b"1"), (b"abcd", b"2"), (b"b", b"")]
    block = c.build_block(entries, 2)
    assert list(c.read_block(block)) == entries
    assert block[-4:] == c.fixed32(2)
    footer = c.encode_footer((1, 2), (300, 4))
    assert len(footer) == 48 and c.decode_footer(footer) == ((1, 2), (300, 4))
    assert footer[-8:] == bytes.fromhex("57fb808b247547db")
    for bad in (footer[:-1], bytes(48)):
        with pytest.raises(Corruption):
            c.decode_footer(bad)


def test_snappy():
    rng = random.Random(2)
    for data in (b"", b"a", b"ab" * 5000, rng.randbytes(70000), b"x" * 200000):
        assert c.snappy_decompress(c.snappy_compress(data)) == data
    with pytest.raises(Corruption):
        c.snappy_decompress(b"\x05\x01\x09")


def test_catalog_edits():
    edit = {"comparator": "bytewise", "log_number": 5, "prev_log_number": 0, "next_file": 300, "last_sequence": 1 << 40, "compact_pointers": [(3, b"k" * 9)], "deleted": [(4, 700)], "added": [(3, 9, 1000, c.encode_key(b"a", 1, 1), c.encode_key(b"z", 9, 0))]}
    data = c.encode_edit(edit)
    assert c.decode_edit(data) == edit
    assert c.decode_edit(b"") == {"compact_pointers": [], "deleted": [], "added": []}
    for cut in range(1, 12):
        with pytest.raises(Corruption):
            c.decode_edit(data[:-cut])
    for bad in (b"\x08", b"\x06\x07\x01"):
        with pytest.raises(Corruption):
            c.decode_edit(bad)


def test_file_names():
    good = {"100.log": ("log", 100), "0.log": ("log", 0), "0.sst": ("table", 0), "0.ldb": ("table", 0), "CURRENT": ("current", 0), "LOCK": ("lock", 0), "MANIFEST-2": ("catalog", 2), "LOG": ("info_log", 0), "LOG.old": ("info_log", 0), "18446744073709551615.log": ("log", (1 << 64) - 1)}
    assert {n: c.parse_file_name(n) for n in good} == good
    for bad in ("", "foo", "foo-dx-100.log", ".log", "manifest", "CURREN", "MANIFEST", "MANIFEST-3x", "LOC", "100", "100.", "100.lop", "18446744073709551616.log"):
        assert c.parse_file_name(bad) is None
    for kind in ("current", "lock", "info_log", "catalog", "log", "table", "temp"):
        assert c.parse_file_name(c.file_name(kind, 7))[0] == kind


def test_key_bounds():
    assert K.shortest_separator(b"abcd", b"abzz") == b"abd" and K.shortest_separator(b"ab", b"abc") == b"ab"
    assert K.shortest_separator(b"abc1", b"abc2") == b"abc1" and K.short_successor(b"abcd") == b"b" and K.short_successor(b"\xff\xff") == b"\xff\xff"
    assert K.prefix_successor(b"a\xff") == b"b" and K.prefix_successor(b"\xff") is None and K.prefix_successor("az") == "a{"
    assert c.escape(b"a\0\xff") == "a\\x00\\xff"
    assert c.consume_decimal("12x") == (12, "x") and c.consume_decimal("x") is None and c.consume_decimal("18446744073709551616") is None


def test_many_values_at_once():
    rng = random.Random(6)
    values = [rng.randbytes(rng.choice([0, 1, 2, 3, 4, 5, 7, 8, 16, 33])) for _ in range(400)] + [rng.randbytes(5000)]
    assert c.hash32_many(values, 0xBC9F1D34).tolist() == [c.hash32(v, 0xBC9F1D34) for v in values]
    assert c.crc32c_many(values).tolist() == [c.crc32c(v) for v in values]
    policy = c.BloomPolicy(12)
    made = policy.create(values[:200])
    assert policy.may_match_many(values, made).tolist() == [policy.may_match(v, made) for v in values]
    assert policy.may_match_many(values[:200], made).all() and policy.may_match_many(values, b"").sum() == 0


class FirstBytes:
    """A policy of one's own: the set of first bytes."""

    name = "first-bytes"

    def create(self, keys):
        return bytes(sorted({k[0] for k in keys if k}))

    def may_match(self, key, filter_):
        return not key or key[0] in filter_


def test_filter_policies_of_ones_own(spark):
    from tidemark.functions import blooms

    table = c.write_table([(b"a%02d" % i, 1, 1, b"v") for i in range(50)] + [(b"c", 1, 1, b"w")], policy=FirstBytes())
    assert c.table_get(table, b"a07", policy=FirstBytes()) == (1, 1, b"v") and c.table_get(table, b"b", policy=FirstBytes()) is None
    assert c.table_get(table, b"c", policy=c.BloomPolicy()) == (1, 1, b"w")  # another policy's filters are passed over
    keys = spark.createDataFrame([("a1", 0), ("a2", 0), ("b1", 1)], "key string, file int")
    filters = blooms.build(keys, policy=FirstBytes())
    probes = spark.createDataFrame([("a9", 0), ("b9", 0), ("b1", 1), ("a1", 1)], "key string, file int")
    got = {(r.key, r.file): r.may_match for r in blooms.probe(filters, probes, FirstBytes()).collect()}
    assert got == {("a9", 0): True, ("b9", 0): False, ("b1", 1): True, ("a1", 1): False}


def test_scalars_of_columns(spark):
    from tidemark.functions import scalars

    rows = [(bytearray(v),) for v in (b"", b"a", b"123456789", b"x" * 100)] + [(None,)]
    got = spark.createDataFrame(rows, "data binary").select("data", scalars.crc32c("data").alias("c"), scalars.bloom_hash("data").alias("h")).collect()
    for r in got:
        assert (r.c, r.h) == ((None, None) if r.data is None else (c.crc32c(bytes(r.data)), c.hash32(bytes(r.data), c.BloomPolicy.seed)))
