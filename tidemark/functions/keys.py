"""Order-preserving binary keys, bounds of prefixes, and other key orders."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode_int(column: Column) -> Column:
    """Signed 64-bit integers as 8 big-endian bytes in numeric order: the sign
    bit is turned."""
    turned = column.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.lpad(F.hex(turned), 16, "0"))


def encode_double(column: Column) -> Column:
    """Doubles in numeric order: the sign bit is turned for positive numbers,
    all bits for negative ones."""
    bits = _double_bits(column)
    return F.when(bits >= 0, F.unhex(F.lpad(F.hex(bits.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))).otherwise(F.unhex(F.lpad(F.hex(F.bitwise_not(bits)), 16, "0")))


def _double_bits(column: Column) -> Column:
    """IEEE 754 bits from arithmetic on exponent and fraction."""
    x = F.abs(column.cast("double"))
    tiny = float.fromhex("0x1p-1022")
    power = F.floor(F.log2(x))
    # log2 may be off by one at powers of two
    power = F.when(F.pow(F.lit(2.0), power) > x, power - 1).when(F.pow(F.lit(2.0), power + 1) <= x, power + 1).otherwise(power)
    fraction = ((x / F.pow(F.lit(2.0), power) - 1.0) * float(1 << 52)).cast("long")
    normal = F.shiftleft((power + 1023).cast("long"), 52) + fraction
    small = (x / tiny * float(1 << 52)).cast("long")
    size = F.when(x == 0, F.lit(0).cast("long")).when(x == float("inf"), F.lit(0x7FF << 52)).when(x < tiny, small).otherwise(normal)
    return F.when(column.cast("double") < 0, size.bitwiseOR(F.lit(-(1 << 63)))).otherwise(size)


def encode_text(column: Column) -> Column:
    """UTF-8 with 00 escaped as 00 FF and ended by 00 00, so that shorter texts
    come first and columns can follow."""
    raw = F.hex(F.encode(column.cast("string"), "UTF-8"))
    pairs = F.regexp_replace(raw, "(..)", "$1 ")
    return F.unhex(F.concat(F.regexp_replace(F.regexp_replace(pairs, "00 ", "00 FF "), " ", ""), F.lit("0000")))


def composite(*columns: Column) -> Column:
    """Concatenation of encoded parts: ordered as the columns are."""
    return F.concat(*columns)


def prefix_successor(prefix: str | bytes):
    """The least key above all keys that begin with ``prefix``; None if there is
    none (only largest units, or nothing)."""
    if isinstance(prefix, str):
        for cut in range(len(prefix), 0, -1):
            last = ord(prefix[cut - 1])
            if last < 0x10FFFF:
                following = last + 1
                return prefix[: cut - 1] + chr(0xE000 if 0xD800 <= following < 0xE000 else following)
        return None
    stripped = bytes(prefix).rstrip(b"\xff")
    return stripped[:-1] + bytes([stripped[-1] + 1]) if stripped else None


def shortest_separator(start: bytes, limit: bytes) -> bytes:
    """A short key k with start <= k < limit; ``start`` where none is shorter."""
    common = next((i for i, (a, b) in enumerate(zip(start, limit, strict=False)) if a != b), None)
    if common is None:
        return start  # one is a prefix of the other
    raised = start[common] + 1
    return start[:common] + bytes([raised]) if raised < limit[common] else start


def short_successor(key: bytes) -> bytes:
    """A short key at or above ``key``."""
    at = next((i for i, b in enumerate(key) if b != 0xFF), None)
    return key if at is None else key[:at] + bytes([key[at] + 1])


@dataclass(frozen=True)
class Comparator:
    """An order of keys, as a sort key: ``column`` makes it of a key column (for
    Spark), ``value`` of a key's bytes (for the driver's file ranges). Both must
    order alike. Keys with equal sort keys are ordered by their bytes, so an
    order never makes two keys one. A black-box comparison of two keys can't be
    distributed and isn't offered."""

    name: str
    column: Callable[[Column], Column] | None = None  # None: the bytes themselves
    value: Callable[[bytes], Any] | None = None

    def order(self, key: Column) -> Column:
        return key if self.column is None else F.struct(self.column(key), key)

    def of(self, key: bytes):
        return key if self.value is None else (self.value(key), key)


def ordered_by(rows: DataFrame, order: Callable[[Column], Column]) -> tuple[DataFrame, str]:
    """``rows`` and the name of a column that they are ordered by: ``key``, or
    a new one. A sort evaluates an expression anew for both rows of each
    comparison, so what it sorts by must be a column."""
    key = F.col("key")
    by = order(key)
    return (rows, "key") if by is key else (rows.withColumn("__order", by), "__order")


def numeric_suffix(key: Column) -> Column:
    """Orders keys by the number they end with, then by the key."""
    return F.coalesce(F.regexp_extract(key.cast("string"), r"([0-9]{1,18})$", 1).try_cast("long"), F.lit(-1))


def _numeric_suffix(key: bytes) -> int:
    found = re.search(rb"([0-9]{1,18})$", key)
    return int(found[1]) if found else -1


def reverse(key: Column) -> Column:
    """Turned bytes and an end beyond any byte: larger keys come first."""
    return F.concat(F.translate(F.hex(key), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def _reverse(key: bytes) -> str:
    return key.hex().upper().translate(str.maketrans("0123456789ABCDEF", "FEDCBA9876543210")) + "G"


#: Orders by name. A store keeps its order's name and can't be opened with another.
COMPARATORS: dict[str, Comparator] = {}


def register_comparator(comparator: Comparator) -> None:
    """Make an order known by its name; a name can't be given twice to
    different orders."""
    if COMPARATORS.setdefault(comparator.name, comparator) != comparator:
        raise ValueError(f"comparator {comparator.name} is known already")


for _known in (Comparator("bytewise"), Comparator("numeric_suffix", numeric_suffix, _numeric_suffix), Comparator("reverse", reverse, _reverse)):
    register_comparator(_known)
