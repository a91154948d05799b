"""Scalar functions of the formats as columns. What Spark has is built in; the
rest runs on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import codec


def _each(data: pd.Series, many: Callable[[list[bytes]], np.ndarray]) -> pd.Series:
    """``many`` over the values that aren't null."""
    out = pd.Series(pd.NA, index=data.index, dtype="Int64")
    there = data.notna()
    out[there] = many([bytes(x) for x in data[there]]).astype(np.int64)
    return out


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of binary values (Spark's own ``crc32`` is another one)."""
    return _each(data, codec.crc32c_many)


@F.pandas_udf(T.LongType())
def bloom_hash(data: pd.Series) -> pd.Series:
    return _each(data, lambda values: codec.hash32_many(values, codec.BloomPolicy.seed))


def mask_crc(crc: Column) -> Column:
    rotated = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(F.lit(0xFFFFFFFF))
    return (rotated + codec.CRC_MASK).bitwiseAND(F.lit(0xFFFFFFFF))


def escaped(data: Column) -> Column:
    """Bytes in printable form, \\xNN for others, without Python: one step over
    the pairs of hex digits."""
    pairs = F.filter(F.split(F.hex(data), "(?<=\\G..)"), lambda p: p != "")
    code = lambda p: F.conv(p, 16, 10).cast("int")
    shown = F.transform(pairs, lambda p: F.when(code(p).between(32, 126), F.char(code(p))).otherwise(F.concat(F.lit("\\x"), F.lower(p))))
    return F.array_join(shown, "")


def leading_decimal(text: Column) -> Column:
    """The number that a text begins with; null without one or beyond 64 bits."""
    digits = F.regexp_extract(text, "^([0-9]+)", 1)
    number = digits.try_cast("decimal(38,0)")
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(38,0)"), number)


