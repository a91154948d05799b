"""Schemas, operation codes and exceptions."""

from __future__ import annotations

from pyspark.sql import types as T

DELETE, PUT = 0, 1
MAX_SEQUENCE = (1 << 56) - 1
LEVELS = 7

CHANGELOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
BATCH = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("ord", T.IntegerType()), *CHANGELOG.fields[2:3], *CHANGELOG.fields[:1], *CHANGELOG.fields[3:]])
STATE = T.StructType([CHANGELOG["key"], T.StructField("value", T.BinaryType(), False), CHANGELOG["seq"]])
FILES = T.StructType(
    [
        T.StructField("level", T.IntegerType()),
        T.StructField("number", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("smallest_key", T.BinaryType()),
        T.StructField("smallest_seq", T.LongType()),
        T.StructField("largest_key", T.BinaryType()),
        T.StructField("largest_seq", T.LongType()),
        T.StructField("num_entries", T.LongType()),
        T.StructField("max_seq", T.LongType()),
    ]
)
LEVEL_STATS = T.StructType([T.StructField(n, T.IntegerType() if n == "level" else T.LongType()) for n in ("level", "files", "bytes", "micros", "bytes_read", "bytes_written")])


class StoreError(Exception):
    """Base of all errors; ``str`` begins with the status prefix."""

    prefix = "Unknown: "

    def __init__(self, message: str = ""):
        super().__init__(self.prefix + message)


class NotFound(StoreError):
    prefix = "NotFound: "


class Corruption(StoreError):
    prefix = "Corruption: "


class NotSupported(StoreError):
    prefix = "Not implemented: "


class InvalidArgument(StoreError):
    prefix = "Invalid argument: "


class IOFailure(StoreError):
    prefix = "IO error: "
