"""Ordered write batches, on the driver and as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import BATCH, DELETE, PUT
from ..sources import codec


class WriteBatch:
    """Puts and deletions in order; later ones of a key win."""

    def __init__(self) -> None:
        self.ops: list[tuple[int, bytes, bytes]] = []

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.ops.append((DELETE, bytes(key), b""))
        return self

    def clear(self) -> None:
        self.ops.clear()

    def append(self, other: WriteBatch) -> WriteBatch:
        self.ops.extend(other.ops)
        return self

    def __len__(self) -> int:
        return len(self.ops)

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes]]:
        return iter(self.ops)

    def iterate(self, put: Callable[[bytes, bytes], None], deleted: Callable[[bytes], None]) -> None:
        for op, key, value in self.ops:
            put(key, value) if op == PUT else deleted(key)

    def approximate_size(self) -> int:
        return len(self.encode(0))

    def encode(self, sequence: int) -> bytes:
        return codec.encode_batch(sequence, self.ops)

    @classmethod
    def decode(cls, data: bytes, strict: bool = True) -> tuple[int, WriteBatch]:
        sequence, ops = codec.decode_batch(data, strict)
        batch = cls()
        batch.ops = ops
        return sequence, batch

    def to_df(self, spark: SparkSession, batch_id: int = 0) -> DataFrame:
        return spark.createDataFrame([(batch_id, i, op, bytearray(k), bytearray(v)) for i, (op, k, v) in enumerate(self.ops)], BATCH)


def append(first: DataFrame, second: DataFrame, by: str | None = None) -> DataFrame:
    """Two batches one after another: the second's ordinals are shifted. With
    ``by``, a pair of batches for each value of that column."""
    if by is not None:
        shift = first.groupBy(by).agg((F.max("ord") + 1).alias("__shift"))
        return first.unionByName(second.join(shift, by, "left").withColumn("ord", F.col("ord") + F.coalesce("__shift", F.lit(0))).select(*first.columns))
    shift = first.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("__shift"))
    return first.unionByName(second.crossJoin(F.broadcast(shift)).withColumn("ord", F.col("ord") + F.col("__shift")).drop("__shift"))  # one row


def assign_sequences(batches: DataFrame, base: int | Column = 0) -> DataFrame:
    """seq = base + position by (batch_id, ord), dense from base + 1. Positions
    are offsets of whole batches, summed over one row a batch, plus the rank
    inside a batch; rows of all batches never meet in one task."""
    sizes = batches.groupBy("batch_id").agg(F.count("*").alias("__n"))
    # a row a batch, in ranges of 4096 batches: sums of ranges, then inside
    sizes = sizes.withColumn("__r", F.expr("batch_id div 4096"))
    ranges = sizes.groupBy("__r").agg(F.sum("__n").alias("__m")).withColumn("__before", F.coalesce(F.sum("__m").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("__r").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(ranges.select("__r", "__before"), "__r").select("batch_id", (F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0))).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("batch_id").orderBy("ord"))
    start = base if isinstance(base, Column) else F.lit(base)
    return batches.join(offsets, "batch_id").withColumn("seq", (start + F.col("__offset") + rank).cast("long")).drop("__offset")


def last_in_batch(batches: DataFrame) -> DataFrame:
    """The operation that decides each key of each batch."""
    rest = [c for c in batches.columns if c not in ("batch_id", "key")]
    return batches.groupBy("batch_id", "key").agg(F.max_by(F.struct(*rest), "ord").alias("x")).select("batch_id", "key", "x.*")
