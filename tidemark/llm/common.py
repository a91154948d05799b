"""Helpers shared by the training-data operators: the shared work folder,
bounded Arrow blocks, and vectorised word splitting."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once; one longer text goes alone.
BLOCK_BYTES = 2 << 20
#: Plan bytes (compressed Parquet) for one task of an explicit repartition.
TASK_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine a folder below the
    warehouse directory is taken; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path, not yet made, in the shared folder."""
    return f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, group_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so
    that a lost executor costs a re-read and never a re-computation. Once the
    table is written nothing needs the shuffle files behind it; Spark is told
    to drop them at the end of the write. ``group_rows``: rows of a row group
    at most. Tables with rows of megabytes need it, as both the writer, which
    looks at its size after 100 rows only, and the reader hold whole groups."""
    spark = df.sparkSession
    path = work_path(spark, label)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``: for a scan, its files' bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def task_count(source: DataFrame, per_task: int = TASK_BYTES) -> int:
    """Partitions for an explicit shuffle of ``source``'s rows: by its bytes,
    and no fewer than the session's cores. It grows with the input. Where
    Catalyst has no estimate (rows made on the driver), the session's number of
    shuffle partitions counts."""
    spark, size = source.sparkSession, plan_bytes(source)
    known = -(-size // per_task) if size < 1 << 56 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, known)


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Exactly these columns with these types, whatever else ``df`` has; names
    match exactly first, then without case, and a missing one is null."""
    own = Numbered(df)
    return own.rows.select(*(own.column(name, kind).alias(name) for name, kind in types.items()))


def row_key(doc_id: str | Column, text: str | Column) -> Column:
    """A row's identity, 16 bytes of its id and text (neither name nor hash
    says where the row stands): equal rows have equal keys."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")))))


class Numbered:
    """A table with its columns renamed by position, so that names which clash
    (also by case alone) or that an operator uses itself do no harm."""

    def __init__(self, docs: DataFrame):
        self.own = docs.columns
        self.names = [f"column_{i}" for i in range(len(self.own))]
        self.rows = docs.toDF(*self.names)

    def column(self, name: str, kind: str) -> Column:
        """The column of this name, exactly or else without case; null if none."""
        found = [i for i, c in enumerate(self.own) if c == name] or [i for i, c in enumerate(self.own) if c.lower() == name.lower()]
        return (F.col(self.names[found[0]]) if found else F.lit(None)).cast(kind)

    def restored(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.names).toDF(*self.own)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text each, at least
    one row; empty batches vanish."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) one after another, and n+1 offsets."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts from bytes and offsets, without a copy."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def byte_table(delimiters: bytes) -> np.ndarray:
    """Map for single bytes: A-Z to a-z, the delimiters to a blank."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[list(delimiters)] = 32
    return table


#: White space of word shingles: blank and tab to carriage return.
SPACES = byte_table(b" \t\n\v\f\r")


class Words:
    """The words of a block of texts: ``codes`` index ``vocabulary`` (distinct
    words as an Arrow array); text i has codes[offsets[i]:offsets[i + 1]]."""

    def __init__(self, texts: pa.Array, table: np.ndarray = SPACES):
        data, offsets = text_bytes(texts)
        lists = pc.ascii_split_whitespace(string_array(table[data], offsets))
        flat = lists.values if hasattr(lists, "values") else lists.flatten()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = flat.slice(bounds[0], bounds[-1] - bounds[0])
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        before = np.concatenate([[0], np.cumsum(full)])
        self.offsets = before[bounds - bounds[0]]
        coded = (flat if full.all() else flat.filter(pa.array(full))).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64): spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged_take(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists number ``rows`` of (values, offsets), one after another, with the
    length of each."""
    lengths = np.diff(offsets)[rows]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64) + np.repeat(offsets[:-1][rows] - (ends - lengths), lengths)
    return values[index], lengths


def local_file(uri: str) -> str | None:
    """The path of a file: URI or plain path, None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


class NewFile:
    """A file that appears whole or not at all: written bit by bit under a
    temporary name in the same folder, then renamed. Attempts may overlap."""

    def __init__(self, uri: str):
        self.local = local_file(uri)
        if self.local:
            self.path = self.local
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
        else:
            from pyarrow import fs

            self.store, self.path = fs.FileSystem.from_uri(uri)
            self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = open(self.part, "wb") if self.local else self.store.open_output_stream(self.part)

    def write(self, data) -> None:
        self.out.write(data)

    def done(self) -> None:
        self.out.close()
        if self.local:
            os.replace(self.part, self.path)
        else:
            self.store.move(self.part, self.path)

    def drop(self) -> None:
        """Leave nothing behind, unless the file is done."""
        self.out.close()
        with contextlib.suppress(OSError):
            os.remove(self.part) if self.local else self.store.delete_file(self.part)


def map_file(uri: str, dtype: str) -> np.ndarray:
    """A flat file of integers: memory-mapped where the store is a file
    system, else read through Arrow."""
    path = local_file(uri)
    if path:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.readall(), dtype=dtype)

