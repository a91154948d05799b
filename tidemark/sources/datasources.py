"""Python data sources for wire-format files: ``wire_log``, ``wire_batches``,
``wire_table`` and ``wire_catalog``. Register them with ``register(spark)``.

    spark.read.format("wire_table").load("dir/*.ldb")
    rows.sortWithinPartitions("key", F.col("seq").desc()).write.format("wire_table").mode("append").save("dir")

A file is one input partition; a partition is written as files of
``maxFileSize`` bytes at most (option), numbered from ``firstNumber`` on, each
under a temporary name first. Folders are paths of a file system that all
machines share, or URIs that Arrow knows. Equality and range filters on ``key``
are used by ``wire_table`` where Spark hands them over
(``spark.sql.python.filterPushdown.enabled``). ``read_files`` decodes the same
files on any store that Spark reads.
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..schema import Corruption, InvalidArgument
from . import codec

LOG_SCHEMA = "file long, offset long, type byte, length int, crc_ok boolean, payload binary"
TABLE_SCHEMA = "key binary, seq long, op byte, value binary, file long"
CATALOG_SCHEMA = "version long, comparator string, log_number long, prev_log_number long, next_file long, last_sequence long, compact_pointers array<struct<level:int,key:binary>>, deleted array<struct<level:int,number:long>>, added array<struct<level:int,number:long,file_size:long,smallest_key:binary,smallest_seq:long,largest_key:binary,largest_seq:long>>"


class FilePart(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def _store(path: str):
    """Arrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), os.path.abspath(path)


def _files(path: str, kinds: tuple[str, ...]) -> list[str]:
    """Paths of the files of these kinds in a folder, or by a pattern of names.
    A table's older name counts only where there is none of its newer one."""
    from pyarrow import fs

    store, inner = _store(path)
    folder, pattern = (inner, "*") if store.get_file_info(inner).type == fs.FileType.Directory else os.path.split(inner)
    names = [x.base_name for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == fs.FileType.File and fnmatch.fnmatchcase(x.base_name, pattern)]
    found: dict[tuple[str, int], str] = {}
    for name in sorted(names):  # .ldb before .sst
        p = codec.parse_file_name(name)
        if p and p[0] in kinds:
            found.setdefault(p, name)
    return [f"{folder.rstrip('/')}/{n}" for n in found.values()]


class _Reader(DataSourceReader):
    kinds: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.path = options["path"]
        self.strict = options.get("paranoid", "false").lower() == "true"
        self.verify = options.get("verifychecksums", options.get("verifyChecksums", "true")).lower() == "true"
        self.offset = int(options.get("initialoffset", options.get("initialOffset", 0)))

    def partitions(self) -> list[InputPartition]:
        return [FilePart(f) for f in _files(self.path, self.kinds)]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        with _store(self.path)[0].open_input_file(partition.value) as file:
            data = file.read()
        kind, number = codec.parse_file_name(os.path.basename(partition.value))
        yield from self.rows(data, number)

    def rows(self, data: bytes, number: int) -> Iterator[tuple]:
        raise NotImplementedError


class _LogReader(_Reader):
    kinds = ("log",)

    def rows(self, data: bytes, number: int) -> Iterator[tuple]:
        for at, kind, size, good, payload in codec.log_fragments(data, self.offset):
            if self.strict and not good:
                raise Corruption(f"bad record at {at} of log {number}")
            if at >= self.offset:
                yield number, at, kind, size, good, payload


class _BatchReader(_Reader):
    kinds = ("log",)

    def rows(self, data: bytes, number: int) -> Iterator[tuple]:
        def report(size: int, reason: str) -> None:
            if self.strict:
                raise Corruption(f"{reason} in log {number}")

        for _, record in codec.read_log(data, self.offset, report):
            if len(record) < codec.BATCH_HEADER:
                report(len(record), "record too small")
                continue
            sequence, ops = codec.decode_batch(record, self.strict)
            for k, (op, key, value) in enumerate(ops):
                yield key, sequence + k, op, value, number


class _TableReader(_Reader):
    kinds = ("table",)

    def __init__(self, options: dict):
        super().__init__(options)
        self.low: list[tuple[bytes, bool]] = []
        self.high: list[tuple[bytes, bool]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("key",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                value = bytes(f.value)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low.append((value, isinstance(f, GreaterThan)))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high.append((value, isinstance(f, LessThan)))
            yield f  # Spark tests again

    def rows(self, data: bytes, number: int) -> Iterator[tuple]:
        for key, seq, op, value in codec.read_table(data, self.verify, salvage=not self.strict and not self.verify):
            if any(key > v or key == v and open_ for v, open_ in self.high):
                return
            if all(key > v or key == v and not open_ for v, open_ in self.low):
                yield key, seq, op, value, number


class _CatalogReader(_Reader):
    kinds = ("catalog",)

    def rows(self, data: bytes, number: int) -> Iterator[tuple]:
        for version, (_, record) in enumerate(codec.read_log(data)):
            e = codec.decode_edit(record)
            added = []
            for level, file, size, small, large in e["added"]:
                (k1, s1, _), (k2, s2, _) = codec.decode_key(small), codec.decode_key(large)
                added.append((level, file, size, k1, s1, k2, s2))
            yield version, e.get("comparator"), e.get("log_number"), e.get("prev_log_number"), e.get("next_file"), e.get("last_sequence"), e["compact_pointers"], e["deleted"], added


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: their temporary names, in order."""

    task: int
    files: list[str]


class _Writer(DataSourceWriter):
    """Rows of a partition in their order, as files of a bounded size. Files
    get their names when all tasks are done; a task that is repeated leaves
    nothing that is read."""

    kind = ""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        if overwrite:
            raise InvalidArgument("wire files are appended to a folder, not overwritten")
        self.path, self.columns = options["path"], columns
        self.most = int(options.get("maxfilesize", options.get("maxFileSize", 2 << 20)))
        self.first = int(options.get("firstnumber", options.get("firstNumber", 1)))

    def parts(self, rows: Iterable[tuple]) -> Iterator[bytes]:
        """The contents of one file after another."""
        raise NotImplementedError

    def write(self, rows: Iterator) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        at = [self.columns.index(c) for c in self.needed]
        names = []
        for data in self.parts(tuple(r[i] for i in at) for r in rows):
            names.append(f"_{uuid.uuid4().hex}.tmp")
            with store.open_output_stream(f"{folder}/{names[-1]}") as out:
                out.write(data)
        return Written(TaskContext.get().partitionId(), names)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        number = self.first
        for m in sorted((m for m in messages if m), key=lambda m: m.task):
            for name in m.files:
                store.move(f"{folder}/{name}", f"{folder}/{codec.file_name(self.kind, number)}")
                number += 1

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for name in (n for m in messages if m for n in m.files):
            store.delete_file(f"{folder}/{name}")


class _TableWriter(_Writer):
    """Versions in internal order (key, newest first). One key's versions stay
    in one file."""

    kind, needed = "table", ("key", "seq", "op", "value")

    def parts(self, rows: Iterable[tuple]) -> Iterator[bytes]:
        held, size, last = [], 0, None
        for key, seq, op, value in rows:
            entry = bytes(key), seq, op, bytes(value or b"")
            order = codec.internal_order(*entry[:3])
            if last is not None and order < last:
                raise InvalidArgument("rows of a table must be sorted by key and descending seq inside each partition")
            if size >= self.most and entry[0] != held[-1][0]:
                yield codec.write_table(held, policy=codec.BloomPolicy())
                held, size = [], 0
            held.append(entry)
            size += len(entry[0]) + len(entry[3]) + 11
            last = order
        if held:
            yield codec.write_table(held, policy=codec.BloomPolicy())


class _LogWriter(_Writer):
    """Payloads of records, in the order of rows."""

    kind, needed = "log", ("payload",)

    def records(self, rows: Iterable[tuple]) -> Iterator[bytes]:
        yield from (bytes(payload) for (payload,) in rows)

    def parts(self, rows: Iterable[tuple]) -> Iterator[bytes]:
        held, size = [], 0
        for record in self.records(rows):
            held.append(record)
            size += len(record) + 7
            if size >= self.most:
                yield codec.write_log(held)
                held, size = [], 0
        if held:
            yield codec.write_log(held)


class _BatchWriter(_LogWriter):
    """Versions as batches: rows whose sequence numbers follow one another and
    that have one ``batch_id`` are one record, at most ``BATCH_ROWS`` of them."""

    needed = ("key", "seq", "op", "value", "batch_id")
    BATCH_ROWS = 10_000

    def records(self, rows: Iterable[tuple]) -> Iterator[bytes]:
        ops, first, of = [], 0, None
        for key, seq, op, value, batch in rows:
            if ops and (batch != of or seq != first + len(ops) or len(ops) >= self.BATCH_ROWS):
                yield codec.encode_batch(first, ops)
                ops = []
            if not ops:
                first, of = seq, batch
            ops.append((op, bytes(key), bytes(value or b"")))
        if ops:
            yield codec.encode_batch(first, ops)


class _CatalogWriter(_LogWriter):
    """Edits, in the order of rows: all in one file, from one partition."""

    kind, needed = "catalog", ("comparator", "log_number", "prev_log_number", "next_file", "last_sequence", "compact_pointers", "deleted", "added")

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        super().__init__(options, columns, overwrite)
        self.most = 1 << 62

    def records(self, rows: Iterable[tuple]) -> Iterator[bytes]:
        for row in rows:
            edit = dict(zip(self.needed, row, strict=True))
            edit["compact_pointers"] = [(x[0], bytes(x[1])) for x in edit["compact_pointers"] or ()]
            edit["deleted"] = [tuple(x) for x in edit["deleted"] or ()]
            edit["added"] = [(lv, n, size, codec.encode_key(bytes(a), sa, 1), codec.encode_key(bytes(b), sb, 1)) for lv, n, size, a, sa, b, sb in edit["added"] or ()]
            yield codec.encode_edit(edit)


def _source(label: str, ddl: str, reader: type[_Reader], writer: type[_Writer]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return ddl

        def reader(self, schema):
            return reader(self.options)

        def writer(self, schema, overwrite):
            return writer(self.options, schema.names, overwrite)

    return Source


SOURCES = {"wire_log": (LOG_SCHEMA, _LogReader, _LogWriter), "wire_batches": (TABLE_SCHEMA, _BatchReader, _BatchWriter), "wire_table": (TABLE_SCHEMA, _TableReader, _TableWriter), "wire_catalog": (CATALOG_SCHEMA, _CatalogReader, _CatalogWriter)}


def register(spark: SparkSession) -> None:
    """Make the sources known, and let Spark hand key filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for label, (ddl, reader, writer) in SOURCES.items():
        spark.dataSource.register(_source(label, ddl, reader, writer))


def read_files(spark: SparkSession, label: str, path: str, **options: str) -> DataFrame:
    """The rows of a source, through Spark's own file reader: for stores that
    only Spark reads. A file is one row until it is decoded."""
    ddl, reader, _ = SOURCES[label]
    settings = {"path": path} | options

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = reader(settings)
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                found = codec.parse_file_name(name.rsplit("/", 1)[-1])
                if found and found[0] in own.kinds:
                    rows = list(own.rows(bytes(data), found[1]))
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(ddl).names
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decoded, ddl)


def listing(spark: SparkSession, folder: str):
    """Files of a folder with their kind and number: number, kind, path, size."""
    from pyspark.sql import functions as F

    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = F.when(name == "CURRENT", "current").when(name == "LOCK", "lock").when(name.rlike(r"^LOG(\.old)?$"), "info_log").when(name.rlike(r"^MANIFEST-\d+$"), "catalog").when(name.rlike(r"^\d+\.log$"), "log").when(name.rlike(r"^\d+\.(ldb|sst)$"), "table").when(name.rlike(r"^\d+\.dbtmp$"), "temp")
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"))
    return files.select(F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("long"), F.lit(0)).alias("number"), kind.alias("kind"), "path", "size").where("kind is not null")
