"""Registered queries of whole stores and wire files: each makes a store (or
files) of a table in a new folder of the shared work folder, and reads it back.

The store holds view A of the catalogue, loaded in three parts; sequence numbers
are places in the order of events.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import compaction, resolve, scratch
from ..operators.batch import WriteBatch
from ..sources import datasources
from .catalogue import B_SQL, customer_keys, events, query, state_sql, view_a, view_b
from .store import Options, Snapshot, Store, repair

S_SQL = "a AS (SELECT 'u'||lpad(CAST(user_id AS VARCHAR),6,'0') AS key, row_number() OVER (ORDER BY event_id) AS seq, CASE WHEN event_type='error' THEN 0 ELSE 1 END AS op, props AS value, event_id FROM events)"
PARTS = 3


def part_bounds(spark: SparkSession, d: str) -> list[int]:
    """Event ids at which the parts of a load end."""
    last = events(spark, d).agg(F.max("event_id")).first()[0] or 0
    return [last * k // PARTS for k in range(1, PARTS)] + [last]


BOUND_SQL = f"(SELECT count(*) FROM events WHERE event_id<=(SELECT max(event_id)//{PARTS} FROM events))"


def load(spark: SparkSession, d: str, between=lambda db, part: None, **options) -> Store:
    """A new store with view A, in bulk writes; ``between`` is called after each."""
    db = Store.open(spark, scratch.folder(spark, "store"), Options(create_if_missing=True, **options))
    rows = view_a(spark, d).select(F.col("key").cast("binary").alias("key"), "op", F.col("value").cast("binary").alias("value"), (F.col("seq") - 1).alias("event_id"))
    low = -1
    for part, high in enumerate(part_bounds(spark, d)):
        db.write_df(rows.where((F.col("event_id") > low) & (F.col("event_id") <= high)), "event_id")
        between(db, part)
        low = high
    return db


def texts(rows: DataFrame, *names: str) -> DataFrame:
    """Keys and values as texts."""
    return rows.select(*[F.col(n).cast("string").alias(n) if n in ("key", "value") else F.col(n) for n in names])


def finish(db: Store, rows: DataFrame) -> DataFrame:
    db.close()  # its files stay
    return rows


@query("q51_store_bulk_write", f"WITH {S_SQL}, {state_sql('s', 'a')} SELECT key, value, seq FROM s")
def _q51(spark, d):
    db = load(spark, d)
    return finish(db, texts(db.state(), "key", "value", "seq"))


@query("q52_store_compacted", f"WITH {S_SQL}, {state_sql('s', 'a')} SELECT key, value, seq FROM s")
def _q52(spark, d):
    """After compaction of each part: what is stored is the state, no more."""
    db = load(spark, d, lambda db, part: db.compact_range(), max_file_size=1 << 20)
    return finish(db, texts(db.changelog(), "key", "value", "seq"))


HISTORY_SQL = "h AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM a)"


@query("q53_store_keeps_snapshots", f"WITH {S_SQL}, {HISTORY_SQL} SELECT key, seq, op, value FROM h WHERE (newer IS NULL OR newer>{BOUND_SQL}) AND NOT (op=0 AND seq<={BOUND_SQL})")
def _q53(spark, d):
    """Versions that a compaction keeps for a snapshot taken after one part."""
    db = load(spark, d, lambda db, part: db.snapshot() if part == 0 else None)
    db.compact_range()
    return finish(db, texts(db.changelog(), "key", "seq", "op", "value").withColumn("op", F.col("op").cast("int")))


@query("q54_store_snapshot_read", f"WITH {S_SQL}, b AS (SELECT * FROM a WHERE seq<={BOUND_SQL}), {state_sql('s', 'b')} SELECT key, value, seq FROM s")
def _q54(spark, d):
    pins: list[Snapshot] = []
    db = load(spark, d, lambda db, part: pins.append(db.snapshot()))
    db.compact_range()
    return finish(db, texts(db.state(pins[0]), "key", "value", "seq"))


@query("q55_store_reopened", f"WITH {S_SQL}, n AS (SELECT count(*) AS n FROM events), w AS (SELECT key, seq, op, value FROM a UNION ALL SELECT 'u000001', n+1, 1, 'first' FROM n UNION ALL SELECT 'new', n+2, 1, 'x' FROM n UNION ALL SELECT 'u000002', n+3, 0, '' FROM n UNION ALL SELECT 'new', n+4, 1, 'second' FROM n), {state_sql('s', 'w')} SELECT key, value, seq FROM s")
def _q55(spark, d):
    """Bulk writes, then batches that only log files hold; opened again."""
    db = load(spark, d)
    db.write(WriteBatch().put(b"u000001", b"first").put(b"new", b"x").delete(b"u000002"))
    db.put(b"new", b"second")
    db.close()
    again = Store.open(spark, db.path)
    return finish(again, texts(again.state(), "key", "value", "seq"))


@query("q56_store_repaired", f"WITH {S_SQL}, w AS (SELECT key, seq, op, value FROM a UNION ALL SELECT 'tail', (SELECT count(*)+1 FROM events), 1, 'log only'), {state_sql('s', 'w')} SELECT key, value, seq FROM s")
def _q56(spark, d):
    """Without its commits: runs are found again, the log becomes one."""
    db = load(spark, d)
    db.put(b"tail", b"log only")
    db.close()
    db.files.remove("_commits")
    repair(spark, db.path)
    again = Store.open(spark, db.path)
    return finish(again, texts(again.state(), "key", "value", "seq"))


@query("q57_store_range_scan", f"WITH {S_SQL}, {state_sql('s', 'a')} SELECT key, value FROM s WHERE key>='u000020' AND key<'u000080'")
def _q57(spark, d):
    db = load(spark, d, max_file_size=1 << 20, bloom_bits=10)
    return finish(db, texts(db.scan(start=b"u000020", limit=b"u000080"), "key", "value"))


@query("q58_store_multi_get", f"WITH {S_SQL}, {state_sql('s', 'a')}, k AS (SELECT DISTINCT 'u'||lpad(CAST(c_custkey AS VARCHAR),6,'0') AS key FROM customer) SELECT k.key, s.value, s.seq FROM k LEFT JOIN s ON k.key=s.key")
def _q58(spark, d):
    db = load(spark, d)
    wanted = customer_keys(spark, d).select(F.col("key").cast("binary").alias("key"))
    return finish(db, texts(resolve.multi_get(db.changelog(), wanted), "key", "value", "seq"))


@query("q59_store_reverse_order", f"WITH {S_SQL}, {state_sql('s', 'a')} SELECT row_number() OVER (ORDER BY key DESC) AS pos, key FROM s WHERE key<='u000800' AND key>'u000002'")
def _q59(spark, d):
    """A store in reverse order: bounds are in its order."""
    db = load(spark, d, comparator="reverse")
    db.compact_range()
    rows = db.scan(start=b"u000800", limit=b"u000002").select("key")
    return finish(db, texts(resolve.positions(*K.ordered_by(rows, K.COMPARATORS["reverse"].order)), "pos", "key"))


@query("q60_store_files", f"WITH {S_SQL}, {state_sql('s', 'a')} SELECT count(*) AS entries, min(key) AS first_key, max(key) AS last_key, max(seq) AS newest FROM s")
def _q60(spark, d):
    """The catalog's file metadata after compaction, summed up."""
    db = load(spark, d, max_file_size=1 << 20)
    db.compact_range()
    f = db.file_frame()
    return finish(db, f.agg(F.sum("num_entries").alias("entries"), F.min("smallest_key").cast("string").alias("first_key"), F.max("largest_key").cast("string").alias("last_key"), F.max("max_seq").alias("newest")))


def wire(spark: SparkSession) -> str:
    datasources.register(spark)
    return scratch.folder(spark, "wire").removeprefix("file://").removeprefix("file:")




def binary(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("key").cast("binary").alias("key"), "seq", F.col("op").cast("byte").alias("op"), F.when(F.col("op") == 1, F.col("value").cast("binary")).otherwise(F.lit(b"")).alias("value"), *more)


def plain(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), "seq", F.col("op").cast("int").alias("op"), F.col("value").cast("string").alias("value"))


WIRE_SQL = f"WITH {B_SQL} SELECT key, seq, op, CASE WHEN op=1 THEN value ELSE '' END AS value FROM b"


@query("q61_wire_tables", WIRE_SQL)
def _q61(spark, d):
    folder = wire(spark)
    rows = binary(view_b(spark, d)).repartitionByRange("key").sortWithinPartitions("key", F.col("seq").desc())
    rows.write.format("wire_table").mode("append").option("maxFileSize", 1 << 18).save(folder)
    return plain(spark.read.format("wire_table").load(folder))


@query("q62_wire_batches", WIRE_SQL)
def _q62(spark, d):
    folder = wire(spark)
    rows = binary(view_b(spark, d), "batch_id").repartitionByRange("batch_id").sortWithinPartitions("seq")
    rows.write.format("wire_batches").mode("append").save(folder)
    return plain(spark.read.format("wire_batches").load(folder))


@query("q63_wire_table_state", f"WITH {B_SQL}, {state_sql('s', 'b')} SELECT key, value FROM s WHERE key>='click/' AND key<'login/'")
def _q63(spark, d):
    """A snapshot read over wire tables with key bounds, through Spark's reader."""
    folder = wire(spark)
    binary(view_b(spark, d)).repartitionByRange("key").sortWithinPartitions("key", F.col("seq").desc()).write.format("wire_table").mode("append").save(folder)
    rows = datasources.read_files(spark, "wire_table", folder)
    return texts(resolve.scan(rows, start=bytearray(b"click/"), limit=bytearray(b"login/")), "key", "value")


@query("q64_wire_catalog", f"WITH {B_SQL}, f AS (SELECT run AS number, CAST(run%3 AS INTEGER) AS level, count(*)*64 AS file_size, min(key) AS smallest_key, max(key) AS largest_key FROM b GROUP BY run) SELECT number, level, file_size, smallest_key, largest_key FROM f WHERE number%4<>1")
def _q64(spark, d):
    """Edits that add each run and remove some, written, read and replayed."""
    folder = wire(spark)
    f = compaction.describe_files(view_b(spark, d), "run").select(F.col("run").alias("number"), (F.col("run") % 3).cast("int").alias("level"), (F.col("num_entries") * 64).alias("file_size"), "smallest_key", "largest_key", "min_seq", "max_seq")
    file = F.struct("level", "number", "file_size", F.col("smallest_key").cast("binary").alias("smallest_key"), F.col("max_seq").alias("smallest_seq"), F.col("largest_key").cast("binary").alias("largest_key"), F.col("min_seq").alias("largest_seq"))
    edits = f.select(F.col("number").alias("at"), F.array(file).alias("added"), F.lit(None).cast("array<struct<level:int,number:long>>").alias("deleted"))
    gone = f.where("number % 4 = 1").select((F.col("number") + 1_000_000).alias("at"), F.lit(None).cast(edits.schema["added"].dataType).alias("added"), F.array(F.struct("level", "number")).alias("deleted"))
    none = {c: F.lit(None).cast(t) for c, t in (("comparator", "string"), ("log_number", "long"), ("prev_log_number", "long"), ("next_file", "long"), ("last_sequence", "long"), ("compact_pointers", "array<struct<level:int,key:binary>>"))}
    edits.unionByName(gone).withColumns(none).coalesce(1).sortWithinPartitions("at").write.format("wire_catalog").mode("append").save(folder)
    got = spark.read.format("wire_catalog").load(folder)
    added = got.select("version", F.lit("add").alias("action"), F.explode("added").alias("x")).select("version", "action", "x.number", "x.level", "x.file_size", "x.smallest_key", "x.largest_key")
    removed = got.select("version", F.lit("remove").alias("action"), F.explode("deleted").alias("x")).select("version", "action", "x.number", "x.level", *[F.lit(None).cast(t).alias(c) for c, t in (("file_size", "long"), ("smallest_key", "binary"), ("largest_key", "binary"))])
    live = compaction.replay(added.unionByName(removed))
    return live.select("number", "level", "file_size", F.col("smallest_key").cast("string").alias("smallest_key"), F.col("largest_key").cast("string").alias("largest_key"))


@query("q65_streamed_state", f"WITH {S_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM a) SELECT key, seq, op, value FROM r WHERE rn=1")
def _q65(spark, d):
    """The changelog in three files, tailed as a stream to the end."""
    from ..streaming import tail

    folder, name = scratch.folder(spark, "stream"), f"newest_{next(_streams)}"
    bounds = part_bounds(spark, d)
    seqs = resolve.positions(events(spark, d).select("event_id"), "event_id", name="seq")
    rows = view_a(spark, d).withColumn("event_id", F.col("seq") - 1).drop("seq").join(seqs, "event_id")
    for low, high in zip([-1, *bounds[:-1]], bounds, strict=True):
        binary_rows = rows.where((F.col("event_id") > low) & (F.col("event_id") <= high)).select(F.col("key").cast("binary").alias("key"), "seq", F.col("op").cast("byte").alias("op"), F.col("value").cast("binary").alias("value"))
        binary_rows.write.mode("append").parquet(f"{folder}/changes")
    tail.publish(tail.live_view(tail.read_changes(spark, f"{folder}/changes")), f"{folder}/live", f"{folder}/progress", name)
    return texts(spark.read.parquet(f"{folder}/live"), "key", "seq", "op", "value").withColumn("op", F.col("op").cast("int"))


_streams = itertools.count()
