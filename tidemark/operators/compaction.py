"""Compaction of versions, and the decisions over file metadata.

Frames of files have level, number, file_size, smallest_key, largest_key
(``schema.FILES``): a row a file, never a row an entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import ordered_by

Order = Callable[[Column], Column]

# Fixed values of level shaping.
L0_TRIGGER, L0_SLOWDOWN, L0_STOP = 4, 8, 12
MAX_FLUSH_LEVEL = 2
LEVEL_BASE = 10 * 1048576
LEVELS = 7


def _bytes(key: Column) -> Column:
    return key


def drop_hidden(changes: DataFrame, oldest_snapshot: int | None = None) -> DataFrame:
    """Rule A: drop a version if a newer one of its key is at or below the
    oldest live snapshot. Without a snapshot only the newest version stays."""
    if oldest_snapshot is None:
        from .resolve import newest

        return newest(changes)
    # all versions above the bound stay, and the newest at or below it: an
    # aggregation below the bound instead of a window over whole histories
    above = changes.where(F.col("seq") > oldest_snapshot)
    from .resolve import newest

    below = newest(changes.where(F.col("seq") <= oldest_snapshot))
    return above.select(*changes.columns).unionByName(below.select(*changes.columns))


def hidden_by_newer(changes: DataFrame) -> DataFrame:
    """Each version with the sequence number that hides it (null: newest)."""
    order = Window.partitionBy("key").orderBy(F.col("seq").desc(), F.col("op").desc())
    return changes.withColumn("hidden_by", F.lag("seq").over(order))


def compact(changes: DataFrame, oldest_snapshot: int | None = None, bottom: bool = True, deeper: DataFrame | None = None, order: Order = _bytes) -> DataFrame:
    """Rules A and B: tombstones at or below the oldest snapshot go as well,
    where no deeper level holds the key. ``bottom``: no deeper level at all;
    else ``deeper`` has the key ranges (smallest_key, largest_key) of deeper
    levels' files, in the order of keys."""
    kept = drop_hidden(changes, oldest_snapshot)
    bound = F.lit(True) if oldest_snapshot is None else F.col("seq") <= oldest_snapshot
    old_tombstone = (F.col("op") == 0) & bound
    if bottom:
        return kept.where(~old_tombstone)
    if deeper is None:
        return kept
    ranges = deeper.select("smallest_key", "largest_key")
    covered = (order(F.col("key")) >= order(F.col("smallest_key"))) & (order(F.col("key")) <= order(F.col("largest_key")))
    gone = kept.where(old_tombstone).join(ranges, covered, "left_anti")
    return kept.join(gone.select("key", "seq"), ["key", "seq"], "left_anti").select(*kept.columns)


def write_run(changes: DataFrame, path: str, files: int | None = None, bloom_bits: int = 0, compression: str = "snappy", page_bytes: int = 0, order: Order = _bytes) -> None:
    """A sorted run: range-partitioned in key order, sorted by key and age
    inside each file, so that row-group statistics and file ranges are
    selective. One key's versions stay in one file. ``bloom_bits``: bits a key
    of the files' Bloom filters; ``page_bytes``: size of a data page."""
    keyed, by = ordered_by(changes, order)
    ranged = keyed.repartitionByRange(files, by) if files else keyed.repartitionByRange(by)
    writer = ranged.sortWithinPartitions(by, F.col("seq").desc()).select(*changes.columns).write.option("compression", compression)
    if bloom_bits:
        # the best share of false positives that so many bits a key allow
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(0.6185**bloom_bits)).option("parquet.bloom.filter.adaptive.enabled", "true")
    if page_bytes:
        writer = writer.option("parquet.page.size", page_bytes)
    writer.mode("errorifexists").parquet(path)


def describe_files(changes: DataFrame, *by: str) -> DataFrame:
    """Range and size metadata of groups of versions."""
    return changes.groupBy(*by).agg(F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("num_entries"))


def overlaps(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (low_a <= high_b) & (low_b <= high_a)


def overlapping_inputs(files: DataFrame, begin=None, end=None, level: int | None = None) -> DataFrame:
    """Files of a level whose key range touches [begin, end] (None: open)."""
    if level is not None:
        files = files.where(F.col("level") == level)
    if begin is not None:
        files = files.where(F.col("largest_key") >= F.lit(begin))
    if end is not None:
        files = files.where(F.col("smallest_key") <= F.lit(end))
    return files


def overlapping_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of files (columns number, smallest_key, largest_key) that overlap."""
    a, b = left.alias("a"), right.alias("b")
    touch = overlaps(F.col("a.smallest_key"), F.col("a.largest_key"), F.col("b.smallest_key"), F.col("b.largest_key"))
    return a.join(b, touch).select(F.col("a.number").alias("number"), F.col("b.number").alias("other"))


def grandparent_bytes(files: DataFrame, grandparents: DataFrame) -> DataFrame:
    """Bytes of next-next-level files that each file overlaps."""
    touch = overlaps(F.col("f.smallest_key"), F.col("f.largest_key"), F.col("g.smallest_key"), F.col("g.largest_key"))
    return files.alias("f").join(grandparents.alias("g"), touch, "left").groupBy("f.number").agg(F.coalesce(F.sum("g.file_size"), F.lit(0)).alias("overlap_bytes"))


def max_bytes(level: Column) -> Column:
    return F.lit(float(LEVEL_BASE)) * F.pow(F.lit(10.0), F.greatest(level - 1, F.lit(0)))


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def level_scores(files: DataFrame) -> DataFrame:
    """level, files, bytes, score of levels with files; from 1 on a level
    wants compaction. Level 0 counts files, the others bytes."""
    stats = level_stats(files).where(F.col("level") < LEVELS - 1)
    score = F.when(F.col("level") == 0, F.col("files") / float(L0_TRIGGER)).otherwise(F.col("bytes") / max_bytes(F.col("level")))
    return stats.withColumn("score", score)


def pick_level(files: DataFrame) -> DataFrame:
    """One row: the level with the highest score; the lowest of equals."""
    return level_scores(files).agg(F.max_by("level", F.struct("score", -F.col("level"))).alias("level"), F.max("score").alias("score"))


def range_sizes(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (id, start, stop) with bytes of files inside [start, stop):
    whole files count whole, a file across a bound counts half; a reversed or
    empty range has none."""
    part = lambda bound: F.when(F.col("largest_key") < bound, F.col("file_size")).when(F.col("smallest_key") < bound, F.expr("file_size div 2")).otherwise(0)
    before = ranges.join(files, how="left", on=(F.col("smallest_key") < F.col("start")) | (F.col("smallest_key") < F.col("stop")))
    out = before.groupBy("id", "start", "stop").agg(F.coalesce(F.sum(part(F.col("start"))), F.lit(0)).alias("a"), F.coalesce(F.sum(part(F.col("stop"))), F.lit(0)).alias("b"))
    return out.select("id", F.greatest(F.col("b") - F.col("a"), F.lit(0)).cast("long").alias("bytes"))


def prune_files(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Files that may hold one of the keys: those whose first key at or after
    the smallest is at or before the largest. A merge of both in key order, not
    a comparison of each file with each key. Runs at once."""
    from .resolve import first_after

    probes = files.select(F.col("smallest_key").alias("target"), *files.columns)
    return first_after(keys.select("key"), probes).where("found <= largest_key").select(*files.columns)


def missing_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.join(found.select("number"), "number", "left_anti")


def obsolete_files(listing: DataFrame, live: DataFrame) -> DataFrame:
    return listing.join(live.select("number").distinct(), "number", "left_anti")


def replay(edits: DataFrame) -> DataFrame:
    """Live files from actions (version, action 'add' or 'remove', number, ...):
    the last action of each file decides; in one version an addition comes
    after a removal."""
    rest = [c for c in edits.columns if c not in ("version", "action", "number")]
    order = F.struct("version", (F.col("action") == "add").cast("int"))
    last = edits.groupBy("number").agg(F.max_by(F.struct("action", *rest), order).alias("x"))
    return last.where("x.action = 'add'").select("number", *[F.col(f"x.{c}").alias(c) for c in rest])
