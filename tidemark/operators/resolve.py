"""Reads of a changelog (key, seq, op, value): DataFrame in, DataFrame out.

Every read is a group-wise argmax: the newest version of each key at or below a
snapshot, then without tombstones. Order matters: the snapshot bound and key
predicates stand before the argmax, where Catalyst pushes them into the scan;
``op`` and value predicates stand after it, or old versions would come back.

The argmax is ``max_by`` over a struct: partial in each task, so a key with a
third of all versions sends one row a task. Key types are free: any orderable
column works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import ordered_by
from .scratch import stored


def visible(changes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Versions at or below a snapshot (None: all)."""
    return changes if snapshot is None else changes.where(F.col("seq") <= snapshot)


def newest(changes: DataFrame, by: list[str | Column] | None = None) -> DataFrame:
    """Newest version of each key, tombstones included. Exact duplicates of a
    (key, seq, op), as replayed logs leave them, are one version."""
    by = by or ["key"]
    rest = [c for c in changes.columns if c not in ("key", "seq", "op", "value")]
    packed = F.max_by(F.struct("op", "value", *[c for c in rest if c not in by]), F.struct("seq", "op"))
    out = changes.groupBy(*by).agg(F.max("seq").alias("seq"), packed.alias("__v"))
    return out.select(*by, "seq", "__v.*")


def state_at(changes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, value, seq) of the live keys at a snapshot."""
    return newest(visible(changes, snapshot)).where(F.col("op") == 1).select("key", "value", "seq")


def get(changes: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """No or one row (key, value, seq). The key's equality reaches the scan."""
    return state_at(changes.where(F.col("key") == F.lit(key)), snapshot)


def multi_get(changes: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``keys`` with value and seq, null for keys that aren't live. Only
    versions of wanted keys are resolved (a semi join, broadcast by the planner
    where ``keys`` is small)."""
    wanted = changes.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.join(state_at(wanted, snapshot), "key", "left")


def as_of_join(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (key, snapshot, ...) with value and seq as of each snapshot.

    Instead of a non-equi join, which makes a row for each pair of probe and
    older version, probes and versions are merged in one window by key: the
    newest version so far is carried to each probe. Tasks see a row for each
    version and each probe. A key with very many versions is cut into chunks of
    sequence numbers first: each chunk's last version is carried over to the
    next ones from a table of chunks.
    """
    others = [c for c in probes.columns if c not in ("key", "snapshot")]
    kind = changes.schema["value"].dataType
    versions = changes.select("key", F.col("seq").alias("at"), F.lit(0).alias("__probe"), F.struct("seq", "op", "value").alias("__v"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in others])
    asked = probes.select("key", F.col("snapshot").alias("at"), F.lit(1).alias("__probe"), F.lit(None).cast(versions.schema["__v"].dataType).alias("__v"), *others)
    chunk = F.shiftright("at", 20)
    rows = versions.unionByName(asked).withColumn("chunk", chunk)
    inside = Window.partitionBy("key", "chunk").orderBy("at", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("near", F.last("__v", ignorenulls=True).over(inside)).where("__probe = 1")
    ends = versions.withColumn("chunk", chunk).groupBy("key", "chunk").agg(F.max_by("__v", "at").alias("__v"))
    # what stood before a chunk: over one row a key and chunk
    heads = near.select("key", "chunk").distinct().withColumn("ask", F.lit(1)).withColumn("__v", F.lit(None).cast(versions.schema["__v"].dataType))
    before = Window.partitionBy("key").orderBy("chunk", F.col("ask").desc()).rowsBetween(Window.unboundedPreceding, 0)
    carried = ends.withColumn("ask", F.lit(0)).unionByName(heads).withColumn("prior", F.last("__v", ignorenulls=True).over(before)).where("ask = 1").select("key", "chunk", "prior")
    found = near.join(carried, ["key", "chunk"], "left").withColumn("hit", F.coalesce("near", "prior"))
    live = F.col("hit.op") == 1
    return found.select("key", F.col("at").alias("snapshot"), *others, F.when(live, F.col("hit.value")).cast(kind).alias("value"), F.when(live, F.col("hit.seq")).alias("seq"))


def in_range(changes: DataFrame, start=None, limit=None, sort_key=None) -> DataFrame:
    """Versions with start <= key < limit; either bound may be open."""
    order = sort_key or (lambda key: key)
    if start is not None:
        changes = changes.where(order(F.col("key")) >= order(F.lit(start)))
    if limit is not None:
        changes = changes.where(order(F.col("key")) < order(F.lit(limit)))
    return changes


def scan(changes: DataFrame, snapshot: int | None = None, start=None, limit=None, reverse: bool = False, sort_key=None) -> DataFrame:
    """Live rows in key order. ``sort_key``: a function from a key column to
    what it is ordered by, bounds included."""
    state, by = ordered_by(state_at(in_range(changes, start, limit, sort_key), snapshot), sort_key or (lambda key: key))
    return state.orderBy(F.desc(by) if reverse else F.asc(by)).select("key", "value", "seq")


def seek_next(changes: DataFrame, target, count: int, snapshot: int | None = None) -> DataFrame:
    """The first ``count`` live rows with key >= target: a top-k, not a sort."""
    return scan(changes, snapshot, start=target).limit(count)


def seek_prev(changes: DataFrame, target, count: int, snapshot: int | None = None) -> DataFrame:
    """The last ``count`` live rows with key < target, backwards."""
    return scan(changes, snapshot, limit=target, reverse=True).limit(count)


def _in_ranges(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` sorted in ranges, written once: ``range`` numbers the ranges in
    order and ``at`` the rows of each from 0. All that is derived from it sees
    the same ranges, however they were sampled and coalesced."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    got = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    return got.withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))


def positions(rows: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """Dense positions from 1 on in a total order: ranges are counted, and a
    row's place in its range is added to the rows of the ranges before. Only a
    number a range comes to the driver. Runs at once (the ranges are written)."""
    ranged = _in_ranges(rows, *order)
    base, offsets = 0, []
    for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():  # a row a range
        offsets.append((r["__range"], base))
        base += r["n"]
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__range long, __base long"))
    return ranged.join(table, "__range").withColumn(name, F.col("__base") + F.col("__at") + 1).select(*rows.columns, name)


def seek_each(changes: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``probes`` (target, ...) with the first live key at or after each target
    (``found``, null past the end)."""
    return first_after(state_at(changes, snapshot), probes)


def first_after(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (target, ...) with the first ``key`` at or after each target,
    by merging both in key order instead of a non-equi join. Both are sorted
    into the same ranges; the next key is carried back over ranges from a table
    with one row a range."""
    others = [c for c in probes.columns if c != "target"]
    keys = keys.select(F.col("key").alias("at"), F.lit(1).alias("is_key"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in others])
    asked = probes.select(F.col("target").alias("at"), F.lit(0).alias("is_key"), *others)
    rows = _in_ranges(keys.unionByName(asked), "at")
    inside = Window.partitionBy("__range").orderBy(F.col("at").desc(), F.col("is_key").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("found", F.last(F.when(F.col("is_key") == 1, F.col("at")), ignorenulls=True).over(inside))
    firsts = rows.groupBy("__range").agg(F.min(F.when(F.col("is_key") == 1, F.col("at"))).alias("first"))
    # a row a range: the first key of any later range
    later = Window.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = firsts.withColumn("beyond", F.last("first", ignorenulls=True).over(later)).select("__range", "beyond")
    return near.where("is_key = 0").join(F.broadcast(beyond), "__range").select(F.col("at").alias("target"), *others, F.coalesce("found", "beyond").alias("found"))


def first_last(changes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """One row: smallest and largest live key."""
    return state_at(changes, snapshot).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def prefix_scan(changes: DataFrame, prefix: str | bytes, snapshot: int | None = None) -> DataFrame:
    from ..functions.keys import prefix_successor

    return scan(changes, snapshot, start=prefix, limit=prefix_successor(prefix))


def raw_scan(changes: DataFrame) -> DataFrame:
    """Every version in internal order: key, newest first."""
    return changes.orderBy("key", F.col("seq").desc(), F.col("op").desc())


def history(changes: DataFrame, key) -> DataFrame:
    """Versions of one key, newest first, each with the value it replaced."""
    own = changes.where(F.col("key") == F.lit(key))
    order = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return own.select("key", "seq", "op", "value", F.row_number().over(order).alias("version"), F.lead("value").over(order).alias("replaced"))


def tombstones(changes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Keys whose newest visible version is a deletion."""
    return newest(visible(changes, snapshot)).where(F.col("op") == 0).select("key", "seq")


def census(changes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """One row: live keys, deleted keys, versions."""
    seen = visible(changes, snapshot)
    per_key = seen.groupBy("key").agg(F.max_by("op", "seq").alias("op"), F.count("*").alias("n"))
    return per_key.agg(F.count_if(F.col("op") == 1).alias("live_keys"), F.count_if(F.col("op") == 0).alias("dead_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("versions"))


def digest(changes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """One row: live keys and an order-free checksum of keys and values."""
    return state_at(changes, snapshot).agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(key, value))"), F.lit(0).cast("long")).alias("checksum"))


def diff(changes: DataFrame, older: int, newer: int) -> DataFrame:
    """(key, change, old_value, new_value) between two snapshots, from one
    aggregation of the changelog: no join of two states."""
    seen = visible(changes, newer)
    old = F.max_by(F.when(F.col("seq") <= older, F.struct("op", "value")), F.when(F.col("seq") <= older, F.col("seq")))
    both = seen.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("n"), old.alias("o"))
    before, after = F.coalesce(F.col("o.op") == 1, F.lit(False)), F.col("n.op") == 1
    changed = F.when(~before & after, "added").when(before & ~after, "removed").when(before & after & ~F.col("o.value").eqNullSafe(F.col("n.value")), "changed")
    return both.select("key", changed.alias("change"), F.when(before, F.col("o.value")).alias("old_value"), F.when(after, F.col("n.value")).alias("new_value")).where("change is not null")


def keys_set(changes: DataFrame, one: int, two: int, how: str) -> DataFrame:
    """Keys live at both snapshots, at either, or at the first only."""
    a, b = (state_at(changes, s).select("key") for s in (one, two))
    return {"intersect": a.intersect, "union": lambda x: a.union(x).distinct(), "except": a.subtract}[how](b)


def deduplicate(changes: DataFrame) -> DataFrame:
    """Exact duplicates of (key, seq, op), as a log replayed twice leaves."""
    return changes.dropDuplicates(["key", "seq", "op"])


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Union of runs (each with its ``run``); resolve it with ``newest``: the
    highest sequence number wins, never the run's age."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out

