"""Near-duplicate documents by MinHash with tensored banding.

A document's set are the distinct shingles of ``k`` words, as 64-bit hashes.
Documents with equal sets (known by a 128-bit hash) form one class at once,
before anything is compared, so a large group of copies costs a row a task.

Two small collections A and B of ``hashes`` band hashes each (``rows`` minhashes
a band) are computed per document. Table (i, j) has the key (A_i, B_j): the
hashes * hashes tables need only 2 * hashes * rows minhashes. Keys are formed
only from band hashes that two classes share at least, because no other key can
be shared. With 20 bands of 5 rows a side, a pair at similarity 0.8 misses all
400 tables with probability 7e-4, one at 0.85 with 1e-5, and one at 0.3 shares
a key with probability 2e-3.

Candidates are confirmed on full sets, and never all pairs of a table key:

1. Each class is compared with the class it shares most tables with; linked
   classes form components.
2. Each key that holds several components gets a *pivot*, the root of the
   component with most members there. Members are compared with their pivots;
   what is linked joins.
3. Two members x, y of a pivot c that are still apart can be linked only if the
   differences Dx = x ^ c and Dy = y ^ c share enough elements: |x ^ y| =
   |Dx| + |Dy| - 2 |Dx & Dy|. This is a join on the rare elements of the
   differences (prefix filter): elements in order of their frequency around the
   pivot, and of each set only so many as the partner's distance to the pivot
   leaves (in layers of distance). What many members have in common with each
   other beside the pivot is rare among near copies, so the join meets few
   pairs, and none is lost. What passes is confirmed on full sets.

Sets are built from the texts of classes that share a key, and nothing but
whether a step found links reaches the driver.

Defined results: a null or wordless text has an empty set, is linked with
nothing and keeps itself; fewer than ``k`` words are one shingle; equal
``doc_id`` values are one id on rows of their own; a null ``doc_id`` counts as
larger than all others, and a component without ids has none; repeated rows are
copies; an empty table gives no row; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbered, Words, blocks, forget, mixed, pick, row_key, stored
from .graph import components

WORDS = 5
SIMILARITY = 80  # per cent
HASHES = 20
ROWS = 5
#: Shingles hashed at once: they stay in a core's cache.
CHUNK = 1 << 16
#: Text bytes that a Python worker handles at once.
TEXT_BYTES = 2 << 20

SIGNED = "key binary, doc_id long, n_shingles long, set_id binary, a array<long>, b array<long>"
_SEEDS = mixed(np.arange(1, 4097, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.vocabulary.to_pylist()), dtype=np.uint64, count=len(words.vocabulary))
    w = hashed[words.codes]
    n = max(0, len(w) - k + 1)
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    out, at = [], words.offsets.tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            x = np.sort(h[a : b - k + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(w[a:b].tobytes(), seed=b - a)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def band_hashes(sets: list[np.ndarray], hashes: int, rows: int) -> np.ndarray:
    """2 * hashes band hashes of each non-empty set, A's before B's."""
    ends = np.cumsum([len(x) for x in sets])
    out = np.zeros((len(sets), 2 * hashes), dtype=np.uint64)
    at = 0
    while at < len(sets):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        # sets are hashes already: their upper halves are spread evenly
        flat = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], ends[at : to - 1] - before])
        work = np.empty_like(flat)
        for band in range(2 * hashes):
            own = np.full(to - at, band, dtype=np.uint64)
            for seed in _SEEDS[band * rows : (band + 1) * rows]:
                np.multiply(flat, seed, out=work)
                own = mixed(own * np.uint64(3) + np.minimum.reduceat(work, starts))
            out[at:to, band] = own
        at = to
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", row_key("doc_id", "text"))


def sign(docs: DataFrame, k: int, hashes: int, rows: int) -> DataFrame:
    """A row a document: its set's size, id and band hashes (null if empty)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=TEXT_BYTES):
            sets = shingle_sets(block.column("text"), k)
            n = np.array([len(x) for x in sets])
            full = np.flatnonzero(n)
            bands = np.zeros((len(sets), 2 * hashes), dtype=np.uint64)
            if len(full):
                bands[full] = band_hashes([sets[i] for i in full.tolist()], hashes, rows)
            ids = [xxhash.xxh3_128_digest(x) if len(x) else None for x in sets]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * hashes), pa.array(np.ascontiguousarray(x).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), lists(bands[:, :hashes]), lists(bands[:, hashes:])], names=["key", "doc_id", "n_shingles", "set_id", "a", "b"])

    return docs.mapInArrow(made, SIGNED)


def table_members(classes: DataFrame) -> DataFrame:
    """(table, set_id, n): keys that two classes share at least."""
    bands = classes.select("set_id", "n", F.explode(F.expr("concat(transform(a, x -> struct(0 as side, x as band)), transform(b, x -> struct(1 as side, x as band)))")).alias("x")).select("set_id", "n", "x.side", "x.band")
    bands = stored(bands, "bands")
    shared = stored(bands.groupBy("band").count().where("count > 1").select("band"), "shared")
    own = bands.join(shared, "band").groupBy("set_id").agg(F.first("n").alias("n"), F.collect_set(F.when(F.col("side") == 0, F.col("band"))).alias("a"), F.collect_set(F.when(F.col("side") == 1, F.col("band"))).alias("b"))
    # at most hashes * hashes keys a class
    keys = stored(own.select("set_id", "n", F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))).alias("table")), "tables")
    forget(bands, shared)
    full = stored(keys.groupBy("table").agg(F.count("*").alias("members")).where("members > 1").select("table"), "buckets")
    members = stored(keys.join(full, "table"), "members")
    forget(keys, full)
    return members


def build_sets(rows: DataFrame, classes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(set_id, shingles) of the classes that share a key, from the text of one
    document each; repeated rows of that document count once."""
    wanted = members.select("set_id").distinct().join(classes.select("set_id", F.col("sample").alias("key")), "set_id")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=TEXT_BYTES):
            sets = shingle_sets(block.column("text"), k)
            yield pa.RecordBatch.from_arrays([block.column("set_id"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["set_id", "shingles"])

    texts = rows.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("set_id", "text")
    return stored(texts.mapInArrow(made, "set_id binary, shingles binary"), "sets")


def _both_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v, ...) with the sets x and y of both."""
    left = pairs.join(sets.select(F.col("set_id").alias("u"), F.col("shingles").alias("x")), "u")
    return left.join(sets.select(F.col("set_id").alias("v"), F.col("shingles").alias("y")), "v")


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each element of x, whether it is in y (both sorted)."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                both = int(np.count_nonzero(_shared(x, y) if len(x) <= len(y) else _shared(y, x)))
                good.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return stored(_both_sets(pairs, sets).select("u", "v", "x", "y").mapInArrow(made, "u binary, v binary"), "confirmed")


AROUND = "u binary, v binary, linked boolean, nu int, nv int, nd int, diff array<long>"


def around(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Classes u and their pivots v (``wide``: whether others may be linked with
    u): whether they are linked, both sizes, and the difference, if wide."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, sizes, diffs = [], [], []
            for x, y, wide in zip(batch.column("x"), batch.column("y"), batch.column("wide").to_pylist(), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                in_y = _shared(x, y)
                both = int(np.count_nonzero(in_y))
                linked.append(100 * both >= similarity * (len(x) + len(y) - both))
                sizes.append((len(x), len(y), len(x) + len(y) - 2 * both))
                diffs.append(np.concatenate([x[~in_y], y[~_shared(y, x)]]).view(np.int64) if wide else None)
            nu, nv, nd = zip(*sizes, strict=True) if sizes else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_()), *(pa.array(x, pa.int32()) for x in (nu, nv, nd)), pa.array(diffs, pa.list_(pa.int64()))], names=["u", "v", "linked", "nu", "nv", "nd", "diff"])

    return stored(_both_sets(pairs, sets).select("u", "v", "x", "y", "wide").mapInArrow(made, AROUND), "around")


def apart(near: DataFrame, roots: DataFrame, similarity: int) -> DataFrame:
    """Distinct pairs (u, v) of classes in different components around one
    pivot that may be linked: every such pair that is linked is among them.

    With F(x) = (100 + s) |Dx| - (100 - s) |x|, a pair is linked only if
    2 (100 + s) |Dx & Dy| >= F(x) + F(y). If their first common element stands
    at place i of Dx and j of Dy, they share min(|Dx| - i, |Dy| - j) at most.
    """
    s, more, less = similarity, 100 + similarity, 100 - similarity
    # layers of F, a quarter of what the pivot's size allows wide
    wide = F.greatest(F.lit(1), F.floor(less * F.col("nv") / 4))
    rows = near.select("u", "v", "nu", "nd", "diff", (more * F.col("nd") - less * F.col("nu")).cast("long").alias("f"), wide.cast("long").alias("step"))
    rows = rows.join(roots.select(F.col("node").alias("u"), "root"), "u", "left").withColumn("root", F.coalesce("root", "u")).withColumn("layer", F.floor(F.col("f") / F.col("step")))
    rows = stored(rows, "members")
    parts = rows.groupBy("v", "root").agg(F.count("*").alias("n"), F.collect_set("layer").alias("layers"))
    groups = parts.groupBy("v").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("v", "main")
    outer = parts.join(groups, "v").groupBy("v").agg(F.first("main").alias("main"), F.array_distinct(F.flatten(F.collect_list("layers"))).alias("all_layers"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("root") != F.col("main"), F.col("layers"))))).alias("out_layers"))
    members = rows.join(stored(outer, "groups"), "v").withColumn("out", F.col("root") != F.col("main"))
    # the layers in which a partner may stand, if anything is shared
    low = F.floor((F.col("f") - 2 * less * 100 * F.col("nu") / s) / F.col("step"))
    high = lambda i: F.floor((2 * more * (F.col("nd") - i) - F.col("f")) / F.col("step"))
    partners = F.filter(F.when(F.col("out"), F.col("all_layers")).otherwise(F.col("out_layers")), lambda x: (x >= low) & (x <= high(F.lit(0))))
    members = members.withColumn("partners", partners).where(F.size("partners") > 0)
    members = stored(members.select("u", "v", "root", "out", "nu", "nd", "f", "step", "layer", "partners", "diff"), "apart")
    each = members.select("u", "v", F.explode("diff").alias("e"))
    common = stored(each.groupBy("v", "e").agg(F.count("*").alias("df")).where("df > 1"), "common")
    lists = each.join(common, ["v", "e"]).groupBy("u", "v").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("list"))
    placed = members.drop("diff").join(lists, ["u", "v"]).withColumn("alone", F.col("nd") - F.size("list")).select("*", F.posexplode("list").alias("at", "x"))
    placed = placed.withColumn("at", F.col("at") + F.col("alone")).withColumn("partners", F.filter("partners", lambda x: x <= high(F.col("at")))).where(F.size("partners") > 0)
    placed = stored(placed.select("u", "v", "root", "out", "nd", "f", "layer", "at", F.col("x.e").alias("e"), F.explode("partners").alias("other")), "placed")
    this = placed.where("out").select("v", "e", "layer", "other", F.col("u").alias("u1"), F.col("root").alias("r1"), (F.col("nd") - F.col("at")).alias("left1"), F.col("f").alias("f1"))
    that = placed.select("v", "e", F.col("layer").alias("other"), F.col("other").alias("layer"), F.col("u").alias("u2"), F.col("root").alias("r2"), (F.col("nd") - F.col("at")).alias("left2"), F.col("f").alias("f2"))
    met = this.join(that, ["v", "e", "layer", "other"]).where((F.col("r1") != F.col("r2")) & (2 * more * F.least("left1", "left2") >= F.col("f1") + F.col("f2")))
    pairs = stored(met.select(F.greatest("u1", "u2").alias("u"), F.least("u1", "u2").alias("v")).distinct(), "pairs")
    forget(rows, members, common, placed)
    return pairs


def link(rows: DataFrame, classes: DataFrame, k: int, similarity: int) -> DataFrame:
    """(node, root) of classes that are linked with a smaller one."""
    members = table_members(classes)
    sets = build_sets(rows, classes, members, k)
    can = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * similarity
    edges = lambda roots: roots.select(F.col("node").alias("u"), F.col("root").alias("v"))

    # the smallest class of a table, of all tables that a class has the most frequent one
    centres = stored(members.groupBy("table").agg(F.min(F.struct("set_id", "n")).alias("x")).select("table", F.col("x.set_id").alias("centre"), F.col("x.n").alias("m")), "centres")
    votes = members.join(centres, "table").where((F.col("set_id") != F.col("centre")) & can(F.col("n"), F.col("m"))).groupBy("set_id", "centre").agg(F.count("*").alias("tables"))
    best = votes.groupBy("set_id").agg(F.max_by("centre", F.struct("tables", "centre")).alias("centre"))
    tried = stored(best.select(F.col("set_id").alias("u"), F.col("centre").alias("v")), "pairs")
    links = confirm(tried, sets, similarity)
    roots = components(links)
    forget(centres, tried, links)

    # keys of several components: members and their pivots
    labelled = stored(members.select("table", "set_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("table", "set_id", F.coalesce("root", "set_id").alias("root")), "labelled")
    forget(members)
    parts = labelled.groupBy("table", "root").agg(F.count("*").alias("size"))
    pivots = stored(parts.groupBy("table").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("size", "root")).alias("v")).where("parts > 1").select("table", "v"), "pivots")
    related = stored(labelled.join(pivots, "table").where("set_id <> v").select(F.col("set_id").alias("u"), "v", "root").distinct(), "related")
    forget(labelled, pivots)
    if related.isEmpty():
        forget(sets)
        return roots
    # members of one component need no comparison with each other
    several = related.groupBy("v").agg((F.min("root") != F.max("root")).alias("wide"))
    near = around(related.join(several, "v").select("u", "v", "wide"), sets, similarity)
    forget(related)
    roots = components(edges(roots).unionByName(near.where("linked").select("u", "v")))
    pairs = apart(near.where("diff is not null"), roots, similarity)
    if not pairs.isEmpty():
        roots = components(edges(roots).unionByName(confirm(pairs, sets, similarity)))
    forget(sets, near, pairs)
    return roots


def near_duplicates(docs: DataFrame, k: int = WORDS, similarity: int = SIMILARITY, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """A row a document: key, doc_id, n_shingles, component_id, kept."""
    keyed = _keyed(docs)
    signed = stored(sign(keyed, k, hashes, rows), "signed")
    classes = stored(signed.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("key").alias("sample"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")), "classes")
    roots = link(keyed, classes, k, similarity)
    labels = stored(classes.select("set_id", "least").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root")), "labels")
    least = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(labels.join(least, "root").select("set_id", "component_id"), "named")
    forget(classes, labels)
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    # rows without a set are spread by their key instead of meeting as nulls
    joined = signed.where("set_id is not null").join(named, "set_id").select("key", "doc_id", "n_shingles", "set_id", "component_id")
    alone = signed.where("set_id is null").select("key", "doc_id", "n_shingles", "set_id", F.lit(None).cast("long").alias("component_id"))
    return joined.unionByName(alone).select("key", "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The documents' rows, one of each component, with all their columns. Rows
    with equal id and text are copies, of which one stays; empty texts all do."""
    kept = stored(near_duplicates(docs, k, similarity).where("kept").groupBy("key").agg(F.max("n_shingles").alias("n_shingles"), F.count("*").alias("copies")).select("key", F.expr("copies = 1 or n_shingles = 0").alias("whole")), "kept")
    own = Numbered(docs)
    rows = own.rows.withColumn("key", row_key(own.column("doc_id", "long"), F.coalesce(own.column("text", "string"), F.lit("")))).join(kept, "key")
    first = rows.where("not whole").groupBy("key").agg(F.first(F.struct(*own.names)).alias("x")).select("x.*")
    return own.restored(rows.where("whole").select(*own.names).unionByName(first))
