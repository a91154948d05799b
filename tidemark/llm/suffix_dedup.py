"""Removal of long repeated strings with a run-length index.

A string of ``LENGTH`` bytes that also starts anywhere else, in the same or any
other document, is removed wherever it stands. What repeats is found exactly, in
three steps that share no hot group:

1. *Parse.* Every window of ``LENGTH`` bytes is named by the smallest hash of
   its 32-byte strings; consecutive windows with one name form a region (a
   content-defined parse, so equal windows have equal names wherever they are).
   Equal regions are counted over the corpus, partially before the shuffle. A
   region that stands twice repeats as a whole, and one row stands for its
   copies in the index; a name that stands once only needs no more work. Left are
   *borders*: regions with a shared name and unequal bytes, where a repeat
   begins or ends.

2. *Run-length index.* Windows of borders are taken in blocks of ``BLOCK``
   neighbours. A block's windows share a core of LENGTH - BLOCK + 1 bytes, and
   only blocks with equal cores can have equal windows. Equal blocks are one row
   with a count. In the text of the index a core is one symbol, between the few
   bytes to its left and right; a window is ``BLOCK`` symbols with the core among
   them. For the blocks of a task the Burrows-Wheeler transform of this text is
   built and kept as runs, with suffix array samples and match lengths at the
   ends of runs. Matching statistics of each block's text are then streamed from
   the samples: between two sampled positions a match loses one symbol a step.
   Where a match against another place has BLOCK symbols or more, the window is a
   repeat.

3. *Cut.* Marked windows go back to their documents.

Passages are counted beside, and never cut: of each document's strings of
``SHINGLE`` words (lower-case A-Z, split at white space) those are chosen that
have the smallest hash of any ``PASSAGE - SHINGLE + 1`` neighbours (winnowing).
``n_repeats`` is how many of the chosen ones are chosen anywhere else too. A
passage of ``PASSAGE`` words that stands twice always has one, also where it is
shorter than ``LENGTH`` bytes or differs in white space and case; a document
without a repeated string of ``SHINGLE`` words has none.

Blocks of a core that very many different texts share are dealt anew as half
blocks with longer cores (``HOT``), down to single windows, which are equal or
not; so no core's rows have to meet in one task. Documents are known by a
128-bit hash of id and text, blocks and cores by 128-bit hashes of their bytes;
rows are never collected.

Defined results: a null text is empty; texts shorter than a string lose
nothing; a text longer than ``PARSE_BYTES`` is parsed in overlapping pieces,
with the same result; repeated rows repeat each other; other columns are
ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, forget, mixed, pick, row_key, stored, text_bytes

LENGTH = 400
GRAM = 32
BLOCK = 32
#: Words of a passage (over fifty), and of the strings that stand for it.
PASSAGE, SHINGLE = 51, 32
#: Different blocks of one core beyond which the core is dealt as half blocks.
HOT = 2_000
#: Text bytes parsed at once; a parse takes about 60 times as much memory.
PARSE_BYTES = 2 << 20

REGIONS = "key binary, name long, region binary, low int, width int, again boolean"
BLOCKS = "key binary, core binary, region binary, left binary, right binary, n int, starts array<int>"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` symbols from each place on: a polynomial, put
    together of powers of two."""
    part, n, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    out, size = None, 0
    while True:
        if gram & n:
            # what is there comes after this part
            out = part if out is None else part[: max(0, len(data) - size - n + 1)] * np.uint64(pow(base, size, 1 << 64)) + out[n:]
            size += n
        if 2 * n > gram:
            return mixed(out)
        part = part[:-n] * np.uint64(pow(base, n, 1 << 64)) + part[n:] if len(part) > n else part[:0]
        n *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place on, by block-wise prefix and
    suffix minima."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


class Parsed:
    """Texts as symbols one after another, their windows' names, and regions of
    equal names. ``shift``: where the symbols begin in their (only) document."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, gram: int, shift: int = 0):
        self.data, self.at, self.length, self.shift = data, at, length, shift
        self.reach = length - gram + 1
        self.hashes = gram_hashes(self.data, gram)
        names = sliding_min(self.hashes, self.reach)
        doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))[: len(names)]
        self.names = np.where(np.arange(len(names)) + length <= self.at[doc + 1], names, 0)
        start = np.flatnonzero(self.names)
        name, of = names[start], doc[start]
        first = np.ones(len(start), dtype=bool)
        first[1:] = (name[1:] != name[:-1]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(start)) - 1 if len(start) else begin
        self.low, self.high, self.name, self.doc = start[begin], start[end], name[begin], of[begin]

    def anchors(self) -> np.ndarray:
        """Places whose hash names a window around them."""
        if not len(self.names):
            return np.zeros(0, np.int64)
        edge = np.zeros(self.reach - 1, np.uint64)
        most = ~sliding_min(~np.concatenate([edge, self.names, edge]), self.reach)
        return np.flatnonzero((most == self.hashes[: len(most)]) & (most > 0))


def _pieces(data: np.ndarray, at: np.ndarray, length: int, gram: int, most: int) -> Iterator[Parsed]:
    """The symbols of a block's texts; those of one long text in pieces that
    overlap by a window but one symbol, so that each window is in one piece."""
    if len(at) == 2 and len(data) > most:
        for a in range(0, len(data) - length + 1, most):
            piece = data[a : a + most + length - 1]
            yield Parsed(piece, np.array([0, len(piece)]), length, gram, a)
    else:
        yield Parsed(data, at, length, gram)


def find_regions(docs: DataFrame, length: int, most: int) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=most):
            for p in _pieces(*text_bytes(block.column("text")), length, GRAM, most):
                view = memoryview(np.ascontiguousarray(p.data))
                region, again = [], []
                for a, b, v in zip(p.low.tolist(), p.high.tolist(), p.name, strict=True):
                    region.append(xxhash.xxh3_128_digest(view[a : b + length]))
                    again.append(np.count_nonzero(p.hashes[a : b + p.reach] == v) > 1)
                yield pa.RecordBatch.from_arrays(
                    [block.column("key").take(pa.array(p.doc)), pa.array(p.name.view(np.int64)), pa.array(region, pa.binary()), pa.array((p.low - p.at[p.doc] + p.shift).astype(np.int32)), pa.array((p.high - p.low).astype(np.int32)), pa.array(again, pa.bool_())],
                    names=["key", "name", "region", "low", "width", "again"],
                )

    return docs.mapInArrow(made, REGIONS)


def judge_regions(regions: DataFrame) -> DataFrame:
    """(region, whole, sample): regions that repeat as a whole, and borders. Of
    a whole region whose name also has other regions, one document (``sample``)
    stands in the index, for the others to match."""
    each = regions.groupBy("name", "region").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min("key").alias("sample"))
    # a row a distinct region: its copies are already summed up
    names = each.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = F.col("n") > 1
    return each.join(names, "name", "left").where(whole | F.col("again") | F.col("kinds").isNotNull()).select("region", whole.alias("whole"), F.when(F.col("kinds").isNotNull(), F.col("sample")).alias("sample"))


def find_blocks(docs: DataFrame, length: int, block: int, most: int) -> DataFrame:
    """``docs``: key, text, borders (array of low, width). A row a distinct
    block of a document, with the first windows at which it stands."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, most=most):
            wanted = {(d, y["low"]) for d, x in enumerate(part.column("borders").to_pylist()) for y in x}
            keys, found = part.column("key").to_pylist(), {}
            for p in _pieces(*text_bytes(part.column("text")), length, GRAM, most):
                view = memoryview(np.ascontiguousarray(p.data))
                lows = (p.low - p.at[p.doc] + p.shift).tolist()
                for k, d in enumerate(p.doc.tolist()):
                    if (d, lows[k]) not in wanted:
                        continue
                    low, high, base, limit = int(p.low[k]), int(p.high[k]), int(p.at[d]), int(p.at[d + 1])
                    after = low
                    for a in (low + np.flatnonzero(p.hashes[low : high + p.reach] == p.name[k])).tolist():
                        # windows from ``after`` to ``to`` have their leftmost anchor at a
                        to = min(high, a)
                        for b in range((a - to) // block, (a - after) // block + 1) if after <= to else ():
                            core = a - b * block  # the window with the least shift starts here
                            end = core - block + 1 + length
                            # the seed keeps blocks apart that differ in shift
                            c = xxhash.xxh3_128_digest(view[core:end], seed=b)
                            left, right = bytes(view[max(base, core - block + 1) : core]), bytes(view[end : min(limit, core + length)])
                            found.setdefault((d, c, left, right), []).append(core - base + p.shift)
                        after = max(after, a + 1)
                        if after > high:
                            break
            if found:
                of, cores, lefts, rights = zip(*found, strict=True)
                region = [xxhash.xxh3_128_digest(b"%d|" % len(x) + c + x + y) for c, x, y in zip(cores, lefts, rights, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[d] for d in of], pa.binary()), pa.array(cores, pa.binary()), pa.array(region, pa.binary()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), pa.array([len(x) for x in found.values()], pa.int32()), pa.array(list(found.values()), pa.list_(pa.int32()))],
                    names=["key", "core", "region", "left", "right", "n", "starts"],
                )

    return docs.mapInArrow(made, BLOCKS)


def find_shingles(docs: DataFrame, passage: int, shingle: int, most: int) -> DataFrame:
    """(key, shingles): hashes of a document's chosen strings of words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, most=most):
            words = Words(part.column("text"))
            hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.vocabulary.to_pylist()), dtype=np.uint64, count=len(words.vocabulary))
            of, chosen = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            before = np.zeros(0, np.int64)
            for p in _pieces(hashed[words.codes], words.offsets, passage, shingle, most):
                at = p.anchors()
                # a place that two pieces share may be chosen in both
                at, before = at[~np.isin(at + p.shift, before)], at + p.shift
                of.append(np.searchsorted(p.at, at, side="right") - 1)
                chosen.append(p.hashes[at])
            of, chosen = np.concatenate(of), np.concatenate(chosen)
            ends = np.append(0, np.cumsum(np.bincount(of, minlength=part.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(chosen.view(np.int64)))], names=["key", "shingles"])

    return docs.mapInArrow(made, "key binary, shingles array<long>")


def repeats(docs: DataFrame, passage: int = PASSAGE, shingle: int = SHINGLE, most: int = PARSE_BYTES) -> DataFrame:
    """(key, n_repeats) of documents with a chosen string that is chosen
    elsewhere too."""
    found = stored(find_shingles(docs, passage, shingle, most), "shingles")
    each = found.select("key", F.explode("shingles").alias("shingle"))
    twice = stored(each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle"), "twice")
    # repeated rows have one key and the same strings: each has its share
    rows = found.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    sums = each.join(twice, "shingle").groupBy("key").agg(F.count("*").alias("n"))
    out = stored(sums.join(rows, "key", "left").select("key", (F.col("n") / F.coalesce("rows", F.lit(1))).cast("long").alias("n_repeats")), "repeats")
    forget(found, twice)
    return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of an integer text in which
    every row ends with a symbol of its own, with samples at run ends.

    ``heads``/``lengths``: the runs; ``first``/``last``: suffix array at each
    run's first and last place; ``match_before``/``match_after``: symbols that
    the sampled suffix shares with the suffix before a run's first place and
    after its last place.
    """

    def __init__(self, text: np.ndarray, longest: int):
        n = len(text)
        order = _suffix_array(text, longest)
        before = text[order - 1]  # of position 0, the last symbol
        change = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        ends = np.append(change[1:], n) - 1
        self.n, self.heads, self.lengths = n, before[change], ends - change + 1
        self.first, self.last = order[change], order[ends]
        self.match_before, self.match_after = np.zeros(len(change), np.int64), np.zeros(len(change), np.int64)
        padded = np.append(text, np.full(longest, -1))
        same = _common(padded, order[change[1:] - 1], order[change[1:]], longest)
        self.match_before[1:], self.match_after[:-1] = same, same

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest match with any other position,
        streamed from the samples: where a position isn't sampled, its
        neighbour in suffix order is its predecessor's neighbour moved by one,
        and the match is shorter by one."""
        return np.maximum(self._stream(self.first, self.match_before), self._stream(self.last, self.match_after))

    def _stream(self, sampled: np.ndarray, match: np.ndarray) -> np.ndarray:
        order = np.argsort(sampled)
        at = sampled[order]
        places = np.arange(self.n)
        k = np.searchsorted(at, places, side="right") - 1
        return np.where(k >= 0, match[order][k] - (places - at[k]), 0)


def _suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """By prefix doubling; suffixes differ within ``longest`` symbols."""
    _, rank = np.unique(text, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step <= longest:
        follow = np.zeros(len(text), dtype=np.int64)
        follow[: len(text) - step] = rank[step:] + 1
        key = rank * (len(text) + 1) + follow
        order = np.argsort(key, kind="stable")
        new = np.append(False, key[order][1:] != key[order][:-1])
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == len(text) - 1:
            break
        step *= 2
    return order


def _common(padded: np.ndarray, a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
    """Symbols that the suffixes a and b share (``padded`` ends in ones of its
    own)."""
    out = np.zeros(len(a), dtype=np.int64)
    due = np.arange(len(a))
    for step in range(longest):
        due = due[padded[np.minimum(a[due] + step, len(padded) - 1)] == padded[np.minimum(b[due] + step, len(padded) - 1)]]
        if not len(due):
            break
        out[due] += 1
    return out


def repeated_windows(cores: list, lefts: list[np.ndarray], rights: list[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
    """Of distinct (core, left, right) blocks, the shifts whose windows stand in
    another block: shift j has j symbols to the left of the core. ``sizes`` is
    the number of windows of each full block."""
    n = len(cores)
    l_len, r_len = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    total = l_len + r_len + 2
    begin = np.concatenate([[0], np.cumsum(total)])
    text = np.empty(begin[-1], dtype=np.int64)
    at_core, at_end = begin[:-1] + l_len, begin[1:] - 1
    free = np.ones(len(text), dtype=bool)
    free[at_core] = free[at_end] = False
    known: dict = {}
    ids = np.array([known.setdefault(c, len(known)) for c in cores])
    # order of symbols: row ends (each its own), cores, bytes
    text[free] = 2 * n + np.concatenate([x for y in zip(lefts, rights, strict=True) for x in y]).astype(np.int64)
    text[at_core] = n + ids
    text[at_end] = np.arange(n)
    found = RunLengthIndex(text, int(total.max()) + 1).matching_statistics()
    out = []
    for k in range(n):
        # windows start j symbols before the core and are as many symbols as the block is wide
        low = max(0, int(sizes[k]) - 1 - int(r_len[k]))
        j = np.arange(low, int(l_len[k]) + 1)
        out.append(j[found[at_core[k] - j] >= sizes[k]])
    return out


def judge_blocks(found: DataFrame, block: int, hot: int = HOT) -> DataFrame:
    """(region, ranges): repeated windows of each distinct block, as ranges of
    shifts. ``found`` has region, core, left, right, n."""
    distinct = found.groupBy("region", "core", "left", "right").agg(F.sum("n").alias("n"))
    # of the block as first dealt: its region, and how its windows are shifted
    rows = stored(distinct.select("region", "core", "left", "right", F.col("n").cast("long"), F.lit(block).alias("size"), F.lit(0).alias("shift")), "blocks")
    marks = None
    while True:
        # halves of different blocks may be equal: they stand once, with all their uses
        texts = stored(rows.groupBy("core", "left", "right").agg(F.sum("n").alias("n"), F.max("size").alias("size")), "texts")
        crowd = stored(texts.groupBy("core").agg(F.count("*").alias("rows"), F.max("n").alias("most")).where("rows > 1 or most > 1"), "crowd")
        last = block == 1 or crowd.where(F.col("rows") > hot).isEmpty()
        few = texts.join((crowd if last else crowd.where(F.col("rows") <= hot)).select("core"), "core")
        judged = stored(few.repartition("core").sortWithinPartitions("core").mapInArrow(_marks, "core binary, left binary, right binary, ranges array<struct<low:int,high:int>>"), "judged")
        moved = F.transform("ranges", lambda r: F.struct((r["low"] + F.col("shift")).alias("low"), (r["high"] + F.col("shift")).alias("high")))
        back = stored(rows.join(judged, ["core", "left", "right"]).select("region", moved.alias("ranges")), "marks")
        marks = back if marks is None else marks.unionByName(back)
        halves = None if last else stored(rows.join(crowd.where(F.col("rows") > hot).select("core"), "core").select(*rows.columns).mapInArrow(_halves, rows.schema), "halves")
        forget(rows, texts, crowd, judged)
        if last:
            return marks.groupBy("region").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
        rows, block = halves, block // 2


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of half the width: windows with many symbols to the left have the
    nearest left ones in their core, the others the nearest right ones."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            half = row["size"] // 2
            left, right, core = row["left"], row["right"], row["core"]
            if len(left) >= half:
                out.append(row | {"core": xxhash.xxh3_128_digest(b"l" + core + left[len(left) - half :]), "left": left[:-half], "right": right[: half - 1], "size": half, "shift": row["shift"] + half})
            if len(right) >= half:
                out.append(row | {"core": xxhash.xxh3_128_digest(b"r" + core + right[:half]), "left": left[max(0, len(left) - half + 1) :], "right": right[half:], "size": half})
        yield pa.RecordBatch.from_pylist(out, schema=batch.schema)


#: Blocks of which one index is built at once; a core's blocks stay together.
INDEX_ROWS = 10_000


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct blocks, sorted by core -> the repeated windows of each."""

    schema = pa.schema([("core", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("ranges", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))])

    def judged(rows: list[dict]) -> pa.RecordBatch:
        # a core with one block has nothing to match but its own run
        alone = [x["core"] != y["core"] and x["core"] != z["core"] for x, y, z in zip(rows, [{"core": None}, *rows], [*rows[1:], {"core": None}], strict=False)]
        several = [x for x, one in zip(rows, alone, strict=True) if not one]
        sides = [[np.frombuffer(x[side], np.uint8) for x in several] for side in ("left", "right")]
        got = iter(repeated_windows([x["core"] for x in several], *sides, np.array([x["size"] for x in several])) if several else [])
        out = []
        for x, one in zip(rows, alone, strict=True):
            shifts = np.zeros(0, np.int64) if one else next(got)
            if x["n"] > 1:  # the block itself stands twice
                shifts = np.arange(max(0, x["size"] - 1 - len(x["right"])), len(x["left"]) + 1)
            if len(shifts):
                cut = np.flatnonzero(np.diff(shifts) > 1)
                ends = zip(shifts[np.append(0, cut + 1)].tolist(), shifts[np.append(cut, len(shifts) - 1)].tolist(), strict=True)
                out.append({"core": x["core"], "left": x["left"], "right": x["right"], "ranges": [{"low": a, "high": b} for a, b in ends]})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if len(rows) >= INDEX_ROWS and row["core"] != rows[-1]["core"]:
                yield judged(rows)
                rows = []
            rows.append(row)
    if rows:
        yield judged(rows)


def mark(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, hot: int = HOT, most: int = PARSE_BYTES) -> DataFrame:
    """key, spans (array of start, stop: bytes that repeat) of documents that
    have any; ``docs`` has key and text."""
    regions = stored(find_regions(docs, length, most), "regions")
    verdict = stored(judge_regions(regions), "verdict")
    work = regions.select("key", "region", "low", "width").join(verdict, "region")
    border = ~F.col("whole") | (F.col("key") == F.col("sample"))
    span = F.struct(F.col("low").alias("start"), (F.col("low") + F.col("width") + length).alias("stop"))
    # sets: repeated rows have one key
    work = stored(work.groupBy("key").agg(F.collect_set(F.when(F.col("whole"), span)).alias("spans"), F.collect_set(F.when(border, F.struct("low", "width"))).alias("borders")), "work")
    forget(regions, verdict)
    raw = stored(find_blocks(docs.join(work.where(F.size("borders") > 0).select("key", "borders"), "key"), length, block, most), "found")
    twice = stored(raw.groupBy("core").agg(F.sum("n").alias("uses")).where("uses > 1").select("core"), "cores")
    found = stored(raw.join(twice, "core").select(*raw.columns), "shared")
    forget(raw, twice)
    ranges = stored(judge_blocks(found, block, hot), "ranges")
    # a window that starts j bytes before the core
    spans = F.flatten(F.transform("starts", lambda at: F.transform("ranges", lambda r: F.struct((at - r["high"]).alias("start"), (at - r["low"] + length).alias("stop")))))
    windows = found.groupBy("key", "region").agg(F.flatten(F.collect_set("starts")).alias("starts")).join(ranges, "region").select("key", spans.alias("spans"))
    whole = work.where(F.size("spans") > 0).select("key", "spans")
    marks = stored(windows.unionByName(whole).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "marks")
    forget(found, ranges, work)
    return marks


def _merged(spans: pa.Scalar) -> list[list[int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    if spans.is_valid:
        s = spans.values
        for a, b in sorted(set(zip(s.field("start").to_pylist(), s.field("stop").to_pylist(), strict=True))):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
    return out


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:int,stop:int>>, n_repeats long"


def cut(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, hot: int = HOT, most: int = PARSE_BYTES, passage: int = PASSAGE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text bytes kept, what was removed, and how many strings of words
    repeat, for every document."""
    rows = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", row_key("doc_id", "text"))
    marks = mark(rows, length, block, hot, most).join(repeats(rows, passage, shingle, most), "key", "full")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            out = []
            for doc, text, spans, n in zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("spans"), part.column("n_repeats").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                kept, at, gone = [], 0, _merged(spans)
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc, len(raw), len(raw) - len(left), len(gone), left, [{"start": a, "stop": b} for a, b in gone], n or 0))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), SPANS, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed", "n_repeats"])

    joined = rows.join(marks, "key", "left").select("doc_id", "text", "spans", "n_repeats")
    return joined.mapInArrow(made, CUT)


def digests(cuts: DataFrame) -> DataFrame:
    return cuts.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeats")
