"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents, as distributed search engines cut theirs: each
block of documents is one *shard*, one row of a stored table, with the postings
of all its terms (term hash -> ascending word positions). Shards are written
once to the shared folder and serve any later test set:

``build_index``   documents -> shards (no shuffle);
``term_counts``   shards, test set -> postings of each test term in the whole
                  corpus (partial sums in each shard, then one sum a term);
``search``        shards, test set -> a row a document. For each test phrase
                  the posting list of its rarest term in the corpus is shifted
                  by the term's offset and then intersected with the shifted
                  lists of the other terms, from rare to frequent. What is left
                  are exact phrase matches.
``proximity``     shards, test set -> windows of documents in which enough
                  distinct terms of an item stand near each other, in any order.
``search_near``   both: the row of ``search`` with what ``proximity`` finds.

The test set is read in blocks of a bounded number of words, each a broadcast
of bounded size; results of all blocks are merged in the shard. A term that
stands in a third of all documents costs postings in every shard, never a group
in one task.

Defined results: null or wordless texts have no words and no hits; an item of
fewer words than the window, but not none, is one window; repeated items count
once by ``item_id``; an item whose id is null still hits words but is not
listed; an empty test set hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, byte_table, pick, stored

WINDOW = 10
#: Words of the test set in one broadcast block: at most about 100 MB.
BLOCK_WORDS = 500_000
#: Text bytes of a shard; one longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Shards of a row group, which a task holds as a whole when it writes or reads.
GROUP_SHARDS = 4

#: Everything in ASCII but digits and letters parts words.
PARTS_WORDS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))

SHARD = "doc_ids array<long>, n_words array<int>, terms array<long>, sizes array<int>, positions array<int>"
#: Postings, and windows around them, that one step of ``proximity`` holds.
STEP_POSTINGS, STEP_WINDOWS = 1 << 20, 10_000

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, item_ids array<long>, contaminated boolean"
NEAR = "n_near long, near_sha256 string, near_ids array<long>, near_terms long"


def term_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words)).view(np.int64)


def build_index(docs: DataFrame) -> DataFrame:
    """Shards of the positional index, stored in the shared folder."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=SHARD_BYTES):
            words = Words(block.column("text"), PARTS_WORDS)
            order = np.argsort(words.codes.astype(np.int32), kind="stable").astype(np.int32)
            sizes = np.bincount(words.codes, minlength=len(words.vocabulary)).astype(np.int32)
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(
                [one(block.column("doc_id"), pa.int64()), one(words.counts.astype(np.int32), pa.int32()), one(term_hashes(words.vocabulary), pa.int64()), one(sizes, pa.int32()), one(order, pa.int32())],
                names=["doc_ids", "n_words", "terms", "sizes", "positions"],
            )

    return stored(pick(docs, doc_id="long", text="string").mapInArrow(shards, SHARD), "postings", GROUP_SHARDS)


@dataclass
class Phrases:
    """A block of test phrases: the distinct windows as rows of term hashes
    (``lengths`` of each, padded by 0) and the items that hold each."""

    terms: np.ndarray
    lengths: np.ndarray
    items: list[list[int | None]]

    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate([t[:n] for t, n in zip(self.terms, self.lengths, strict=True)])) if len(self.terms) else np.zeros(0, np.int64)


def phrase_blocks(items: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The test set as blocks of at most ``most`` words (an item alone may have
    more), streamed through the driver."""

    def made(rows: list[tuple[int | None, np.ndarray]]) -> Phrases:
        found: dict[bytes, dict[int | None, None]] = {}
        for item, words in rows:
            for at in range(max(1, len(words) - window + 1)):
                found.setdefault(words[at : at + window].tobytes(), {})[item] = None
        terms = np.zeros((len(found), window), dtype=np.int64)
        lengths = np.zeros(len(found), dtype=np.int64)
        for k, key in enumerate(found):
            got = np.frombuffer(key, dtype=np.int64)
            terms[k, : len(got)], lengths[k] = got, len(got)
        return Phrases(terms, lengths, [list(x) for x in found.values()])

    rows, size = [], 0
    for x in pick(items, item_id="long", text="string").toLocalIterator():
        words = Words(pa.array([x.text], pa.string()), PARTS_WORDS)
        if len(words.codes):
            rows.append((x.item_id, term_hashes(words.vocabulary)[words.codes]))
            size += len(words.codes)
        if size >= most:
            yield made(rows)
            rows, size = [], 0
    if rows:
        yield made(rows)


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Postings in the corpus of each term of a (sorted, bounded) vocabulary."""
    wanted = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), dtype=np.int64)
        for batch in batches:
            terms, sizes = (batch.column(k).flatten().to_numpy() for k in (0, 1))
            at = np.minimum(np.searchsorted(wanted.value, terms), len(total) - 1)
            here = wanted.value[at] == terms
            total += np.bincount(at[here], weights=sizes[here], minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    if len(vocabulary):
        for row in index.select("terms", "sizes").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[row["at"]] = row["n"]
    return out


class Shard:
    """One row of the index, with posting lists by term."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda k: batch.column(k)[row].values
        self.doc_ids = get(0)
        self.n_words = get(1).to_numpy().astype(np.int64)
        terms, sizes, positions = (get(k).to_numpy() for k in (2, 3, 4))
        order = np.argsort(terms)
        self.terms = terms[order]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        self.starts, self.sizes = starts[:-1][order], sizes[order].astype(np.int64)
        self.positions = positions
        self.bounds = np.concatenate([[0], np.cumsum(self.n_words)])
        self.total = int(self.bounds[-1])

    def sequence(self) -> np.ndarray:
        """The slot at each position: the posting lists turned back."""
        out = np.empty(self.total, dtype=np.int32)
        by = np.argsort(self.starts)
        out[self.positions] = np.repeat(by, self.sizes[by])
        return out

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Slots of terms, -1 for those without postings here."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def shifted(self, slots: np.ndarray, offsets: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posting lists of the slots, each less its offset, with its owner."""
        n = self.sizes[slots]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[slots] - (ends - n), n)
        return self.positions[at].astype(np.int64) - np.repeat(offsets, n), np.repeat(owners, n)


@dataclass
class Bags:
    """The distinct terms of each phrase, rarest first (``sizes`` of each,
    padded by 0), and the items that hold each phrase."""

    terms: np.ndarray
    sizes: np.ndarray
    items: list[list[int | None]]


def bags(phrases: Phrases, rarity: np.ndarray) -> Bags:
    terms = np.take_along_axis(phrases.terms, np.maximum(rarity, 0), axis=1)
    order = np.argsort(terms, axis=1, kind="stable")
    ordered = np.take_along_axis(terms, order, axis=1)
    again = np.zeros(terms.shape, dtype=bool)
    np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
    keep = (rarity >= 0) & ~again
    left = np.argsort(~keep, axis=1, kind="stable")
    sizes = keep.sum(axis=1)
    terms = np.take_along_axis(terms, left, axis=1)
    return Bags(np.where(np.arange(terms.shape[1]) < sizes[:, None], terms, 0), sizes, phrases.items)


def intersect(shard: Shard, phrases: Phrases, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact phrase matches in a shard: (first word, phrase) of each.

    ``rarity``: for each phrase its offsets from the rarest term on. Lists are
    intersected for all phrases at once; a step touches only the starts that
    all rarer terms left.
    """
    slots = shard.find(phrases.terms)
    inside = np.arange(phrases.terms.shape[1]) < phrases.lengths[:, None]
    live = np.flatnonzero(((slots >= 0) | ~inside).all(axis=1))
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = rarity[live, 0]
    starts, owner = shard.shifted(slots[live, first], first, live)
    good = (starts >= 0) & (starts + phrases.lengths[owner] <= shard.total)
    starts, owner = starts[good], owner[good]
    for step in range(1, phrases.terms.shape[1]):
        if not len(starts):
            break
        offset = rarity[owner, step]
        due = np.flatnonzero(offset >= 0)
        keep = np.ones(len(starts), dtype=bool)
        keep[due] = holds(shard, slots[owner[due], offset[due]], starts[due] + offset[due])
        starts, owner = starts[keep], owner[keep]
    doc = np.searchsorted(shard.bounds, starts, side="right") - 1
    one = starts + phrases.lengths[owner] <= shard.bounds[doc + 1]  # never across documents
    return starts[one], owner[one]


def within(shard: Shard, slots: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each slot's posting list holds a position from ``first`` to
    before ``last``: a binary search in each list, all at once."""
    low, size = shard.starts[slots].astype(np.int64), shard.sizes[slots]
    high = low + size
    end = high.copy()
    for _ in range(int(size.max()).bit_length() if len(size) else 0):
        mid = (low + high) // 2
        less = (low < high) & (shard.positions[np.minimum(mid, len(shard.positions) - 1)] < first)
        low, high = np.where(less, mid + 1, low), np.where((low < high) & ~less, mid, high)
    return (low < end) & (shard.positions[np.minimum(low, len(shard.positions) - 1)] < last)


def holds(shard: Shard, slots: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Whether each slot's posting list holds the position."""
    return within(shard, slots, positions, positions + 1)


def _ranked(phrases: Phrases, vocabulary: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Offsets of each phrase's terms, rarest first, padded by -1."""
    inside = np.arange(phrases.terms.shape[1]) < phrases.lengths[:, None]
    n = np.where(inside, counts[np.minimum(np.searchsorted(vocabulary, phrases.terms), len(vocabulary) - 1)], np.iinfo(np.int64).max)
    order = np.argsort(n, axis=1, kind="stable")
    return np.where(np.take_along_axis(inside, order, axis=1), order, -1)


def _prepared(index: DataFrame, items: DataFrame, window: int) -> list:
    """Broadcast blocks of (phrases, rarity)."""
    sc = index.sparkSession.sparkContext
    out = []
    for phrases in phrase_blocks(items, window):
        vocabulary = phrases.vocabulary()
        out.append(sc.broadcast((phrases, _ranked(phrases, vocabulary, term_counts(index, vocabulary)))))
    return out


def _exact(shard: Shard, tests: list) -> list[pa.Array]:
    """Columns of ``RESULT`` for a shard."""
    edge = np.zeros(shard.total + 1, dtype=np.int64)
    items_of: dict[int, set[int]] = {}
    for test in tests:
        phrases, rarity = test.value
        starts, owner = intersect(shard, phrases, rarity)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + phrases.lengths[owner], -1)
        doc = np.searchsorted(shard.bounds, starts, side="right") - 1
        for d, k in set(zip(doc.tolist(), owner.tolist(), strict=True)):
            items_of.setdefault(d, set()).update(i for i in phrases.items[k] if i is not None)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    n_hit = hit[shard.bounds[1:]] - hit[shard.bounds[:-1]]
    return [shard.doc_ids.cast(pa.int64()), pa.array(shard.n_words), pa.array(n_hit), *_listed(items_of, len(n_hit)), pa.array(n_hit > 0)]


def _listed(items_of: dict[int, set[int]], n: int) -> list[pa.Array]:
    """Count, digest and ids (ascending as strings) of each document's items."""
    ids = [sorted(items_of.get(d, ()), key=str) for d in range(n)]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array(digest), pa.array(ids, pa.list_(pa.int64()))]


def search(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row a document: n_words, n_hit (words inside any phrase match),
    n_items, item_ids (ascending as strings), items_sha256, contaminated."""
    tests = _prepared(index, items, window)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays(_exact(Shard(batch, row), tests), names=[x.split()[0] for x in RESULT.split(", ")])

    return index.mapInArrow(match, RESULT)


def neighbours(shard: Shard, test: Bags, span: int, share: float) -> tuple[np.ndarray, ...]:
    """Windows of ``span`` words with ``share`` of a phrase's distinct terms:
    (document, phrase, first word in the shard, distinct terms), the earliest
    and the fullest around each seed.

    Terms without postings here are missed by every window. Of those present,
    the rarest one that a matching window holds is its seed: one of the first
    ``present - need + 1``. From each posting of a seed, the later terms are
    looked up within a span on both sides, rare ones first, until more are
    missed than the window can spare. Around the postings left, the span slides
    over every position that begins with a term of the phrase: any window
    can be cut to begin so and keeps its terms.
    """
    width = test.terms.shape[1]
    need = np.maximum(1, np.ceil(share * test.sizes)).astype(np.int64)
    slots = np.where(np.arange(width) < test.sizes[:, None], shard.find(test.terms), -1)
    have = (slots >= 0).sum(axis=1)
    live = np.flatnonzero(have >= need)
    slots, have, need = slots[live], have[live], need[live]
    slots = np.take_along_axis(slots, np.argsort(slots < 0, axis=1, kind="stable"), axis=1)
    found = [np.zeros((4, 0), dtype=np.int64)]
    sequence = shard.sequence() if len(live) else None
    around = np.arange(-span + 1, span)
    for seed in range(int((have - need).max()) + 1 if len(live) else 0):
        rows = np.flatnonzero(have - need >= seed)
        cuts = np.flatnonzero(np.diff(np.cumsum(shard.sizes[slots[rows, seed]]) // STEP_POSTINGS)) + 1
        for part in np.split(rows, cuts):
            at, of = shard.shifted(slots[part, seed], np.zeros(len(part), np.int64), part)
            doc = np.searchsorted(shard.bounds, at, side="right") - 1
            low, high = np.maximum(at - span + 1, shard.bounds[doc]), np.minimum(at + span, shard.bounds[doc + 1])
            spare = (have - need)[of] - seed
            for step in range(seed + 1, width):
                due = np.flatnonzero(step < have[of])
                if not len(due):
                    break
                spare[due] -= ~within(shard, slots[of[due], step], low[due], high[due])
                keep = spare >= 0
                at, of, doc, low, high, spare = (x[keep] for x in (at, of, doc, low, high, spare))
            for cut in range(0, len(at), STEP_WINDOWS):
                a, o, d, lo, hi = (x[cut : cut + STEP_WINDOWS, None] for x in (at, of, doc, low, high))
                place = a + around
                words = np.where((place >= lo) & (place < hi), sequence[np.clip(place, 0, shard.total - 1)], -2)
                hit = words[:, :, None] == slots[o[:, 0]][:, None, :]
                sums = np.concatenate([np.zeros((len(a), 1, width), np.int16), np.cumsum(hit, axis=1, dtype=np.int16)], axis=1)
                seen = (sums[:, span:] > sums[:, :span]).sum(axis=2)
                good = hit[:, :span].any(axis=2) & (seen >= need[o])
                some = np.flatnonzero(good.any(axis=1))
                first = place[some, good[some].argmax(axis=1)]
                found.append(np.stack([d[some, 0], live[o[some, 0]], first, np.where(good, seen, 0)[some].max(axis=1)]))
    return tuple(np.concatenate(found, axis=1))


def _near(shard: Shard, tests: list, span: int, share: float) -> dict[tuple[int, int | None], tuple[int, int]]:
    """(document's place, item) -> (first word of the earliest window, most
    distinct terms of any window)."""
    out: dict[tuple[int, int | None], tuple[int, int]] = {}
    for test in tests:
        doc, phrase, first, seen = neighbours(shard, test.value, span, share)
        pairs, which = np.unique(np.stack([doc, phrase]), axis=1, return_inverse=True)
        earliest, most = np.full(pairs.shape[1], np.iinfo(np.int64).max), np.zeros(pairs.shape[1], np.int64)
        np.minimum.at(earliest, which.ravel(), first)
        np.maximum.at(most, which.ravel(), seen)
        earliest -= shard.bounds[pairs[0]]
        for d, k, a, m in zip(*(x.tolist() for x in (*pairs, earliest, most)), strict=True):
            for i in test.value.items[k]:
                was = out.get((d, i), (a, m))
                out[d, i] = (min(a, was[0]), max(m, was[1]))
    return out


def _bagged(index: DataFrame, items: DataFrame, window: int) -> list:
    return [index.sparkSession.sparkContext.broadcast(bags(*test.value)) for test in _prepared(index, items, window)]


def proximity(index: DataFrame, items: DataFrame, span: int = 30, share: float = 0.8, window: int = 20) -> DataFrame:
    """Inexact matches: (doc_id, item_id, start, terms) where ``share`` of the
    distinct terms of a phrase of ``window`` words stand within ``span`` words
    of a document, in any order. ``start``: the first such window that begins
    with a term of its phrase; ``terms``: the most in any window."""
    tests = _bagged(index, items, window)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch, row)
                ids = shard.doc_ids.to_pylist()
                out = [(ids[d], i, a, m) for (d, i), (a, m) in _near(shard, tests, span, share).items()]
                cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "terms"])

    return index.mapInArrow(near, "doc_id long, item_id long, start long, terms long").groupBy("doc_id", "item_id").agg(F.min("start").alias("start"), F.max("terms").alias("terms"))


def search_near(index: DataFrame, items: DataFrame, span: int = 30, share: float = 0.8, window: int = 20) -> DataFrame:
    """The rows of ``search`` with the items that ``proximity`` finds in each
    document: n_near, near_sha256, near_ids, near_terms (the most in any
    window, 0 without a match)."""
    exact, tests = _prepared(index, items, WINDOW), _bagged(index, items, window)
    schema = f"{RESULT}, {NEAR}"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch, row)
                items_of: dict[int, set[int]] = {}
                terms = np.zeros(len(shard.n_words), dtype=np.int64)
                for (d, i), (_, m) in _near(shard, tests, span, share).items():
                    items_of.setdefault(d, set()).update([] if i is None else [i])
                    terms[d] = max(terms[d], m)
                yield pa.RecordBatch.from_arrays([*_exact(shard, exact), *_listed(items_of, len(terms)), pa.array(terms)], names=[x.split()[0] for x in schema.split(", ")])

    return index.mapInArrow(match, schema)
