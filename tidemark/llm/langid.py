"""Language ID by interpolated Kneser-Ney character models.

Texts are lower-cased and cut into words (letters; framed by a start and an end
sign). For each language a character model of order 5 over framed words has
interpolated Kneser-Ney probabilities, with continuation counts below the
highest order. All languages' models are stored together in sorted arrays of
64-bit n-gram hashes, one for each order: the interpolated log probability of
each n-gram in each language, and the weights that contexts leave to the next
shorter order. A lookup is one binary search for all languages.

A text's language is the one with the lowest cross-entropy per character. Its
probability comes from the differences, scaled by one number that is fitted on
held-back texts (calibration); texts whose cross-entropy or probability lies
beyond what those texts showed are rejected (``accepted`` false), but keep their
best language.

A fit takes a bounded sample: about ``sample`` documents a language, those with
the smallest hashes of their ids (parameter). N-grams are counted in Spark with
partial sums; all counts of so many documents come to the driver, none is cut
off by how often it is or by what other languages have. All documents are
predicted, over their whole texts.

Defined results: ``und`` and score 0 for a null text or one without letters,
and for all texts if nothing can be learned; equal cross-entropies go to the
language that comes first in order; repeated rows are predicted alike; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, byte_table, mixed, pick, stored

ORDER = 5
START, END = 2, 3
#: Documents of each language that a fit takes, in expectation.
SAMPLE = 2_500
SEED = 29

#: Everything in ASCII but letters parts words (texts are lower-cased before).
PARTS_LETTERS = byte_table(bytes(b for b in range(128) if not chr(b).isalpha()))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def letter_words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(pc.fill_null(texts, "")), PARTS_LETTERS)


def has_letter(texts: pa.Array) -> np.ndarray:
    found = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
    return found.to_numpy(zero_copy_only=False)


def framed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of start sign, word, end sign of all words, and the place of
    each within its word."""
    one = ("\x02" + "\x03\x02".join(words.to_pylist()) + "\x03") if len(words) else ""
    symbols = np.frombuffer(one.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    starts = np.flatnonzero(symbols == START)
    place = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    return symbols, place


def gram_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each place (the first n-1 are not
    meaningful)."""
    out = np.zeros(len(symbols), dtype=np.uint64)
    for back in range(n - 1, -1, -1):
        out[back:] = (out[back:] + symbols[: len(symbols) - back] + np.uint64(1)) * _STEP if back else (out + symbols + np.uint64(1)) * _STEP
    return mixed(out ^ np.uint64(n))


@dataclass
class Model:
    languages: list[str]
    #: by order n: hashes of n-grams, ascending; log2 probability by language
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    #: by order n: hashes of (n-1)-symbol contexts; log2 weight left over
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    left: dict[int, np.ndarray] = field(default_factory=dict)
    unseen: np.ndarray | None = None
    sharpness: float = 1.0
    worst: float = np.inf
    least: float = 0.0

    def word_bits(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word (with its end sign) in each language, and symbols."""
        symbols, place = framed(words)
        bits = np.zeros((len(symbols), len(self.languages)), dtype=np.float64)
        due = np.flatnonzero(place > 0)
        for n in range(ORDER, 0, -1):
            if not len(due):
                break
            here = due[place[due] >= n - 1]
            hashes = gram_hashes(symbols, n)
            at, found = _find(self.grams[n], hashes[here])
            bits[here[found]] -= self.logs[n][at[found]]
            rest = here[~found]
            if n > 1 and len(rest):
                at, found = _find(self.contexts[n], gram_hashes(symbols, n - 1)[rest - 1])
                bits[rest[found]] -= self.left[n][at[found]]
            elif n == 1:
                bits[rest] -= self.unseen
            keep = np.ones(len(symbols), dtype=bool)
            keep[here] = False
            due = np.sort(np.concatenate([due[keep[due]], rest]))
        ends = np.flatnonzero(symbols == END)
        total = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0)])
        starts = np.flatnonzero(symbols == START)
        return total[ends + 1] - total[starts], ends - starts

    def cross_entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol of each text in each language, and its symbols."""
        words = letter_words(texts)
        bits, symbols = self.word_bits(words.vocabulary)
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(bits[words.codes], axis=0)])
        n = np.concatenate([[0], np.cumsum(symbols[words.codes])])
        count = n[words.offsets[1:]] - n[words.offsets[:-1]]
        return (sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / np.maximum(count, 1)[:, None], count

    def probability(self, entropies: np.ndarray, count: np.ndarray) -> np.ndarray:
        logits = -entropies * (self.sharpness * np.sqrt(np.maximum(count, 1)))[:, None]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over framed words of the documents: all grams of 1 to
    ``ORDER`` symbols that end at a predicted symbol. Summed in each task, then
    once for each gram."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            langs = block.column("lang").dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            words = letter_words(block.column("text"))
            vocabulary = words.vocabulary.to_pylist()
            doc = np.repeat(of, words.counts)
            for k, name in enumerate(names):
                times = np.bincount(words.codes[doc == k], minlength=len(vocabulary))
                grams: dict[str, int] = {}
                for w in np.flatnonzero(times).tolist():
                    word, t = f"\x02{vocabulary[w]}\x03", int(times[w])
                    for end in range(2, len(word) + 1):
                        for n in range(1, min(ORDER, end) + 1):
                            gram = word[end - n : end]
                            grams[gram] = grams.get(gram, 0) + t
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])

    return docs.mapInArrow(made, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: pd.DataFrame, languages: list[str]) -> Model:
    """Interpolated Kneser-Ney tables from (lang, gram, n)."""
    model = Model(languages)
    counts = counts.assign(size=counts.gram.str.len(), head=counts.gram.str[:-1], tail=counts.gram.str[1:])
    symbols = max(2, counts.loc[counts["size"] == 1, "gram"].nunique() + 1)
    uniform = 1.0 / symbols
    model.unseen = np.full(len(languages), np.log2(uniform))
    below: pd.DataFrame | None = None
    for n in range(1, ORDER + 1):
        own = counts[counts["size"] == n]
        # how often: as counted for the highest order and for grams at a
        # word's start, else the number of symbols seen before the gram
        longer = counts[counts["size"] == n + 1].groupby(["lang", "tail"]).size().rename("c")
        own = own.merge(longer, how="left", left_on=["lang", "gram"], right_index=True)
        raw = own.gram.str.startswith("\x02") if n < ORDER else pd.Series(True, index=own.index)
        own = own.assign(c=np.where(raw, own.n, own.c.fillna(1.0)).astype(float))
        probs, lefts = [], []
        for lang in languages:
            g = own[own.lang == lang]
            ones, twos = (g.c == 1).sum(), (g.c == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            total = g.groupby("head").c.agg(["sum", "size"])
            left = discount * total["size"] / total["sum"]
            probs.append(((g.c - discount) / g["head"].map(total["sum"])).set_axis(g.gram).rename(lang))
            lefts.append(left.rename(lang))
        alpha = pd.concat(probs, axis=1).fillna(0.0) if probs else pd.DataFrame()
        left = pd.concat(lefts, axis=1).fillna(1.0)
        if n == 1:
            full = alpha + left.to_numpy() * uniform if len(left) else alpha
            model.unseen = np.log2(left.to_numpy()[0] * uniform) if len(left) else model.unseen
        else:
            weights = left.reindex(alpha.index.str[:-1]).to_numpy()
            full = alpha + weights * below.reindex(alpha.index.str[1:]).to_numpy()
        below = full
        model.grams[n], model.logs[n] = _table(full, n)
        if n > 1:
            model.contexts[n], model.left[n] = _table(left, n - 1)
    return model


def _table(frame: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by gram as (ascending hashes, log2)."""
    if not len(frame):
        return np.zeros(0, np.uint64), np.zeros((0, frame.shape[1]))
    symbols = np.frombuffer("".join(frame.index).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    hashes = gram_hashes(symbols, n)[n - 1 :: n]
    order = np.argsort(hashes)
    return hashes[order], np.log2(frame.to_numpy())[order]


def fit(train: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``train`` (doc_id, text, lang; rows without lang are left
    out). A fifth of the sample is held back for calibration."""
    rows = pick(train, doc_id="long", text="string", lang="string").where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return Model([])
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int((1 << 30) * min(1.0, sample / n)))) for k, n in sizes.items()])
    taken = stored(rows.where(part < limit), "langid")
    held = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(5)) == 0
    counts = stored(count_grams(taken.where(~held)), "grams").toArrow().to_pandas()  # of the sample alone
    if not len(counts):
        return Model([])
    model = kneser_ney(counts, [x for x in languages if x in set(counts.lang)])
    _calibrate(model, taken.where(held))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Fit the scale of probabilities and the limits of acceptance."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = {x: i for i, x in enumerate(model.languages)}

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            entropies, count = shared.value.cross_entropies(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("lang"), pa.array(count), pa.array(list(entropies), pa.list_(pa.float64()))], names=["lang", "n", "h"])

    got = rows.mapInArrow(made, "lang string, n long, h array<double>").where("n > 0").toPandas()  # a fifth of the sample
    got = got[got.lang.isin(list(names))]
    if not len(got):
        return
    h, count, true = np.stack(got.h.to_numpy()), got.n.to_numpy(), got.lang.map(names).to_numpy()

    def loss(sharpness: float) -> float:
        model.sharpness = sharpness
        p = model.probability(h, count)[np.arange(len(true)), true]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    model.sharpness = min((0.05 * 1.3**k for k in range(24)), key=loss)
    own = h[np.arange(len(true)), true]
    model.worst = float(np.quantile(own, 0.999)) * 1.05
    model.least = float(np.quantile(model.probability(h, count).max(axis=1), 0.001))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits (per symbol), accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of the sample

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for block in blocks(batches):
            texts = block.column("text")
            known = has_letter(texts)
            best, score, bits = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.zeros(len(texts))
            if model.languages:
                entropies, count = model.cross_entropies(texts)
                p = model.probability(entropies, count)
                best = np.where(known, entropies.argmin(axis=1), best)
                score = np.where(known, p.max(axis=1), 0.0)
                bits = np.where(known, entropies.min(axis=1), 0.0)
            accepted = known & (best < len(names) - 1) & (bits <= model.worst) & (score >= model.least)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(bits), pa.array(accepted)], names=["doc_id", "lang_pred", "score", "bits", "accepted"])

    return pick(docs, doc_id="long", text="string").mapInArrow(made, "doc_id long, lang_pred string, score double, bits double, accepted boolean")
