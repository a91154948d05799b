"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

``encode_to_files`` deals documents into ``doc_id`` ranges, encodes each range
in one task and writes three flat files a range into the shared folder:

* ``part-NNNNN.ids``  token ids, little-endian unsigned, 16 bits if the
  vocabulary allows, else 32;
* ``part-NNNNN.off``  n+1 64-bit offsets, in ids, one for each document's start;
* ``part-NNNNN.doc``  n 64-bit document ids (the smallest value for null).

Files are written block by block and appear by rename, so a range's size isn't
held in memory, a repeated or speculative task is harmless, and no executor's
own disk holds a result. A text of more than a block goes to the encoder in
pieces cut at white space, where the tokenizer allows. ``bases`` turns the ranges' totals (a row
a range, never a row a document) into prefix sums, and ``read_back``
memory-maps the files again.

Defined results: a null text is empty and has the end id only; equal ``doc_id``
values stay beside each other, ordered by text; a null ``doc_id`` comes first;
repeated rows are written as often as they come; an empty table gives no file
and no row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, NewFile, Words, blocks, byte_table, map_file, pick, ragged_take, string_array, task_count, text_bytes, work_path

PARTS = "part int, path string, width int, n_docs long, n_tokens long"
BASES = PARTS + ", base long"
NULL_ID = -(1 << 63)
#: Distinct pieces whose ids a worker keeps; beyond, those of the latest blocks
#: stay as long as they are met again.
KEPT_PIECES = 100_000
#: Characters of a piece that is kept; longer ones are rare and encoded anew.
KEPT_CHARS = 64
#: Documents of one batch that is read back.
READ_ROWS = 10_000

#: Characters for which lower-casing, composition and classes of letters are
#: plain: printable ASCII and Latin-1 letters.
_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: The pre-tokeniser's pieces over those characters, lower-cased.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")
_IDENTITY = np.arange(256, dtype=np.uint8)
_IDENTITY[list(b"\t\n\v\f\r")] = 32
#: Classes of lower-cased bytes: letters (of two bytes those with lead C3),
#: digits, other printable ASCII, and what a word needs more than its bytes for:
#: white space, controls, other leads, and the apostrophe, which may open "'s".
_LETTER, _DIGIT, _OTHER, _HARD = range(4)
_CLASS = np.full(256, _HARD, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[ord("'")] = _HARD
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), 0xC3]] = _LETTER
_LOWER = byte_table(b"")
#: Second bytes behind C3: of capitals, and of the two signs among the letters.
_CAPITALS = np.isin(np.arange(256), np.arange(0x80, 0x9F))
_SIGNS = np.isin(np.arange(256), [0x97, 0xB7])


def _byte_characters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others take the code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts, by way of distinct words and their pieces.

    White space is dropped by this kind of tokenizer and never joins pieces,
    so ids of a text are the ids of its words in order. The distinct words of a
    block are cut into pieces together, as bytes; a distinct piece goes through
    the library's own model and its ids are kept. Words with an apostrophe are
    cut one by one. Words with any other character than printable ASCII and
    Latin-1 letters, and special tokens, take the library's full path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {i: c for i, c in enumerate(_byte_characters())}
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.by_word = self._splits_on_space()

    def _splits_on_space(self) -> bool:
        """Whether the tokenizer is of the kind described above; others are
        given whole texts."""
        probes = ("it's A b, 12\nÉté  they'll <x> 7th...", "don't WON'T 'tis we've I'm o'clock's 'S'LL", "a1b2 3.14 x==y (z) \\n //", "ÀÉÎÕÜß ÿ÷× naïve-ÇA", "\t tab\x0bvt \x0c \r\n end", "'' \"q\" `~!@#$%^&*()_+-={}[]|:;<>?,./")
        try:
            ids, counts = self._by_words(pa.array(probes), 0, "<u4")
            whole = [[*self.tokenizer.encode(x, add_special_tokens=False).ids, 0] for x in probes]
            return ids.tolist() == [i for x in whole for i in x] and counts.tolist() == [len(x) for x in whole]
        finally:
            self.known.clear()

    def _piece(self, piece: str) -> bytes:
        """A piece's ids, as unsigned 32-bit integers."""
        ids = self.known.get(piece)
        if ids is None:
            ids = self.before.get(piece)
            if ids is None:
                ids = array("I", [x.id for x in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
            if len(piece) <= KEPT_CHARS:
                self.known[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word that has more to it than its bytes."""
        if _PLAIN.fullmatch(word) and not any(x in word for x in self.special):
            return b"".join(map(self._piece, _PIECES.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _words(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, n+1 offsets, and the place of each word in these."""
        data, offsets = text_bytes(vocabulary)
        behind = np.concatenate([[False], data[:-1] == 0xC3]) if len(data) else np.zeros(0, bool)
        lower = _LOWER[data]
        lower[behind & _CAPITALS[data]] += 0x20
        kind = _CLASS[lower]
        kind[behind & _SIGNS[data]] = _HARD
        hard = np.diff(np.concatenate([[0], np.cumsum(kind == _HARD)])[offsets]) > 0
        for x in self.special:
            hard |= pc.match_substring(vocabulary, x).to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        if hard.any():
            own = np.repeat(~hard, sizes)
            lower, kind, sizes = lower[own], kind[own], sizes[~hard]
        # a piece starts with its word, where the class changes, and at a digit
        ends = np.concatenate([[0], np.cumsum(sizes)])
        starts = kind == _DIGIT
        starts[1:] |= kind[1:] != kind[:-1]
        starts[ends[:-1]] = True
        coded = string_array(lower, np.append(np.flatnonzero(starts), len(lower))).dictionary_encode()
        ids, bounds = _joined([self._piece(x) for x in coded.dictionary.to_numpy(zero_copy_only=False)])
        ids, lengths = ragged_take(ids, bounds, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        pieces = np.concatenate([[0], np.cumsum(starts)])[ends]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[pieces]
        more, more_bounds = _joined([self._word(x) for x in vocabulary.filter(pa.array(hard)).to_pylist()])
        place = np.empty(len(hard), np.int64)
        place[~hard] = np.arange(len(sizes))
        place[hard] = np.arange(len(sizes), len(hard))
        return np.concatenate([ids, more]), np.concatenate([bounds, len(ids) + more_bounds[1:]]), place

    def encode(self, texts: pa.Array, end: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and the count of each text."""
        if not self.by_word:
            lists = [[*x.ids, end] for x in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.fromiter((i for x in lists for i in x), dtype=dtype), np.array([len(x) for x in lists], dtype=np.int64)
        return self._by_words(texts, end, dtype)

    def _by_words(self, texts: pa.Array, end: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KEPT_PIECES:
            self.known, self.before = {}, self.known
        words = Words(texts, _IDENTITY)
        flat, ends, place = self._words(words.vocabulary)
        # the end id is a further word of every text
        n = len(words.counts)
        codes = np.insert(place[words.codes], words.offsets[1:], len(place))
        ids, lengths = ragged_take(np.append(flat, np.uint32(end)).astype(dtype), np.append(ends, len(flat) + 1), codes)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        bounds = sums[words.offsets + np.arange(n + 1)]
        return ids, np.diff(bounds)


def _joined(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of unsigned 32-bit ids, one after another, and n+1 offsets."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    return np.frombuffer(b"".join(lists), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def _pieces(texts: pa.Array, split: bool, most: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array, bool]]:
    """(first row, texts, whether they end their rows): a block as it is, or, of
    one long text, pieces of about ``most`` bytes, cut at white space."""
    raw = texts[0].as_buffer() if split and len(texts) == 1 and texts[0].is_valid else b""
    if len(raw) <= most:
        yield 0, texts, True
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        to = at + most
        while to < len(raw):  # the next white space
            found = re.search(rb"[ \t\n\v\f\r]", view[to : to + most])
            to = to + found.start() + 1 if found else to + most
            if found:
                break
        to = min(to, len(raw))
        yield 0, pa.array([str(view[at:to], "utf-8")]), to == len(raw)
        at = to


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_to_files(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the files; return a row a range: part, path (without suffix),
    width in bytes, n_docs, n_tokens. Runs at once."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    out_dir = (out_dir or work_path(spark, "tokens")).rstrip("/")
    largest = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1, end_id)
    width = 2 if largest < 1 << 16 else 4
    dtype = f"<u{width}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        path = f"{out_dir}/part-{part:05d}"
        files, n_docs, at = [], 0, 0
        try:
            for block in blocks(batches):
                if not files:
                    files = [NewFile(path + x) for x in (".ids", ".off", ".doc")]
                    files[1].write(np.zeros(1, "<i8"))
                counts = np.zeros(block.num_rows, np.int64)
                for row, texts, last in _pieces(block.column("text"), encoder.by_word):
                    got, n = encoder.encode(texts, end_id, dtype)
                    if not last:  # the end id follows a text's last piece
                        got, n = got[:-1], n - 1
                    files[0].write(got)
                    counts[row : row + len(n)] += n
                files[1].write((at + np.cumsum(counts)).astype("<i8"))
                files[2].write(block.column("doc_id").fill_null(NULL_ID).to_numpy().astype("<i8"))
                n_docs, at = n_docs + block.num_rows, at + int(counts.sum())
            for x in files:
                x.done()
        except BaseException:
            for x in files:
                x.drop()
            raise
        if files:
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "width": width, "n_docs": n_docs, "n_tokens": at}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = pick(docs, doc_id="long", text="string")
    first = F.col("doc_id").asc_nulls_first()
    # a text's beginning lets rows of one id go to several ranges
    ranged = rows.repartitionByRange(task_count(docs), first, F.substring("text", 1, 32)).sortWithinPartitions(first, "text")
    parts = ranged.mapInArrow(write, PARTS).collect()  # a row a range
    return spark.createDataFrame(parts, PARTS)


def bases(parts: DataFrame) -> DataFrame:
    """The ranges with the number of ids before each: prefix sums over one
    number a range, on the driver."""
    rows, base = [], 0
    for x in sorted(parts.collect(), key=lambda x: x.part):
        rows.append((*x, base))
        base += x.n_tokens
    return parts.sparkSession.createDataFrame(rows, BASES)


def read_back(based: DataFrame) -> DataFrame:
    """From the files: a row a document, doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of its ids as unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = map_file(row["path"] + ".ids", f"<u{row['width']}")
                offsets = map_file(row["path"] + ".off", "<i8")
                doc = np.array(map_file(row["path"] + ".doc", "<i8"))
                for a in range(0, len(doc), READ_ROWS):
                    own = np.array(offsets[a : a + READ_ROWS + 1])
                    crc = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                    ids_of = doc[a : a + READ_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(ids_of, mask=ids_of == NULL_ID), pa.array(own[:-1] + row["base"]), pa.array(np.diff(own)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
