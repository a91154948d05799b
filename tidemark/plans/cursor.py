"""A cursor over a pinned state: pages of top-k queries, no server-side state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from ..operators import resolve
from ..schema import Corruption, IOFailure, StoreError


class Cursor:
    """``seek``, ``next`` and ``prev`` in key order. Off either end the cursor is
    invalid until it is placed again; directions may change at any place. After
    a failed read it is invalid and ``error`` says why; iterating raises it."""

    def __init__(self, changes: DataFrame, snapshot: int, page: int = 1000, order: Callable[[Column], Column] = lambda key: key, close: Callable[[], None] = lambda: None):
        self.changes, self.snapshot, self.page, self.order = changes, snapshot, page, order
        self.error: StoreError | None = None
        self._rows: list[Row] = []
        self._at = -1
        self._close = close

    def close(self) -> None:
        """Give the runs free that the cursor reads."""
        self._rows, self._at = [], -1
        self._close()

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def _load(self, low: bytes | None, above: bytes | None, below: bytes | None, reverse: bool) -> None:
        rows, key = self.changes, self.order(F.col("key"))
        for bound, test in ((low, key.__ge__), (above, key.__gt__), (below, key.__lt__)):
            if bound is not None:
                rows = rows.where(test(self.order(F.lit(bytearray(bound)))))
        self.error = None
        try:
            got = resolve.scan(rows, self.snapshot, reverse=reverse, sort_key=self.order).limit(self.page).collect()
        except (PySparkException, Py4JJavaError) as e:
            text = str(e)
            damaged = any(x in text.lower() for x in ("checksum", "crc", "not a parquet", "corrupt", "cannot_read_file_footer"))
            self.error = (Corruption if damaged else IOFailure)(text[:300])
            got = []
        self._rows = got[::-1] if reverse else got
        self._at = (len(got) - 1 if reverse else 0) if got else -1

    @property
    def valid(self) -> bool:
        return self._at >= 0

    @property
    def key(self) -> bytes:
        return bytes(self._rows[self._at].key)

    @property
    def value(self) -> bytes:
        return bytes(self._rows[self._at].value)

    def seek_to_first(self) -> Cursor:
        self._load(None, None, None, False)
        return self

    def seek_to_last(self) -> Cursor:
        self._load(None, None, None, True)
        return self

    def seek(self, target: bytes) -> Cursor:
        self._load(target, None, None, False)
        return self

    def next(self) -> Cursor:
        if self._at + 1 < len(self._rows):
            self._at += 1
        else:
            self._load(None, self.key, None, False)
        return self

    def prev(self) -> Cursor:
        if self._at > 0:
            self._at -= 1
        else:
            self._load(None, None, self.key, True)
        return self

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        self.seek_to_first()
        while self.valid:
            yield self.key, self.value
            self.next()
        if self.error:
            raise self.error
