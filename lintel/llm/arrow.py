"""Row-wise Python over Arrow batches of bounded size, and hashed words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of a batch; texts may be long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, after lowering the session's Arrow batches to the bounds above if they are larger."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """df through a function of record batches, which make() builds once in each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            out = each(batch)
            if out is not None:
                yield out

    return bounded(df).mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _ODD)]))
    return _POWERS[:n]


class WordHasher:
    """64-bit hashes of the words of a text: runs of bytes that are no separators, A-Z lower-cased."""

    def __init__(self, separators: bytes) -> None:
        values = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
        lower = bytes(range(256)).lower()
        self.values = values[np.frombuffer(lower, np.uint8)]
        self.inside = np.ones(256, np.int8)
        self.inside[np.frombuffer(separators, np.uint8)] = 0
        self.translation = bytes(32 if i in separators else lower[i] for i in range(256))

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, first bytes and ends of the words."""
        raw = np.frombuffer(text, np.uint8)
        edges = np.diff(self.inside[raw], prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(starts):
            return np.empty(0, np.uint64), starts, ends
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        at = np.arange(first[-1] + sizes[-1])
        place = at - np.repeat(first, sizes)
        scaled = self.values[raw[place + np.repeat(starts, sizes)]] * _powers(int(sizes.max()))[place]
        return mixed(np.add.reduceat(scaled, first) + sizes.astype(np.uint64) * _ODD), starts, ends

    def words(self, text: bytes) -> list[bytes]:
        return text.translate(self.translation).split()


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of so many consecutive words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, length):
        out *= _ODD
        out += hashes[i : n + i]
    return mixed(out)


#: Separators of words [^\x20\x09-\x0D]+ and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
BLANK_BYTES = bytes([0x20, *range(0x09, 0x0E)])
NON_WORD_BYTES = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
