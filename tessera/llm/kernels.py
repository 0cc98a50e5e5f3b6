"""Vectorised byte kernels shared by the text operators.

They work on the UTF-8 buffer of an Arrow column, a slice of a few MB at a time, so that no Python
object is made for a word.  A word's 64-bit hash comes from one running polynomial sum over the slice;
a window's hash from the same trick over the words' hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

# A worker outlives its tasks, and executors are sized by their largest hour: what is freed goes back to the system,
# not to a pool of Arrow's own, nor to the C library's heap.
pa.set_memory_pool(pa.system_memory_pool())
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library

    def _trim(_: int) -> int:
        return 0


#: Bytes of text that are looked at together; a longer document is a slice of its own.
SLICE = 1 << 20
#: Bytes over which one running sum goes.
PIECE = 1 << 19

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C13  # odd and 3 modulo 8: b - 1 has a single factor of two


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """base**i and its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = self._row(self.base, size), self._row(_inverse(self.base), size)
        return self.up, self.down

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        row = np.full(n, base & ((1 << 64) - 1), np.uint64)
        row[0] = 1
        return np.multiply.accumulate(row)


_IN_WORD, _IN_WINDOW = _Powers(_BASE), _Powers(0xD1342543DE82EF95)


#: Values and powers of a second hash.
OTHER_BYTE, OTHER_POWERS = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1), _Powers(0xA0761D6478BD642B)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(delimiters: Iterable[int]) -> np.ndarray:
    """True for the bytes that separate words."""
    table = np.zeros(256, bool)
    table[list(delimiters)] = True
    return table


#: [^\x20\x09-\x0D]+
SPACES = byte_table([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
NOT_ALNUM = byte_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z, all else unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_KEPT: dict[str, tuple[int, object]] = {}


def _stage() -> int:
    task = TaskContext.get()
    return task.stageId() if task else -1


def kept_for_stage(name: str, make: Callable[[], object]) -> object:
    """What the tasks of a stage share in a worker; it goes when the worker takes up another stage."""
    forget_others()
    if name not in _KEPT:
        _KEPT[name] = (_stage(), make())
    return _KEPT[name][1]


def forget_others() -> None:
    stage = _stage()
    for name in [n for n, (s, _) in _KEPT.items() if s != stage]:
        del _KEPT[name]


def binary_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a text column; a null is an empty text.  Called once for each batch."""
    forget_others()
    _trim(0)
    column = batch.column(batch.schema.get_field_index(name))
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(1, np.int64)
    if data is None or not len(off) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def texts_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The texts of whole rows, a struct column ``row``."""
    return pa.RecordBatch.from_arrays([pc.struct_field(batch.column(0), "text")], names=["text"])


def slices(off: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one row."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


class Words:
    """The words of consecutive documents: hash, byte range, and where each document's words begin."""

    __slots__ = ("hash", "start", "end", "doc")

    def __init__(self, buf: np.ndarray, off: np.ndarray, delimiters: np.ndarray, lower: bool, hashed: bool = True) -> None:
        buf = LOWER[buf] if lower else buf
        n, starts_at = len(buf), off[:-1]
        inside = ~delimiters[buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = starts_at[starts_at < n]
        first[at] = inside[at]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = off[1:][off[1:] > 0] - 1
        last[at] = inside[at]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, off)
        self.hash = self.hashes(buf, inside) if hashed else None

    def hashes(self, buf: np.ndarray, inside: np.ndarray, values: np.ndarray = _BYTE, powers: _Powers = _IN_WORD) -> np.ndarray:
        """Hashes of the words as they stand.  Piece by piece, so that what is held beside the text stays small.  Other
        ``values`` of the bytes and ``powers`` give hashes that collide elsewhere."""
        raw = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(raw):
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + PIECE, "right")))
            size = int(self.end[to - 1] - base)
            up, down = powers.upto(size + 1)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(values[buf[base : base + size]] * up[:size] * inside[base : base + size], out=total[1:])
            first = self.start[at:to] - base
            raw[at:to] = (total[self.end[at:to] - base] - total[first]) * down[first]
            at = to
        return mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, by the first word's place; runs may cross documents."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _IN_WINDOW.upto(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:n] + np.uint64(size))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of one document, sorted; a shorter one's whole sequence is its only shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(size, len(words))))
