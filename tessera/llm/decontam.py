"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window's tokens are its 3-word shingles (a shorter window is its own token).  All of a window must occur, so the
length of its necessary prefix under any order is one: its rarest shingle by corpus count.  Documents meet the
windows on this shingle; its place in the window fixes where the window would begin, which must lie
inside the document (position and length bounds), and there the words themselves are compared.

The windows of one block of items travel with the tasks, so a document is read twice for each block (its shingles are
counted first) and is never shuffled; a block holds at most BLOCK_BYTES of item text, whatever the benchmark's size,
and the driver holds the first block and one more.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .support import materialize, sized

WINDOW = 10
SHINGLE = 3
#: Item text that travels with the tasks at once.
BLOCK_BYTES = 4 << 20

_DELETE = bytes(32 if K.NOT_ALNUM[K.LOWER[b]] else int(K.LOWER[b]) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased A-Z; words of digits, letters and all beyond ASCII."""
    return (text or "").encode().translate(_DELETE).split()


class Windows:
    """The distinct windows of a block of items, and the shingles they can be met on."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, shingle: int) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for name, words in items:
            n = min(window, len(words))
            for at in range(len(words) - n + 1) if n else ():
                owners[tuple(words[at : at + n])].add(name)
        self.words = list(owners)
        self.items = [sorted(owners[w]) for w in self.words]
        self.size = [min(shingle, len(w)) for w in self.words]
        text = b" ".join(b" ".join(w) for w in self.words)
        hashed = K.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64), K.NOT_ALNUM, lower=True).hash
        at = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        self.shingles = [K.window_hashes(hashed[a:b], s) for a, b, s in zip(at[:-1], at[1:], self.size, strict=True)]

    def tokens(self) -> dict[int, np.ndarray]:
        """By shingle length, every shingle of any window."""
        by: dict[int, list[np.ndarray]] = defaultdict(list)
        for s, h in zip(self.size, self.shingles, strict=True):
            by[s].append(h)
        return {s: np.unique(np.concatenate(h)) for s, h in by.items()}

    def prefixes(self, counts: dict[int, int]) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """By shingle length and rarest shingle: (window, the shingle's place in it)."""
        met: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for w, (s, h) in enumerate(zip(self.size, self.shingles, strict=True)):
            ranked = [(counts.get(x, 0), x, at) for at, x in enumerate(h.tolist())]
            _, token, at = min(ranked)
            met[s][token].append((w, at))
        return {s: dict(by) for s, by in met.items()}


class _Sieve:
    """Places of known hashes in a long row of hashes: a bit table first, exact search for what passes."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = np.sort(known)
        bits = max(16, int(len(known)).bit_length() + 6)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(known >> self.shift).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        found = np.searchsorted(self.known, hashes[at])
        found[found == len(self.known)] = 0
        return at[self.known[found] == hashes[at]]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, K.Words]]:
    buf, off = K.binary_column(batch, "text")
    for lo, hi in K.slices(off):
        part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        yield lo, hi, part, o, K.Words(part, o, K.NOT_ALNUM, lower=True)


def _counted(batches: Iterator[pa.RecordBatch], tokens: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """How often the task's documents have each shingle of a window."""
    total = {s: np.zeros(len(h), np.int64) for s, h in tokens.items()}
    sieves = {s: _Sieve(h) for s, h in tokens.items()}
    for batch in batches:
        for *_, words in _slices(batch):
            for s, sieve in sieves.items():
                h = K.window_hashes(words.hash, s)
                total[s] += np.bincount(np.searchsorted(sieve.known, h[sieve(h)]), minlength=len(sieve.known))
    for s, n in total.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(sieves[s].known[some].view(np.int64)), pa.array(n[some])], names=["token", "n"])


def _hits(batches: Iterator[pa.RecordBatch], windows: Windows, prefixes: dict[int, dict[int, list[tuple[int, int]]]]) -> Iterator[pa.RecordBatch]:
    """Of each document: words, and where which items' windows occur."""
    sieves = {s: _Sieve(np.array(list(by), np.uint64)) for s, by in prefixes.items()}
    span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
    for batch in batches:
        for lo, hi, part, _, words in _slices(batch):
            found: dict[int, tuple[set[tuple[int, int]], set[str]]] = {}
            text = part.tobytes().translate(_DELETE)
            for s, sieve in sieves.items():
                h = K.window_hashes(words.hash, s)
                places = sieve(h)
                docs = np.searchsorted(words.doc, places, "right") - 1
                for place, doc, token in zip(places.tolist(), docs.tolist(), h[places].tolist(), strict=True):
                    first, last = int(words.doc[doc]), int(words.doc[doc + 1])
                    for w, at in prefixes[s][token]:
                        start, size = place - at, len(windows.words[w])
                        if start < first or start + size > last:
                            continue
                        if text[words.start[start] : words.end[start + size - 1]].split() == list(windows.words[w]):
                            spans, items = found.setdefault(doc, (set(), set()))
                            spans.add((start - first, size))
                            items.update(windows.items[w])
            spans = [[{"start": a, "words": n} for a, n in sorted(found[d][0])] if d in found else [] for d in range(hi - lo)]
            items = [sorted(found[d][1]) if d in found else [] for d in range(hi - lo)]
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.diff(words.doc)), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "th", "n_words", "spans", "items"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, n_items, digest = [], [], []
        for spans, items in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            covered, end = 0, 0
            for a, b in sorted((s["start"], s["start"] + s["words"]) for s in spans or ()):
                covered += max(0, b - max(a, end))
                end = max(end, b)
            names = sorted(set(items or ()))
            hit.append(covered), n_items.append(len(names)), digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest), pa.array([x > 0 for x in hit])], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL").toLocalIterator(prefetchPartitions=False):
        words = words_of(row["text"])
        if words:
            block.append((row["item_id"], words))
            size += len(row["text"].encode())
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _searches(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> Iterator[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """For each block of items the search of a task's documents for its windows; one at least."""
    found = False
    for block in _blocks(items):
        found = True
        windows = Windows(block, window, shingle)
        tokens = windows.tokens()
        counts = docs.select("text").mapInArrow(lambda it, t=tokens: _counted(it, t), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
        prefixes = windows.prefixes({r["token"] & ((1 << 64) - 1): r["n"] for r in counts})
        yield lambda it, w=windows, p=prefixes: _hits(it, w, p)
    if not found:
        yield lambda it: _hits(it, Windows([], window, shingle), {})


_HIT = "doc_id long, th long, n_words long, spans array<struct<start:long,words:long>>, items array<string>"
_SUM = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def window_hits(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, n_words, spans of hit words, items) for each row of ``docs``, and again for each further block of items that
    hits it; ``th`` is xxhash64 of the text."""
    docs = _keyed(docs)
    searches = _searches(docs, items, window, shingle)
    out = docs.mapInArrow(next(searches), _HIT)
    for search in searches:
        out = out.unionByName(_written_hits(docs, search))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text")


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """How much of each document is benchmark text.

    Words are lower-cased (A-Z) runs of digits, letters and characters beyond ASCII.  A window is ``window``
    consecutive words of an item, or all of a shorter one.  Returns doc_id, n_words, n_hit (words inside any
    occurrence of a window), n_items, items_sha256 (of the item_ids, sorted as strings, comma-joined) and
    contaminated, a row for each row of ``docs`` (doc_id, text); of ``items`` it reads item_id and text.
    A null or wordless document has no hits; items with a null id or without words are passed over; rows that
    share an item_id are one item.  Rows that repeat a doc_id and its text are
    answered alike.
    """
    docs = _keyed(docs)
    searches = _searches(docs, items, window, shingle)
    first = next(searches)
    found = [_written_hits(docs, search) for search in searches]
    if not found:
        return docs.mapInArrow(lambda it: _summed(first(it)), _SUM)
    # a row for each document from the first block; of the others only documents with hits are left
    more = reduce(DataFrame.unionByName, found).groupBy("doc_id", "th").agg(F.flatten(F.collect_set("spans")).alias("m_spans"), F.flatten(F.collect_set("items")).alias("m_items"))
    more = sized(materialize(more.withColumnsRenamed({"doc_id": "m_id", "th": "m_th"}), "more"))
    base = docs.mapInArrow(first, _HIT)
    joined = base.join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
    both = lambda own, other: F.concat(own, F.coalesce(other, F.array().cast(_TYPES[own])))
    return joined.select("doc_id", "th", "n_words", both("spans", "m_spans").alias("spans"), both("items", "m_items").alias("items")).mapInArrow(_summed, _SUM)


_TYPES = {"spans": "array<struct<start:long,words:long>>", "items": "array<string>"}


def _written_hits(docs: DataFrame, search: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """A block's hits as a table: its windows need not be held beyond it."""
    return materialize(docs.mapInArrow(search, _HIT).where(F.size("spans") > 0), "hits")


def _clean(batches: Iterator[pa.RecordBatch], search: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """The rows whose texts have no window."""
    for batch in batches:
        at = 0
        asked = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64()), K.texts_of(batch).column(0)], names=["doc_id", "th", "text"])
        for hits in search(iter([asked])):
            clean = [not spans for spans in hits.column(3).to_pylist()]
            yield batch.slice(at, len(clean)).filter(pa.array(clean, pa.bool_()))
            at += len(clean)


def without_contaminated(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) that hold no window of an item, with all their columns.

    Each row is judged by its own text, whatever its id.  A null or wordless text stays.  Between blocks of items what is
    left is written, so that the driver holds one block's windows at a time.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema, last = rows.schema, None
    for search in _searches(docs.select("text"), items, window, shingle):
        if last is not None:
            rows = materialize(last, "left")
        last = rows.mapInArrow(lambda it, s=search: _clean(it, s), schema)
    return last.select("row.*")
