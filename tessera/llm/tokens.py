"""Token ids as flat binary shards.

Documents are dealt by ranges of doc_id; each task encodes its range and writes

    shard-<n>.bin   the ids, little-endian unsigned 16-bit integers if the vocabulary fits, else 32-bit
    shard-<n>.off   64-bit offsets into it: where each document begins, and the end
    shard-<n>.doc   64-bit doc_ids (the smallest bigint for null)

and reports their sizes, a row for each shard.  The base of a shard, the ids in all shards before it, is a
prefix sum over these rows and stands in manifest.json.  A task that runs again writes files of another name;
only reported files are in the manifest.

The tokenizers library encodes; what it has made of a run of non-space characters is remembered under the run's 64-bit
hash, as most runs come again.  A second hash stands beside it: runs that share the first and not the second send their
documents to the library whole.  The byte-level pre-tokenizer cuts before each single space or newline, and between a
letter or digit and punctuation, so that such runs are encoded as they would be in their text; a text in which white
space touches white space, or that spells an added token, goes to the library whole, and so does every text if the
file's pre-tokenizer or normalizer is another.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .support import shuffle_parts

#: What stands for a null doc_id in a shard.
NULL_ID = -(1 << 63)
#: Runs that a worker remembers, by 64-bit hash: some 60 MB; and how many are merged into the rest at once.
REMEMBERED = 2_000_000
RECENT = 200_000
#: Bytes of text whose runs are told apart together.
PACK = 1 << 22

_PUNCTUATION = K.byte_table(b for b in range(33, 127) if not chr(b).isalnum())
_ALNUM = K.byte_table(b for b in range(128) if chr(b).isalnum())
_BREAKS = K.byte_table([10, 32])
#: White space beyond space and newline: bytes, and what is longer as UTF-8.
_OTHER = K.byte_table([0, 9, 11, 12, 13, 28, 29, 30, 31])
_LONG_SPACES = [c.encode() for c in "\x85\xa0\u1680\u202f\u205f\u3000"] + [b"\xe2\x80"]


#: What tells a run after a space from the same run without one.
_SPACED = np.uint64(0x5851F42D4C957F2D)


def _odd(buf: np.ndarray, off: np.ndarray, added: list[bytes] | None = None) -> np.ndarray:
    """Documents in which white space touches white space or an end of the text, or is other than space and newline, or that
    spell one of the ``added`` tokens."""
    odd = np.zeros(len(off) - 1, bool)
    if not len(buf):
        return odd
    breaks = _BREAKS[buf]
    beside = np.append(breaks[1:], True)
    ends = off[1:][np.diff(off) > 0] - 1
    starts = off[:-1][np.diff(off) > 0]
    beside[ends] = True
    at = [np.flatnonzero(breaks & beside), starts[breaks[starts]], np.flatnonzero(_OTHER[buf])]
    raw = buf.tobytes()
    for space in [*_LONG_SPACES, *(added or [])]:
        found = raw.find(space)
        while found >= 0:
            at.append(np.array([found]))
            found = raw.find(space, found + 1)
    odd[np.searchsorted(off, np.concatenate(at), "right") - 1] = True
    return odd


def _runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: document, start, end, hash and second hash.  A run has no space or newline; punctuation at its end, after a letter or
    digit, is a run of its own."""
    words = K.Words(buf, off, _BREAKS, lower=False, hashed=False)
    start, end = words.start, words.end
    if len(start):
        solid = np.maximum.accumulate(np.where(_PUNCTUATION[buf], -1, np.arange(len(buf))))[end - 1]
        cut = np.flatnonzero((solid >= start) & (solid < end - 1))
        cut = cut[_ALNUM[buf[solid[cut]]]]
        start, end = np.insert(start, cut + 1, solid[cut] + 1), np.insert(end, cut, solid[cut] + 1)
    words.start, words.end = start, end
    inside = ~_BREAKS[buf]
    return np.searchsorted(off, start, "right") - 1, start, end, words.hashes(buf, inside), words.hashes(buf, inside, K.OTHER_BYTE, K.OTHER_POWERS)


class _Memory:
    """Ids of runs by the runs' hash: two sorted levels over one store of ids."""

    def __init__(self, dtype: np.dtype) -> None:
        none = np.zeros(0, np.int64)
        self.levels = [(np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64))] * 2
        self.ids, self.used = np.zeros(1 << 16, dtype), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin (-1 if unknown) and count of the ids of sorted hashes."""
        begin, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for known, at, n, _ in self.levels:
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[place] == hashes
                begin[hit], count[hit] = at[place[hit]], n[place[hit]]
        return begin, count

    def differs(self, hashes: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Whether a run of the same hash, with or without a space before it, is remembered with another second hash."""
        out = np.zeros(len(hashes), bool)
        for asked in (hashes, hashes ^ _SPACED):
            order = np.argsort(asked)
            for known, _, _, second in self.levels:
                if len(known):
                    place = np.minimum(np.searchsorted(known, asked[order]), len(known) - 1)
                    out[order] |= (known[place] == asked[order]) & (second[place] != check[order])
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Remember the ids of sorted new hashes; where they begin."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, len(ids)), self.ids.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.levels[1] = self._merged(self.levels[1], (hashes, begin, count, check))
        if len(self.levels[1][0]) > RECENT:
            self.levels = [self._merged(*self.levels), (hashes[:0], begin[:0], count[:0], check[:0])]
        return begin

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        hashes = np.concatenate([a[0], b[0]])
        order = np.argsort(hashes, kind="stable")  # two sorted runs: a merge
        return hashes[order], *(np.concatenate([a[i], b[i]])[order] for i in (1, 2, 3))

    def __len__(self) -> int:
        return sum(len(level[0]) for level in self.levels)


class Encoder:
    """Texts to ids, a slice of documents at a time."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.newline = self._library(["\n"])[0]
        rules = json.loads(self.tokenizer.to_str())
        cuts = rules.get("pre_tokenizer") or {}
        plain = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space") and not rules.get("normalizer")
        #: Only with a byte-level vocabulary whose newline is one id can runs be told apart in one call.
        self.joined = bool(plain) and len(self.newline) == 1
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.memory = _Memory(self.dtype)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs, one after the other, and how many each has: encoded joined by newlines, in a few calls."""
        ids, counts = [], []
        for at in range(0, len(runs), 8192):
            found = self._library([b"\n".join(runs[at : at + 8192]).decode()])[0]
            cuts = np.flatnonzero(found == self.newline[0])
            counts.append(np.diff(np.concatenate([[-1], cuts, [len(found)]])) - 1)
            ids.append(np.delete(found, cuts))
        return np.concatenate(ids), np.concatenate(counts)

    def __call__(self, buf: np.ndarray, off: np.ndarray, eos: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each with ``eos`` at its end, and how many each has."""
        n = len(off) - 1
        odd = _odd(buf, off, self.added) if self.joined else np.ones(n, bool)
        doc, start, end, h, check = _runs(buf, off)
        plain = ~odd[doc]
        if plain.any():
            # a hash that two runs share, here or with what is remembered: their documents are odd
            kind, kinds = pd.factorize(h)
            first = np.empty(len(kinds), np.uint64)
            first[kind[::-1]] = check[::-1]
            doubtful = (first[kind] != check) | self.memory.differs(kinds, first)[kind]
            odd[doc[doubtful]] = True
            plain = ~odd[doc]
        doc, start, end, h, check = doc[plain], start[plain], end[plain], h[plain], check[plain]
        # a run's leading space is part of it; a newline before it is an id of its own
        before = np.where(start > off[doc], buf[np.maximum(start - 1, 0)], 0)
        space, line = before == 32, (before == 10).astype(np.int64)
        which, kinds = pd.factorize(h ^ np.where(space, _SPACED, np.uint64(0)))
        order = np.argsort(kinds)
        kinds, rank = kinds[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which = rank[which]
        if len(self.memory) > REMEMBERED:
            self.memory = _Memory(self.dtype)
        begin, count = self.memory.find(kinds)
        new = np.flatnonzero(begin < 0)
        if len(new):
            first = np.empty(len(kinds), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            raw, at = buf.tobytes(), first[new]
            ids, counts = self._encoded([raw[a:b] for a, b in zip((start[at] - space[at]).tolist(), end[at].tolist(), strict=True)])
            begin[new], count[new] = self.memory.add(kinds[new], ids, counts, check[at]), counts
        flat = self.memory.ids
        some = np.flatnonzero(odd).tolist()
        raw = buf.tobytes() if some else b""
        whole = dict(zip(some, self._library([raw[off[d] : off[d + 1]].decode() for d in some]), strict=True))

        mine = count[which] if len(which) else np.zeros(0, np.int64)
        sizes = np.bincount(doc, mine + line, n).astype(np.int64) + 1
        for d, x in whole.items():
            sizes[d] += len(x)
        at = np.cumsum(sizes) - sizes
        out = np.full(int(sizes.sum()), eos, self.dtype)
        for d, x in whole.items():
            out[at[d] : at[d] + len(x)] = x
        if len(doc):
            # where each run goes: its document's place, and what the runs before it in the document take
            run = np.cumsum(mine + line) - mine - line
            lead = np.searchsorted(doc, np.arange(n))
            to = at[doc] + run - run[lead[doc]]
            out[to[line == 1]] = self.newline[0]
            step = np.arange(int(mine.sum())) - np.repeat(np.cumsum(mine) - mine, mine)
            out[np.repeat(to + line, mine) + step] = flat[np.repeat(begin[which], mine) + step]
        return out, sizes


def _shards(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, eos: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = task.partitionId()
    name = f"shard-{number:06d}-{task.taskAttemptId()}"
    store, root = fs.FileSystem.from_uri(folder)
    encode: Encoder | None = None
    docs: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    out = None
    for batch in batches:
        if encode is None:
            # the stage's tasks share what they learn
            encode = K.kept_for_stage(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
            store.create_dir(root, recursive=True)
            out = store.open_output_stream(f"{root}/{name}.bin", compression=None)
        docs.append(batch.column(0).fill_null(NULL_ID).to_numpy())
        buf, off = K.binary_column(batch, "text")
        for lo, hi in K.slices(off, PACK):
            ids, counts = encode(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], eos)
            sizes.append(counts)
            out.write(ids.tobytes())
    if out is None:
        return
    out.close()
    off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
    for kind, data in (("off", off), ("doc", np.concatenate(docs).astype("<i8"))):
        with store.open_output_stream(f"{root}/{name}.{kind}", compression=None) as f:
            f.write(data.tobytes())
    row = {"shard": [number], "name": [name], "docs": [len(off) - 1], "ids": [int(off[-1])], "width": [encode.dtype.itemsize]}
    yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())]))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, eos: int = 0) -> list[dict]:
    """Encode ``docs`` (doc_id, text) into ``folder``, a URI that all executors reach; returns the manifest.

    Documents are in ascending order of doc_id, nulls first, equal ids by a hash of the text.  A null or empty text
    is its end id alone.  No documents make an empty manifest.
    """
    parts = shuffle_parts(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
        .mapInArrow(lambda it: _shards(it, tokenizer, folder, eos), "shard int, name string, docs long, ids long, width int")
        .collect()
    )
    found = sorted(rows, key=lambda r: r["shard"])
    bases = [0, *accumulate(r["ids"] for r in found)]
    manifest = [r.asDict() | {"base": base} for r, base in zip(found, bases, strict=False)]
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _open(store: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """Memory-mapped on a file system, read whole from any other store."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _documents(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for row in batch.to_pylist():
            name = f"{root}/{row['name']}"
            ids, off, docs = _open(store, f"{name}.bin", f"<u{row['width']}"), _open(store, f"{name}.off", "<u8").astype(np.int64), _open(store, f"{name}.doc", "<i8")
            for at in range(0, len(docs), 4096):
                to = min(at + 4096, len(docs))
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[at:to].tolist(), off[at + 1 : to + 1].tolist(), strict=True)]
                who = np.asarray(docs[at:to])
                yield pa.RecordBatch.from_arrays([pa.array(who, mask=who == NULL_ID), pa.array(off[at:to] + row["base"]), pa.array(np.diff(off[at : to + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a written folder, from its files: doc_id, start (ids of all documents before it), n_tokens (with
    the end id) and ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    rows = spark.createDataFrame([(r["shard"], r["name"], r["width"], r["base"]) for r in manifest], "shard int, name string, width int, base long")
    return rows.repartition(max(1, len(manifest))).mapInArrow(lambda it: _documents(it, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
