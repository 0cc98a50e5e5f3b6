"""Substring dedup: long passages that an earlier document has already.

The corpus' words make a De Bruijn graph: a window of k words is an edge between its two runs of k - 1 words.
Edges are dealt by the minimizer of their window, so that neighbours mostly travel together, as one super-k-mer: a
place, a count and forty bits an edge.  Where equal edges meet, the smallest document that has one is its source, and
neighbouring edges whose sources are neighbours too are a partial path.

Partial paths are glued by Spark.  A node is a place of a document next to a place of its source; paths leave and enter
it.  Where as many enter as leave, the stretch goes on: only the other nodes are kept, and the heads of each pair of
documents are joined with its tails.  What comes out is one row for a nonbranching stretch: (document, start, length,
source, source start).  These coordinates verify it: digests of the words themselves, taken in all documents that were
sent to one place, must agree.  Edges of a path that fails are looked up by the digest of their words in all documents.

A slice of the input settles what is repeated inside it before anything is shuffled: a passage that a third of all
documents share costs a row for each slice, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .support import materialize, shuffle_parts

WINDOW = 13
#: Words whose least hash in a window deals the window.
SEED = 3
#: Bytes of text whose edges are packed together.
PACK = 1 << 22
#: Edges that meet in a task's memory at a time, and buckets that a partition has at least.
MEET = 1 << 21
LEAST = 4
#: Edges of failed paths that are looked up by a set that every task holds; more are joined.
SUSPECTS = 200_000
#: The place of a null doc_id in the order: after all others, so that it's no one's source.
LAST = (1 << 63) - 1

_DEALT = "part int, bucket long, packed binary, settled binary"
_PATH = ["doc", "th", "start", "n", "src", "src_th", "src_start"]
_PATHS = ", ".join(f"{c} long" for c in _PATH)


def _squeeze(raw: bytes) -> bytes:
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int(np.frombuffer(data[:8], "<i8")[0]), codec="zstd", asbytes=True)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, first bytes first."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.raw, self.at = np.frombuffer(_expand(data), np.uint8), 0

    def planes(self, n: int, width: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = self.raw[self.at : self.at + n * width].reshape(width, n).T
        self.at += n * width
        return out.view("<u8").ravel()


def _pack(least: np.ndarray, place: np.ndarray, count: np.ndarray, prints: np.ndarray, ids: np.ndarray, th: np.ndarray, off: np.ndarray) -> bytes:
    """Super-k-mers in order of their place in the slice, and the documents that they are of."""
    owner = np.searchsorted(off, place, "right") - 1
    used = np.unique(owner)
    raw = [np.array([len(place), len(prints), len(used)], "<i8").tobytes(), _planes(np.diff(place, prepend=0), 4), _planes(count, 1), _planes(least, 3), _planes(prints, 5)]
    raw += [_planes(np.diff(ids[used], prepend=0).view(np.uint64), 8), _planes(th[used].view(np.uint64), 8), _planes(np.diff(off[used], prepend=0), 4)]
    return _squeeze(b"".join(raw))


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    """Of each edge its key, its document's place in the list of documents and its place in the document; ids and th of the list."""
    r = _Reader(data)
    n, edges, docs = np.frombuffer(r.raw[:24].tobytes(), "<i8").tolist()
    r.at = 24
    place = np.cumsum(r.planes(n, 4)).astype(np.int64)
    count = r.planes(n, 1).astype(np.int64)
    least, prints = r.planes(n, 3), r.planes(edges, 5)
    ids, th = np.cumsum(r.planes(docs, 8).view(np.int64)), r.planes(docs, 8).view(np.int64)
    off = np.cumsum(r.planes(docs, 4)).astype(np.int64)
    owner = np.searchsorted(off, place, "right") - 1
    within = np.arange(edges) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(least << np.uint64(40), count) | prints, np.repeat(owner, count), np.repeat(place - off[owner], count) + within, ids, th


def _resolve(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For edges of sorted keys: places of those that no smaller document has, here; of the repeated ones; and of the
    latter's sources.  The first are all occurrences in the smallest document: it may walk an edge twice."""
    n = len(h)
    first = np.ones(n, bool)
    first[1:] = h[1:] != h[:-1]
    group = np.cumsum(first) - 1
    alone = np.bincount(group)[group] == 1
    many = np.flatnonzero(~alone)
    order = many[np.lexsort((pos[many], doc[many], ids[doc[many]], h[many]))]
    lead = np.ones(len(order), bool)
    lead[1:] = h[order][1:] != h[order][:-1]
    source = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]] if len(order) else order
    again = ids[doc[order]] > ids[doc[source]]
    keep = np.sort(np.concatenate([np.flatnonzero(alone), order[~again]]))
    return keep, order[again], source[again]


def _partial(target: np.ndarray, source: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, th: np.ndarray) -> np.ndarray:
    """Neighbouring edges with neighbouring sources as one row of _PATH."""
    order = np.lexsort((pos[target], doc[target]))
    target, source = target[order], source[order]
    d, p, s, q = doc[target], pos[target], doc[source], pos[source]
    cut = np.ones(len(d), bool)
    cut[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (s[1:] != s[:-1]) | (q[1:] != q[:-1] + 1)
    at = np.flatnonzero(cut)
    d, s = d[at], s[at]
    return np.stack([ids[d], th[d], p[at], np.diff(at, append=len(cut)), ids[s], th[s], q[at]]).astype("<i8")


def _edges(batches: Iterator[pa.RecordBatch], window: int, buckets: int, keys: list[int]) -> Iterator[pa.RecordBatch]:
    """The distinct edges of each slice by bucket, and the paths that are settled within the slice."""
    seed, parts = min(SEED, window), len(keys)
    for batch in batches:
        all_ids, all_th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        buf, off = K.binary_column(batch, "text")
        for lo, hi in K.slices(off, PACK):
            words = K.Words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], K.SPACES, lower=False)
            counts = np.maximum(np.diff(words.doc) - window + 1, 0)
            if not counts.sum():
                continue
            first = words.doc[:-1]
            doc = np.repeat(np.arange(hi - lo), counts)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            place = first[doc] + pos
            h = K.window_hashes(words.hash, window)[place]
            ids, th = all_ids[lo:hi], all_th[lo:hi]
            order = np.argsort(h)
            keep, again, source = _resolve(h[order], doc[order], pos[order], ids)
            settled = _partial(order[again], order[source], doc, pos, ids, th) if len(again) else None
            kept = np.sort(order[keep])
            h, place, doc = h[kept], place[kept], doc[kept]
            # the least hash of a window's seeds, by doubling the width that is looked at
            low, width = K.window_hashes(words.hash, seed), 1
            while width < window - seed + 1:
                step = min(width, window - seed + 1 - width)
                low = np.minimum(low[:-step], low[step:])
                width += step
            low = K.mix(low[place])
            cut = np.ones(len(place), bool)
            cut[1:] = (low[1:] != low[:-1]) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
            # a count is a byte: text that goes round in circles may have longer runs of one minimizer
            at = np.flatnonzero(cut)
            at = np.flatnonzero(cut | ((np.arange(len(cut)) - np.repeat(at, np.diff(at, append=len(cut)))) % 255 == 0))
            count = np.diff(at, append=len(cut))
            bucket = ((low[at] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.repeat(at[order], count[order]) + np.arange(len(cut)) - np.repeat(np.cumsum(count[order]) - count[order], count[order])
            prints, least, places, count, bucket = h[edges] & np.uint64((1 << 40) - 1), low[at][order] & np.uint64((1 << 24) - 1), place[at][order], count[order], bucket[order]
            ends = np.concatenate([[0], np.cumsum(count)])
            edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
            rows = [(int(bucket[a]), _pack(least[a:b], places[a:b], count[a:b], prints[ends[a] : ends[b]], ids, th, first)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            extra: list[bytes | None] = [None] * len(rows)
            if settled is not None:  # any bucket may hand them on
                extra[int(np.uint64(h[0]) % np.uint64(len(rows)))] = _squeeze(settled.tobytes())
            columns = [pa.array([keys[b % parts] for b, _ in rows], pa.int32()), pa.array([b for b, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary()), pa.array(extra, pa.binary())]
            for a in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([c.slice(a, 512) for c in columns], names=["part", "bucket", "packed", "settled"])


def _path_rows(columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, columns.shape[1], 8192):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 8192]) for c in columns], names=_PATH)


def _met(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
    """All edges of a bucket: partial paths of the repeated ones."""
    parts = [_unpack(x) for x in packed]
    base = np.cumsum([0] + [len(p[3]) for p in parts])
    h = np.concatenate([p[0] for p in parts])
    doc = np.concatenate([p[1] + b for p, b in zip(parts, base.tolist(), strict=False)])
    pos, ids, th = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
    del parts
    # rows of one document from several slices are one document
    names = np.stack([ids, th], 1)
    names, same = np.unique(names, axis=0, return_inverse=True)
    doc, ids, th = same.ravel()[doc], names[:, 0], names[:, 1]
    order = np.argsort(h)
    h, doc, pos = h[order], doc[order], pos[order]
    _, again, source = _resolve(h, doc, pos, ids)
    if len(again):
        yield from _path_rows(_partial(again, source, doc, pos, ids, th))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come one after the other; one is held at a time."""
    here, packed = None, []
    for batch in batches:
        for bucket, data, settled in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if settled is not None:
                yield from _path_rows(np.frombuffer(_expand(settled), "<i8").reshape(len(_PATH), -1))
            if bucket != here and packed:
                yield from _met(packed)
                packed = []
            here = bucket
            packed.append(data)
    if packed:
        yield from _met(packed)


def even_keys(df: DataFrame, parts: int) -> list[int]:
    """An int for each partition that a hash exchange of ``parts`` sends there: data dealt by them spreads evenly."""
    rows = df.sparkSession.range(parts * 40).select(F.col("id").cast("int").alias("k")).select("k", F.expr(f"pmod(hash(k), {parts})").alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()
    return sorted(r["k"] for r in rows)


def partial_paths(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Stretches of repeated edges that met in one bucket or slice, a row each (_PATH), for ``docs`` (doc, th, text)."""
    parts = shuffle_parts(docs.sparkSession)
    keys = even_keys(docs, parts)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word takes two bytes at least, mostly some six
    buckets = max(parts * LEAST, size // (4 * MEET))
    dealt = docs.mapInArrow(lambda it: _edges(it, window, buckets, keys), _DEALT)
    return dealt.repartition(parts, "part").sortWithinPartitions("bucket").mapInArrow(_meet, _PATHS)


def glue(partial: DataFrame) -> DataFrame:
    """Compaction: partial paths that follow each other become one (_PATH); overlapping ones too.

    A node is a place of a document with a place of its source.  As paths enter and leave it, its degrees are
    counted; nodes where both are equal lie within a stretch and vanish.  Along the others the balance of those that left
    and entered rises from zero at a head and falls to zero at a tail; the i-th head is joined with the i-th tail.  All
    joins and windows use the one exchange by document.
    """
    pair = ["doc", "th", "src", "src_th", "shift"]
    held = partial.withColumn("shift", F.col("src_start") - F.col("start")).repartition(shuffle_parts(partial.sparkSession), "doc", "th")
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("leaves")), F.struct((F.col("start") + F.col("n")).alias("at"), F.lit(-1).alias("leaves")))
    nodes = held.select(*pair, F.inline(ends)).groupBy(*pair, "at").agg(F.sum(F.when(F.col("leaves") > 0, 1).otherwise(0)).alias("out_degree"), F.sum(F.when(F.col("leaves") < 0, 1).otherwise(0)).alias("in_degree"))
    along = Window.partitionBy(*pair).orderBy("at")
    branching = nodes.where("out_degree <> in_degree").withColumn("after", F.sum(F.col("out_degree") - F.col("in_degree")).over(along))
    branching = branching.withColumn("before", F.col("after") - F.col("out_degree") + F.col("in_degree"))
    heads = branching.where("before = 0").select(*pair, "at", F.row_number().over(along).alias("i"))
    tails = branching.where("after = 0").select(*pair, F.col("at").alias("to"), F.row_number().over(along).alias("i"))
    joined = heads.join(tails, [*pair, "i"])
    return joined.select("doc", "th", F.col("at").alias("start"), (F.col("to") - F.col("at")).alias("n"), "src", "src_th", (F.col("at") + F.col("shift")).alias("src_start"))


_CHECKS = pa.list_(pa.struct([("src", pa.int64()), ("src_th", pa.int64()), ("src_start", pa.int64()), ("words", pa.int64()), ("digest", pa.binary())]))
_APPLIED = "doc_id long, n_words long, n_removed long, kept_sha256 string, checks array<struct<src:long,src_th:long,src_start:long,words:long,digest:binary>>"


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    for batch in batches:
        K.forget_others()
        texts = batch.column(3).fill_null("").cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([_squeeze(t.as_py()) for t in texts], pa.binary())], names=["doc_id", "doc", "th", "text"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each document, and digests of the spans that are to be verified, by the coordinates of their source."""
    for batch in batches:
        n_words, n_removed, kept, checks = [], [], [], []
        for doc, th, text, asked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
            words = _expand(text.as_py()).split()
            n_words.append(len(words))
            if asked.is_valid:
                gone = np.zeros(len(words) + 1, np.int32)
                mine = []
                for ask in asked.as_py():
                    a, b = ask["start"], ask["start"] + ask["words"]
                    if ask["check"]:
                        at = (ask["src"], ask["src_th"], ask["src_start"]) if ask["target"] else (doc, th, a)
                        mine.append((*at, b - a, hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest()))
                    if ask["target"]:
                        gone[a] += 1
                        gone[min(b, len(words))] -= 1
                left = np.cumsum(gone[:-1]) == 0
                checks.append([dict(zip(("src", "src_th", "src_start", "words", "digest"), m, strict=True)) for m in mine])
                words = [w for w, stays in zip(words, left.tolist(), strict=True) if stays]
            else:
                checks.append(None)
            n_removed.append(n_words[-1] - len(words))
            kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept), pa.array(checks, _CHECKS)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "checks"])


def _apply(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked``: doc, th, start, words, src, src_th, src_start, whether it goes (target) and whether it is digested (check)."""
    parts = shuffle_parts(docs.sparkSession)
    lists = asked.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "words", "src", "src_th", "src_start", "target", "check")).alias("asked"))
    zipped = docs.select("doc_id", "doc", "th", "text").mapInArrow(_zipped, "doc_id long, doc long, th long, text binary").repartition(parts, "doc", "th")
    return materialize(zipped.join(lists, ["doc", "th"], "left").select("doc_id", "doc", "th", "text", "asked").mapInArrow(_applied, _APPLIED), "applied")


def _spelled(batches: Iterator[pa.RecordBatch], window: int, wanted: np.ndarray | None, asked: bool) -> Iterator[pa.RecordBatch]:
    """Windows with the digest of their words: those asked for by place, or those whose hash is wanted, or all."""
    for batch in batches:
        buf, off = K.binary_column(batch, "text")
        docs, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        places = batch.column(3).to_pylist() if asked else None
        for lo, hi in K.slices(off):
            part = buf[off[lo] : off[hi]]
            words = K.Words(part, off[lo : hi + 1] - off[lo], K.SPACES, lower=False)
            h = K.window_hashes(words.hash, window)
            out: list[tuple[int, int, int, int, bytes]] = []
            for i in range(lo, hi):
                a, n = int(words.doc[i - lo]), int(words.doc[i - lo + 1] - words.doc[i - lo]) - window + 1
                own = np.arange(max(n, 0))
                own = np.intersect1d(own, places[i]) if asked else own
                own = own[np.isin(h[a + own], wanted)] if wanted is not None and len(own) else own
                for p in own.tolist():
                    spelled = b" ".join(part[s:e].tobytes() for s, e in zip(words.start[a + p : a + p + window], words.end[a + p : a + p + window], strict=True))
                    out.append((docs[i], ths[i], p, int(h[a + p].view(np.int64)), hashlib.blake2b(spelled, digest_size=16).digest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["doc", "th", "at", "h", "digest"])


def _looked_up(docs: DataFrame, edges: DataFrame, window: int) -> DataFrame:
    """Of ``edges`` (doc, th, at) those whose words a smaller document has, found by the digest of the words."""
    schema = "doc long, th long, at long, h long, digest binary"
    places = edges.groupBy("doc", "th").agg(F.collect_set("at").alias("places"))
    own = materialize(docs.join(places, ["doc", "th"]).select("doc", "th", "text", "places").mapInArrow(lambda it: _spelled(it, window, None, True), schema), "suspects")
    hashes = own.select("h").distinct().limit(SUSPECTS + 1).collect()
    wanted = np.array([r["h"] for r in hashes], np.int64).view(np.uint64) if len(hashes) <= SUSPECTS else None
    every = docs.select("doc", "th", "text").mapInArrow(lambda it: _spelled(it, window, wanted, False), schema)
    first = every.groupBy("digest").agg(F.min("doc").alias("first"))
    return own.join(first, "digest").where("first < doc").select("doc", "th", "at")


def remove_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Remove each word covered by a ``window`` of words that also starts in a document of smaller doc_id.

    Windows are judged on the input.  Returns doc_id, n_words, n_removed and kept_sha256 (of the words that stay,
    joined by one space), a row for each row of ``docs`` (doc_id, text; other columns are ignored).  Null, empty and
    blank texts have no words, and the digest of nothing.  A null doc_id comes after all others and is no
    one's source; rows of equal doc_id are not each other's source.  Rows that repeat a doc_id and its text
    are answered alike.  No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc"), "text")
    # texts are told apart only where an id repeats: a constant costs nothing on the way
    repeats = not docs.groupBy("doc").count().where("count > 1").isEmpty()
    docs = docs.withColumn("th", F.coalesce(F.xxhash64("text"), F.lit(0)) if repeats else F.lit(0).cast("long"))
    paths = materialize(glue(partial_paths(docs.select("doc", "th", "text"), window=window)), "paths")

    spans = paths.withColumn("words", F.col("n") + (window - 1))
    targets = spans.select("doc", "th", "start", "words", "src", "src_th", "src_start", F.lit(True).alias("target"), F.lit(True).alias("check"))
    none = F.lit(None).cast("long")
    sources = spans.select(F.col("src").alias("doc"), F.col("src_th").alias("th"), F.col("src_start").alias("start"), "words").distinct()
    sources = sources.select("*", none.alias("src"), none.alias("src_th"), none.alias("src_start"), F.lit(False).alias("target"), F.lit(True).alias("check"))
    done = _apply(docs, targets.unionByName(sources))
    place = ["src", "src_th", "src_start", "words"]
    seen = done.select(F.inline("checks")).groupBy(*place).agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    failed = materialize(seen.where("least <> most").select(*place), "failed")
    answer = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if failed.isEmpty():
        return done.select(*answer)
    good = spans.join(failed, place, "left_anti").select("doc", "th", "start", "words")
    edges = spans.join(failed, place).select("doc", "th", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct()
    found = _looked_up(docs, materialize(edges, "edges"), window).select("doc", "th", F.col("at").alias("start"), F.lit(window).cast("long").alias("words"))
    asked = good.unionByName(found).select("*", none.alias("src"), none.alias("src_th"), none.alias("src_start"), F.lit(True).alias("target"), F.lit(False).alias("check"))
    return _apply(docs, asked).select(*answer)
