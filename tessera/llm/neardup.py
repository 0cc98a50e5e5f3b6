"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents with the same shingle set are one class.  Each of a class' K signature coordinates with its value is a token.
Tokens are counted, and a class is posted under its K - t + 1 rarest ones: two signatures that agree in t places must
meet in one of these lists, whatever the order (the prefix bound of a t-occurrence join), and a class with that many
coordinates of its own meets nobody.  In a list, collisions over all coordinates are counted, skipping whom links join
already; what is handed on is a spanning forest of the pairs that agree in t places, never the pairs.  Inside each
connected cluster the full shingle sets decide; what leaves is a spanning forest of the confirmed links, whose components
are the groups.

A list of more than a block is settled by stars first: its members are counted against a few pivots, and the best
of them are confirmed on full sets.  Members that a star joins need no comparison with each other; the others are compared
with all.  So the rows of a group of n near copies of which k miss the stars are n + k * n / BLOCK.

A pair at a similarity of p agrees in K * p of 64 places in the mean, by a binomial law; t is the largest that
misses a pair at the threshold with a probability below 5e-6 (40 at 0.85, 36 at 0.80), higher similarities far
less.  All else is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .support import Tables, components, materialize, shuffle_parts, sized

COORDINATES = 64
#: Probability that a pair at the threshold is missed, at most.
MISS = 5e-6
SHINGLE = 5
PERCENT = 85
#: Members of a list or cluster that one task compares with as many others.
BLOCK = 512
#: Frequent tokens whose counts order the others' postings: as many as every task can hold.
FREQUENT = 200_000
#: Members of a long list that all others are counted against, and confirmed stars that a member may join.
PIVOTS, STARS = 16, 3

_RNG = np.random.default_rng(8191)
_A = _RNG.integers(1, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_SALT = K.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))


def matches_for(percent: int) -> int:
    """Places in which the signatures of a pair at ``percent`` agree but for a probability below ``MISS``; 1 at least."""
    p, below = percent / 100, 0.0
    for t in range(COORDINATES):
        below += math.comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if below >= MISS:
            return max(1, t)
    return COORDINATES


def minhash(shingles: np.ndarray) -> np.ndarray:
    """K minima of multiply-add hashes over the shingles' upper halves."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(best, (x[at : at + 4096, None] * _A + _B).min(0), out=best)
    return best


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    other = K.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return (np.array([shingles.sum(dtype=np.uint64), other.sum(dtype=np.uint64)]) + np.uint64(len(shingles))).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Of each document: its columns but text, set size, digest of the set, signature, a byte of each coordinate."""
    for batch in batches:
        own = batch.select([n for n in batch.schema.names if n != "text"])
        buf, off = K.binary_column(batch, "text")
        for lo, hi in K.slices(off):
            words = K.Words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], K.SPACES, lower=True)
            n, digest, signs, prints = [], [], [], []
            for a, b in zip(words.doc[:-1].tolist(), words.doc[1:].tolist(), strict=True):
                s = K.shingle_set(words.hash[a:b], shingle)
                n.append(len(s))
                digest.append(set_digest(s) if len(s) else None)
                h = minhash(s)
                signs.append(h.tobytes() if len(s) else None)
                prints.append((K.mix(h.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*own.slice(lo, hi - lo).columns, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signs, pa.binary()), pa.array(prints, pa.binary())], names=[*own.schema.names, "n_shingles", "v", "signature", "prints"])


def _tokens(signs: pa.Array) -> np.ndarray:
    """Coordinate and value as one number, a row of K for each signature."""
    h = np.frombuffer(b"".join(signs.to_pylist()), np.uint32).reshape(-1, COORDINATES)
    return K.mix(h.astype(np.uint64) ^ _SALT)


def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_tokens(batch.column(0)).view(np.int64).ravel())], names=["token"])


def _posted(batches: Iterator[pa.RecordBatch], prefix: int, frequent: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, v) of each class' rarest tokens; ``frequent`` are sorted, all others count as 0."""
    for batch in batches:
        tokens = _tokens(batch.column(1))
        weight = np.zeros(tokens.shape, np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
            weight = np.where(frequent[at] == tokens, counts[at], 0)
        first = np.lexsort((tokens, weight), axis=1)[:, :prefix]
        own = pa.array(np.repeat(np.arange(len(tokens)), prefix))
        yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(tokens, first, 1).view(np.int64).ravel()), batch.column(0).take(own)], names=["token", "v"])


def _agreements(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (prints == one).sum(1)


def _matrix(prints: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _joined(label: np.ndarray, left: np.ndarray, right: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that ``near`` (member, others -> which) holds for, beyond the ``label`` that members share.

    Whom links join already is skipped, so that a dense group takes a few rounds over its members, not one for each of them.
    """
    label, edges = label.copy(), []
    for i in left.tolist():
        others = right[label[right] != label[i]]
        if left is right:
            others = others[others > i]
        if not len(others):
            continue
        for j in others[near(i, others)].tolist():
            if label[j] != label[i]:
                edges.append((i, j))
                label[label == label[j]] = label[i]
    return edges


def _edge_rows(v: list[bytes], edges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for i, _ in edges], pa.binary()), pa.array([v[j] for _, j in edges], pa.binary())], names=["a", "b"])


def _labels(run: pa.Table) -> np.ndarray:
    return np.unique(np.array(run["label"].to_pylist(), object), return_inverse=True)[1]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], pairs: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]] | None = None) -> Iterator[pa.Table | pa.RecordBatch]:
    """Consecutive rows of equal keys, over the borders of batches.  With ``pairs``, runs of two inside a batch are not yielded:
    what ``pairs`` makes of the batch and their first places is."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        whole = np.ones(len(cuts) - 1, bool)
        if pairs:  # the first run may go on from the last batch, the last one into the next
            two = (np.diff(cuts) == 2) & (np.arange(len(cuts) - 1) > 0) & (np.arange(len(cuts) - 1) < len(cuts) - 2)
            whole &= ~two & ((np.diff(cuts) > 1) | (np.arange(len(cuts) - 1) == 0) | (np.arange(len(cuts) - 1) == len(cuts) - 2))
            if two.any():
                yield from pairs(batch, cuts[:-1][two])
        for lo, hi in zip(cuts[:-1][whole].tolist(), cuts[1:][whole].tolist(), strict=True):
            key = tuple(c[lo] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _sides(block: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members on either side of a pair of blocks; within one block both are all."""
    return (np.arange(len(block)),) * 2 if p == q else (np.flatnonzero(block == p), np.flatnonzero(block == q))


def _agreeing(batches: Iterator[pa.RecordBatch], matches: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the pairs of a list that agree in enough coordinates and may reach the similarity by size."""

    def alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)

    def pairs(batch: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        prints, n = _matrix(column("prints")), column("n_shingles").to_numpy(zero_copy_only=False)
        good = first[((prints[first] == prints[first + 1]).sum(1) >= matches) & alike(n[first], n[first + 1])]
        if len(good):
            yield pa.RecordBatch.from_arrays([column("v").take(pa.array(good)), column("v").take(pa.array(good + 1))], names=["a", "b"])

    for run in _runs(batches, ["token", "p", "q"], pairs):
        if isinstance(run, pa.RecordBatch):
            yield run
        elif run.num_rows > 1:
            prints, n = _matrix(run["prints"]), run["n_shingles"].to_numpy()
            near = lambda i, o: (_agreements(prints[o], prints[i]) >= matches) & alike(n[o], n[i])  # noqa: E731, B023
            yield from _edge_rows(run["v"].to_pylist(), _joined(_labels(run), *_sides(run["block"].to_numpy(), run["p"][0].as_py(), run["q"][0].as_py()), near))


def _best_pivots(batches: Iterator[pa.RecordBatch], matches: int) -> Iterator[pa.RecordBatch]:
    """Of each member of a part of a long list the pivots with which it agrees most."""
    for run in _runs(batches, ["token", "part"]):
        v, prints, lead = run["v"].to_pylist(), _matrix(run["prints"]), run["lead"].to_numpy(zero_copy_only=False).astype(bool)
        out: list[tuple[bytes, bytes, int]] = []
        pivots = np.flatnonzero(lead)
        for i in np.flatnonzero(~lead).tolist():
            agree = _agreements(prints[pivots], prints[i])
            out += [(v[i], v[pivots[j]], int(agree[j])) for j in np.argsort(-agree, kind="stable")[:STARS].tolist() if agree[j] >= matches and v[i] != v[pivots[j]]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int64())], names=["v", "pivot", "agree"])


def _stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of members to their pivots, whose set leads the run."""
    for run in _runs(batches, ["pivot", "part"]):
        lead = run["lead"].to_numpy(zero_copy_only=False).astype(bool)
        sets = [np.frombuffer(x, np.uint64) for x in run["shingles"].to_pylist()]
        own = sets[int(np.flatnonzero(lead)[0])]
        v, pivot, edges = run["v"].to_pylist(), int(np.flatnonzero(lead)[0]), []
        for i in np.flatnonzero(~lead).tolist():
            shared = len(np.intersect1d(own, sets[i], assume_unique=True))
            if 100 * shared >= percent * (len(own) + len(sets[i]) - shared):
                edges.append((pivot, i))
        yield from _edge_rows(v, edges)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(v, shingles): the texts of classes as full shingle sets."""
    for batch in batches:
        buf, off = K.binary_column(batch, "text")
        for lo, hi in K.slices(off):
            words = K.Words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], K.SPACES, lower=True)
            sets = [K.shingle_set(words.hash[a:b], shingle) for a, b in zip(words.doc[:-1].tolist(), words.doc[1:].tolist(), strict=True)]
            v = batch.column(0).slice(lo, hi - lo)
            # a doc_id may repeat with another text: keep the text that the class is made of
            own = [set_digest(x) == y for x, y in zip(sets, v.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([v.filter(pa.array(own)), pa.array([x.tobytes() for x, mine in zip(sets, own, strict=True) if mine], pa.binary())], names=["v", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the pairs of a cluster whose full sets are similar enough."""
    for run in _runs(batches, ["cluster", "p", "q"]):
        if run.num_rows < 2:
            continue
        sets = [np.frombuffer(x, np.uint64) for x in run["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        at = np.concatenate([[0], np.cumsum(sizes)])
        distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(distinct), np.int64)

        def near(i: int, others: np.ndarray, sizes: np.ndarray = sizes, at: np.ndarray = at, place: np.ndarray = place, mark: np.ndarray = mark) -> np.ndarray:
            alike = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
            some = others[alike]
            if len(some):
                ends = np.cumsum(sizes[some])
                flat = np.repeat(at[some] - (ends - sizes[some]), sizes[some]) + np.arange(ends[-1])
                mark[place[at[i] : at[i + 1]]] = 1
                shared = np.add.reduceat(mark[place[flat]], ends - sizes[some])
                mark[place[at[i] : at[i + 1]]] = 0
                alike[alike] = 100 * shared >= percent * (sizes[i] + sizes[some] - shared)
            return alike

        yield from _edge_rows(run["v"].to_pylist(), _joined(_labels(run), *_sides(run["block"].to_numpy(), run["p"][0].as_py(), run["q"][0].as_py()), near))


def _blocks(members: DataFrame, key: str) -> DataFrame:
    """``members`` (key, v, label, n: how many have the key) dealt to the pairs of blocks (p <= q) that they are compared in.

    A group of up to a block is one pair, (0, 0).  In a larger one those of its most frequent label, whom links join
    already, take part in as many pairs as the others fill blocks, the others in a pair with every block; a group of
    one label in none.
    """
    zero = F.lit(0)
    small = members.where(F.col("n") <= BLOCK).select("*", zero.alias("block"), zero.alias("p"), zero.alias("q"))
    large = members.where(F.col("n") > BLOCK)
    per = large.groupBy(key, "label").agg(F.count(F.lit(1)).alias("c"))
    most = per.groupBy(key).agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all")).where("top.c < all")
    most = most.select(key, F.col("top.label").alias("_top"), F.when(F.col("top.c") > 1, F.ceil(F.col("top.c") / BLOCK)).otherwise(0).cast("int").alias("_joined"), F.ceil((F.col("all") - F.when(F.col("top.c") > 1, F.col("top.c")).otherwise(0)) / BLOCK).cast("int").alias("_free"))
    held = large.join(sized(materialize(most, "most")), key)
    star = (F.col("label") == F.col("_top")) & (F.col("_joined") > 0)
    spot = F.when(star, F.pmod(F.xxhash64("v"), F.col("_joined"))).otherwise(F.col("_joined") + F.pmod(F.xxhash64("v"), F.col("_free"))).cast("int")
    met = F.sequence(F.when(star, F.col("_joined")).otherwise(0), F.col("_joined") + F.col("_free") - 1)
    held = held.withColumn("block", spot).withColumn("_o", F.explode(met)).withColumn("p", F.least("block", "_o")).withColumn("q", F.greatest("block", "_o"))
    return small.unionByName(held.select(*small.columns))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` but text, with n_shingles, v, signature and prints, for each of its rows."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(lambda it: _signatures(it, shingle), f"{kept}, n_shingles long, v binary, signature binary, prints binary")


def _postings(classes: DataFrame, prefix: int) -> DataFrame:
    """(token, v) of each class' rarest tokens.  The most frequent tokens, as many as fit into every task, are told apart by
    their counts; any order that is the same for all keeps the prefix bound."""
    counts = materialize(classes.select("signature").mapInArrow(_all_tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    sizes = {r["bits"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("bits")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, held = 64, 0
    while least > 1 and held + sizes.get(least - 1, 0) <= FREQUENT:
        least -= 1
        held += sizes.get(least, 0)
    rows = counts.where(F.col("n") >= 2.0**least).orderBy("token").collect()
    frequent = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent, weights = frequent[order], np.array([r["n"] for r in rows], np.int64)[order]
    return classes.select("v", "signature").mapInArrow(lambda it: _posted(it, prefix, frequent, weights), "token long, v binary")


def _full_sets(docs: DataFrame, members: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(v, shingles) of the classes ``members`` (v): one row brings a class' text, the first of its smallest id (ids may be
    null or repeat)."""
    wanted = materialize(members.select("v").distinct().join(classes.select("v", "first_id"), "v"), "wanted")
    texts = docs.join(sized(wanted), docs["doc_id"].eqNullSafe(wanted["first_id"])).select("v", "text")
    return materialize(texts.mapInArrow(lambda it: _sets(it, shingle), "v binary, shingles binary").dropDuplicates(["v"]), "sets")


def _star_links(docs: DataFrame, met: DataFrame, classes: DataFrame, shingle: int, percent: int, parts: int) -> DataFrame:
    """Confirmed links (a, b) of the members of long lists to pivots."""
    matches = matches_for(percent)
    long = materialize(met.where(F.col("n") > BLOCK), "long")
    empty = long.select(F.col("v").alias("a"), F.col("v").alias("b")).limit(0)
    if long.isEmpty():
        return empty
    first = F.row_number().over(Window.partitionBy("token").orderBy("v"))
    leads = long.select("token", "v", "n", first.alias("r")).where(F.col("r") <= PIVOTS)
    dealt = F.ceil(F.col("n") / BLOCK).cast("int")
    others = long.select("token", "v", F.pmod(F.xxhash64("v"), dealt).cast("int").alias("part"), F.lit(False).alias("lead"))
    leads = leads.select("token", "v", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("part"), F.lit(True).alias("lead"))
    rows = others.unionByName(leads).join(classes.select("v", "prints"), "v").select("token", "part", "lead", "v", "prints")
    best = rows.repartition(parts, "token", "part").sortWithinPartitions("token", "part").mapInArrow(lambda it: _best_pivots(it, matches), "v binary, pivot binary, agree long")
    best = best.groupBy("v", "pivot").agg(F.max("agree").alias("agree"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.col("agree").desc(), "pivot"))
    pairs = materialize(best.withColumn("r", rank).where(F.col("r") <= STARS).select("v", "pivot"), "pairs")
    sets = _full_sets(docs, pairs.select("v").unionByName(pairs.select(F.col("pivot").alias("v"))), classes, shingle)
    deals = materialize(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "deals")
    stars = pairs.join(sized(deals), "pivot").select("pivot", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("lead"), "v")
    own = deals.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("lead"), F.col("pivot").alias("v"))
    rows = stars.unionByName(own).join(sets, "v").select("pivot", "part", "lead", "v", "shingles")
    return materialize(rows.repartition(parts, "pivot", "part").sortWithinPartitions("pivot", "part").mapInArrow(lambda it: _stars(it, percent), "a binary, b binary"), "stars")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked by 100 * |A & B| >= percent * |A | B| over their word-shingle sets.

    ``docs`` needs doc_id and text; other columns are ignored.  Returns doc_id, n_shingles, component_id (the
    smallest doc_id of the group) and kept (doc_id = component_id), a row for each row of ``docs``.
    A null, empty or blank text has no shingles and is linked with nothing.  A null doc_id is never the smallest;
    a group of null ids alone has a null component_id and is kept.  Rows that repeat a doc_id and its text
    are all answered alike.  No documents give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed, answer = _grouped(docs, [], shingle, percent)
    named = signed.where("v IS NOT NULL").join(answer, "v").select("doc_id", "n_shingles", "component_id")
    out = named.unionByName(signed.where("v IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def without_near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with one row of each group: the one of the smallest doc_id, nulls last, of
    equal ids any one.  Rows that repeat an id, and rows without one, are rows of their own; texts without words all stay.

    Rows are told apart by their place in their file; what isn't read from Parquet is written first.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    columns = docs.columns
    try:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *place)
    except AnalysisException:
        docs = materialize(docs, "rows")
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *place)
    keyed = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"), "_file", "_row")
    signed, answer = _grouped(keyed, ["_file", "_row"], shingle, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_file", "_row")
    member = signed.where("v IS NOT NULL").join(answer.select("v", "root"), "v").select("root", order.alias("o"))
    # most groups are one row: only those of several are compared
    best = member.groupBy("root").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "first")
    gone = member.join(sized(materialize(best, "first")), "root").where("o <> first").select("o._file", "o._row")
    return rows.join(sized(materialize(gone, "gone")), ["_file", "_row"], "left_anti").select("row.*")


def _grouped(docs: DataFrame, keep: list[str], shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of ``docs`` (doc_id, text and ``keep``), and of each class (v) its group: root and component_id."""
    parts, matches = shuffle_parts(docs.sparkSession), matches_for(percent)
    signed = materialize(signatures(docs, shingle), "signatures")
    with Tables() as tables:
        full = signed.where("v IS NOT NULL")
        classes = materialize(full.groupBy("v").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"), F.min("prints").alias("prints")), "classes")

        posted = materialize(_postings(classes, COORDINATES - matches + 1), "posted")
        lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = materialize(posted.join(materialize(lists, "lists"), "token"), "met")
        stars = _star_links(docs, met, classes, shingle, percent, parts)
        labels = materialize(components(stars).select("v", F.col("root").alias("label")), "labels")
        labelled = lambda rows: rows.join(sized(labels), "v", "left").withColumn("label", F.coalesce("label", "v"))
        in_lists = _blocks(labelled(met), "token").join(classes.select("v", "n_shingles", "prints"), "v")
        agreeing = (
            in_lists.select("token", "p", "q", "block", "v", "label", "n_shingles", "prints")
            .repartition(parts, "token", "p", "q").sortWithinPartitions("token", "p", "q")
            .mapInArrow(lambda it: _agreeing(it, matches, percent), "a binary, b binary")
        )
        clusters = materialize(components(agreeing.unionByName(stars)), "clusters")

        sizes = materialize(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
        members = labelled(clusters.join(sized(sizes), "root").select(F.col("root").alias("cluster"), "v", "n"))
        blocks = materialize(_blocks(members, "cluster"), "blocks")
        sets = _full_sets(docs, blocks, classes, shingle)
        confirmed = (
            blocks.join(sets, "v").select("cluster", "p", "q", "block", "v", "label", "shingles")
            .repartition(parts, "cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")
            .mapInArrow(lambda it: _confirmed(it, percent), "a binary, b binary")
        )
        linked = components(confirmed.unionByName(stars))

        rooted = classes.select("v", "first_id").join(linked, "v", "left").select("v", "first_id", F.coalesce("root", "v").alias("root"))
        rooted = materialize(rooted, "rooted")
        best = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "best")
        answer = materialize(rooted.join(sized(best), "root").select("v", "root", "component_id"), "answer")
        tables.keep(answer)
    return signed, answer
