"""Approximate nearest neighbours by inner product, over randomly rotated one-bit codes.

A vector's residual to the mean is rotated at random and kept as the signs of its coordinates (packed bits)
with two scalars: the residual's length and its unit vector's inner product with the code's.  A query's product with the
residual is estimated from the bits and the scalars without bias, with a deviation that the scalars give; what is
added to an estimate is ``bounds`` such deviations.  A block of vectors is searched for a block of queries at a time: the
best estimates are computed exactly and set a mark, the k-th of them; a vector is reranked, with the original vectors
in double precision, if its upper bound reaches the mark.

Queries and vectors meet as pairs of packed blocks of bounded size; each pair hands on k rows for each query.
The rotation is fixed by a seed, the mean is taken over all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import materialize, shuffle_parts, sized

SEED = 1202
#: Deviations on either side of an estimate.
BOUNDS = 4.0
#: Vectors of a block; queries of a block.
VECTORS = 4_096
QUERIES = 1_024


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated residuals, their lengths, and the products of unit residual and code."""
    dim = vectors.shape[1]
    turned = (vectors - mean) @ rotation(dim)
    length = np.sqrt((turned * turned).sum(1))
    bits = turned >= 0
    product = np.abs(turned).sum(1) / (np.sqrt(dim) * np.where(length > 0, length, 1))
    return np.packbits(bits, axis=1), length, np.where(length > 0, product, 1.0)


def estimate(packed: np.ndarray, length: np.ndarray, product: np.ndarray, queries: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each query (row) and vector (column): the estimated inner product, and its deviation."""
    dim = queries.shape[1]
    turned = (queries @ rotation(dim)).astype(np.float32)
    signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
    scale = length / (np.sqrt(dim) * product)
    about = (turned @ signs.T) * scale.astype(np.float32) + (queries @ mean)[:, None].astype(np.float32)
    spread = length * np.sqrt(np.maximum(1 - product**2, 0)) / product / np.sqrt(max(dim - 1, 1))
    return about, np.sqrt((queries * queries).sum(1))[:, None].astype(np.float32) * spread.astype(np.float32)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the coordinates."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector takes part, as bytes of doubles."""
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                ids.append(i), out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) // 8 for x in out], pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "vector"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum and count of the task's vectors, by dimension."""
    total: dict[int, tuple[np.ndarray, int]] = {}
    for batch in batches:
        for d, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s, n = total.get(d, (np.zeros(d), 0))
            total[d] = (s + np.frombuffer(v), n + 1)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tolist() for s, _ in total.values()], pa.list_(pa.float64())), pa.array([n for _, n in total.values()], pa.int64())], names=["dim", "total", "n"])


def _packed(batches: Iterator[pa.RecordBatch], means: dict[int, list[float]], size: int, code: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``size`` rows of a task: ids, vectors and, for vectors to search, their codes."""
    held: dict[int, tuple[list[int], list[bytes]]] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, raw = held.pop(dim)
        x = np.frombuffer(b"".join(raw)).reshape(-1, dim)
        codes = b""
        if code:
            bits, length, product = encode(x, np.array(means[dim]))
            codes = bits.tobytes() + length.tobytes() + product.tobytes()
        narrow = x.astype(np.float32)
        body = (b"f" + narrow.tobytes()) if (narrow.astype(np.float64) == x).all() else (b"d" + x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([body]), pa.array([codes])], names=["dim", "ids", "vectors", "codes"])

    for batch in batches:
        for i, d, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            ids, raw = held.setdefault(d, ([], []))
            ids.append(i), raw.append(v)
            if len(ids) >= size:
                yield block(d)
    for d in list(held):
        yield block(d)


def _vectors(body: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(body[1:], np.float32 if body[:1] == b"f" else np.float64).astype(np.float64).reshape(-1, dim)


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, and of all that rounding may have put below them."""
    if len(score) <= k:
        return np.arange(len(score))
    mark = np.partition(score, len(score) - k)[len(score) - k]
    return np.flatnonzero(score >= mark - 1e-9 * max(1.0, abs(mark)))


def _searched(batches: Iterator[pa.RecordBatch], means: dict[int, list[float]], k: int, bounds: float) -> Iterator[pa.RecordBatch]:
    """The k nearest of each query of a block among the vectors of another."""
    for batch in batches:
        for row in batch.to_pylist():
            dim, mean = row["dim"], np.array(means[row["dim"]])
            qids, queries = np.frombuffer(row["query_ids"], np.int64), _vectors(row["queries"], dim)
            ids, vectors = np.frombuffer(row["ids"], np.int64), _vectors(row["vectors"], dim)
            n, width = len(ids), (dim + 7) // 8
            bits = np.frombuffer(row["codes"][: n * width], np.uint8).reshape(n, width)
            scalars = np.frombuffer(row["codes"][n * width :])
            out: list[tuple[int, int, float]] = []
            probe = min(n, max(4 * k, 64))
            for at in range(0, len(qids), 128):
                about, spread = estimate(bits, scalars[:n], scalars[n:], queries[at : at + 128], mean)
                high = about + (spread * np.float32(bounds) + np.float32(1e-5))
                for j in range(len(about)):
                    q, query = int(qids[at + j]), queries[at + j]
                    if n > probe:
                        # exact products of the best estimates set the mark; who may reach it is reranked
                        first = vectors[np.argpartition(about[j], n - probe)[n - probe :]] @ query
                        near = np.flatnonzero(high[j] >= np.partition(first, probe - k - 1)[probe - k - 1] - 1e-6)
                    else:
                        near = np.arange(n)
                    near = near[_top(vectors[near] @ query, k + 1)]  # the query itself may be one of them
                    score = products(vectors[near], query)
                    order = [o for o in np.lexsort((ids[near], -score)).tolist() if ids[near[o]] != q][:k]
                    out += [(q, int(ids[near[o]]), float(score[o])) for o in order]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, bounds: float = BOUNDS) -> DataFrame:
    """The ``k`` largest inner products of each query with all rows but its own.

    ``vectors`` has vec_id and embedding (an array of numbers); other columns are ignored.  Queries are the rows whose
    vec_id is divisible by ``every``.  Returns query_id, rank (from 1), vec_id and score (in double precision, on the
    original vectors), ties to the smaller vec_id; all candidates if there are fewer than ``k``.  Rows with a null id and
    vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors of different length
    do not meet.  Rows that repeat a vec_id are one point: its last vector in sorted order stands.
    """
    parts = shuffle_parts(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = rows.mapInArrow(_usable, "vec_id long, dim int, vector binary").groupBy("vec_id").agg(F.max(F.struct("dim", "vector")).alias("v")).select("vec_id", "v.dim", "v.vector")
    usable = materialize(usable, "vectors")
    sums = usable.select("dim", "vector").mapInArrow(_sums, "dim int, total array<double>, n long").select("dim", "n", F.posexplode("total").alias("i", "x"))
    means: dict[int, list[float]] = {}
    for r in sums.groupBy("dim", "i").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("dim", "i").collect():
        means.setdefault(r["dim"], []).append(r["x"])

    schema = "dim int, ids binary, vectors binary, codes binary"
    blocks = usable.mapInArrow(lambda it: _packed(it, means, VECTORS, True), schema)
    queries = usable.where(F.col("vec_id") % every == 0).coalesce(max(1, parts // 2)).mapInArrow(lambda it: _packed(it, means, QUERIES, False), schema)
    queries = queries.select("dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    # every block of queries against every block of vectors of its length: pairs of block numbers first, which are small
    # rows; then the queries, then the vectors by their block's number, so that no vector is shuffled twice
    queries = materialize(queries.withColumn("q", F.monotonically_increasing_id()), "queries")
    blocks = materialize(blocks.withColumn("b", F.monotonically_increasing_id()), "numbered")
    numbers = queries.select("dim", "q").join(sized(blocks.select("dim", "b")), "dim").repartition(parts, "q", "b")
    pairs = numbers.select("q", "b").join(queries.drop("dim"), "q").repartition(parts, "b").join(blocks, "b")
    found = pairs.select("dim", "query_ids", "queries", "ids", "vectors", "codes").mapInArrow(lambda it: _searched(it, means, k, bounds), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
