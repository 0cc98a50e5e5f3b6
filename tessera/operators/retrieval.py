"""Batched retrieval: sparse, dense, fused and reranked rankings of many queries in one job.

A ranking has qid, id, score and rank.  Scores are rounded before they order, so that ties are the same on any
number of executors; ties go to the smaller id.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship

K1, B, RRF_K, CANDIDATES, TOP_K = 1.5, 0.75, 60, 50, 5
DIGITS = 6
#: Query rows that may be broadcast: beyond it Spark shuffles.
BROADCAST_ROWS = 100_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a table that is counted to be small: for tables that cost little to read."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def small_ranking(ranking: DataFrame, queries: DataFrame, k: int, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a ranking by what it can have at most: k rows a query.  Only the queries are counted."""
    return F.broadcast(ranking) if queries.count() * k <= rows else ranking


@dataclass(frozen=True)
class Filters:
    """Scope of a search by column: None is unrestricted, an empty list matches nothing."""

    values: dict[str, list | None]

    def predicate(self) -> Column:
        out = F.lit(True)
        for name, allowed in self.values.items():
            if allowed is not None:
                out = out & (F.col(name).isin(list(allowed)) if allowed else F.lit(False))
        return out


def ranked(scores: DataFrame, k: int | None, *, tie: str = "id") -> DataFrame:
    """Ranks from 1 by score, then ``tie``; at most ``k`` for each query."""
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(tie)))
    out = scores.withColumn("rank", order)
    return out if k is None else out.where(F.col("rank") <= require_k(k))


def require_k(k: int) -> int:
    if k < 1:
        raise ValueError("k must be at least 1")
    return k


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of each document with its length, and the corpus' statistics (n, average length)."""
    lengths = docs.select("id", T.search_tokens(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))
    return lengths, lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def counted(tokens: Column) -> Column:
    """An array of (term, tf): tokens are sorted and runs of equal ones counted, within the row."""

    def runs(held: Column) -> Column:
        n = F.size(held)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(held, i) != F.get(held, i - 1))))
        return T.let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(held, i).alias("term"), (F.coalesce(F.get(at, j + 1), n) - i).alias("tf"))))

    return T.let(F.array_sort(tokens), runs)


def _asked(queries: DataFrame) -> DataFrame:
    """(qid, term): the distinct terms of each query."""
    return queries.select("qid", F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("term"))


def _words(terms: DataFrame) -> tuple[list[str], bool]:
    """The distinct terms of all queries, and whether the queries' terms are few enough to travel; one job, bounded rows."""
    rows = terms.limit(BROADCAST_ROWS + 1).collect()
    return sorted({r["term"] for r in rows}), len(rows) <= BROADCAST_ROWS


def _weights(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, idf, avgdl): the idf that is never negative.  ``stats`` is one row."""
    return df.crossJoin(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")


def _scored(postings: DataFrame, wanted: DataFrame, k1: float, b: float) -> DataFrame:
    part = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return postings.join(wanted, "term").groupBy("qid", "id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def _padded(scores: DataFrame, queries: DataFrame, ids: DataFrame, k: int | None) -> DataFrame:
    """Top k of each query; one that matched fewer is filled up with the first ids, at 0."""
    if k is None:
        return ranked(scores, None)
    top = ranked(scores, k).select("qid", "id", "score")
    # at most k others are needed, and those are among the first 2k ids
    first = ids.orderBy("id").limit(2 * require_k(k))
    pairs = queries.select("qid").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    best = top.unionByName(pairs).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return ranked(best, k)


def bm25(docs: DataFrame, queries: DataFrame, *, k: int | None = 10, k1: float = K1, b: float = B, allowed: DataFrame | None = None) -> DataFrame:
    """BM25 (the form whose idf is never negative) of ``docs`` (id, text) for ``queries`` (qid, text), without an index.

    Statistics are the whole corpus' even if ``allowed`` (id) narrows what may be returned.  With ``k``, documents
    without a match fill up the ranking in order of their ids, with a score of 0.
    """
    terms = _asked(queries)
    # the queries' words, if they are few, are looked up while a text is read: only counts of those leave its row
    words, few = _words(terms)
    tokens = docs.select("id", T.search_tokens(F.col("text")).alias("tokens"))
    matched = F.filter("tokens", lambda t: t.isin(words)) if few else F.col("tokens")
    held = tokens.select("id", F.size("tokens").alias("dl"), counted(matched).alias("terms")).repartition("id")
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = held.select("id", "dl", F.inline("terms"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    wanted = terms.join(_weights(df, stats), "term")
    wanted = F.broadcast(wanted) if few else wanted
    # documents lie by id: scores are summed where they are, and k rows a query leave
    postings = tf if allowed is None else tf.join(allowed.select("id"), "id", "left_semi")
    pool = docs if allowed is None else docs.join(allowed.select("id"), "id", "left_semi")
    return _padded(_scored(postings, wanted, k1, b), queries, pool.select("id"), k)


#: Folders that the terms of a stored index are dealt to: a search reads those of its terms.
TERM_PARTS = 64


def _term_part(term: Column) -> Column:
    """crc32, so that a driver knows a term's part without a job."""
    return (F.crc32(term.cast("binary")) % TERM_PARTS).cast("int")


def save_index(docs: DataFrame, folder: str, *, k1: float = K1, b: float = B, payload: list[str] | None = None) -> None:
    """A sparse index on disk: postings (term, id, tf, dl) by part of the term and in its order, document frequencies, rows
    (id and ``payload`` columns), and last the statistics, with the parameters that a later search takes from here."""
    rows = docs.select("id", *(payload or []), T.search_tokens(F.col("text")).alias("_tokens")).withColumn("dl", F.size("_tokens"))
    postings = rows.select("id", "dl", F.inline(counted(F.col("_tokens")))).withColumn("part", _term_part(F.col("term")))
    postings.repartition("part").sortWithinPartitions("part", "term", "id").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")
    held = docs.sparkSession.read.parquet(f"{folder}/postings")
    held.groupBy("part", "term").agg(F.count(F.lit(1)).alias("df")).repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/terms")
    rows.drop("_tokens").write.mode("overwrite").parquet(f"{folder}/rows")
    stats = docs.sparkSession.read.parquet(f"{folder}/rows").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    stats.withColumn("k1", F.lit(float(k1))).withColumn("b", F.lit(float(b))).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")


@dataclass(frozen=True)
class SparseIndex:
    """A stored index.  ``k1`` and ``b`` are those that it was built with."""

    spark: SparkSession
    folder: str
    k1: float
    b: float

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def search(self, queries: DataFrame, *, k: int | None = 10, allowed: DataFrame | None = None) -> DataFrame:
        """As ``bm25``: only the folders of the queries' terms are read."""
        terms = _asked(queries)
        words, few = _words(terms)
        postings, df = self.read("postings"), self.read("terms")
        if few:
            parts = sorted({zlib.crc32(w.encode()) % TERM_PARTS for w in words})
            scope = F.col("part").isin(parts) & F.col("term").isin(words) if words else F.lit(False)
            postings, df = postings.where(scope), df.where(scope)
        wanted = terms.join(_weights(df.select("term", "df"), self.read("stats").select("n", "avgdl")), "term")
        wanted = F.broadcast(wanted) if few else wanted
        ids = self.read("rows").select("id")
        if allowed is not None:
            postings, ids = postings.join(allowed.select("id"), "id", "left_semi"), ids.join(allowed.select("id"), "id", "left_semi")
        return _padded(_scored(postings.select("term", "id", "tf", "dl"), wanted, self.k1, self.b), queries, ids, k)


def load_index(spark: SparkSession, folder: str) -> SparseIndex:
    """An index that ``save_index`` wrote; its parameters stand, whatever the settings say now."""
    stats = spark.read.parquet(f"{folder}/stats").first()
    return SparseIndex(spark, folder, stats["k1"], stats["b"])


def load_or_build(docs: DataFrame, folder: str, *, force: bool = False, k1: float = K1, b: float = B, payload: list[str] | None = None) -> SparseIndex:
    """The index of a folder, built if there is none (its statistics are written last) or ``force`` says so."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/stats/_SUCCESS")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if force or not there:
        save_index(docs, folder, k1=k1, b=b, payload=payload)
    return load_index(spark, folder)


#: Queries that are multiplied with the documents at a time.
QUERY_BLOCK = 4096


def _top_products(batches: Iterator[pa.RecordBatch], qids: pa.Array, q: np.ndarray, k: int, counts: bool) -> Iterator[pa.RecordBatch]:
    """The k best cosines of each query in a task's documents: vectors, or buckets to be counted."""
    dim, held, held_ids = q.shape[1], np.zeros((0, len(q))), None
    for batch in batches:
        lists = batch.column(1)
        offsets = np.asarray(lists.offsets)
        flat = lists.values.to_numpy(zero_copy_only=False)
        if counts:
            rows = np.repeat(np.arange(len(lists)), np.diff(offsets))
            d = np.bincount(rows * dim + flat[offsets[0] : offsets[-1]], minlength=len(lists) * dim).reshape(-1, dim).astype(float)
        else:
            d = flat[offsets[0] : offsets[-1]].astype(float).reshape(len(lists), -1) if len(lists) else np.zeros((0, dim))
        size = np.sqrt(np.einsum("ij,ij->i", d, d))
        raw = (d / np.where(size == 0, 1, size)[:, None]) @ q.T
        score = np.round(raw, DIGITS)
        if counts:  # documents without a bucket in common are no hits
            score[raw <= 0] = -np.inf
        ids = batch.column(0) if held_ids is None else pa.concat_arrays([held_ids, batch.column(0)])
        score = np.concatenate([held, score])
        if len(score) > 4 * k:  # keep what is in some query's best, ties included
            least = np.partition(score, len(score) - k, axis=0)[len(score) - k]
            keep = np.flatnonzero((score >= least).any(axis=1))
            score, ids = score[keep], ids.take(pa.array(keep))
        held, held_ids = score, ids
    if held_ids is None:
        return
    order = np.argsort(np.asarray(pc.sort_indices(held_ids)))
    for j in range(len(q)):
        best = np.lexsort((order, -held[:, j]))[:k]
        best = best[held[best, j] > -np.inf]
        yield pa.RecordBatch.from_arrays([pa.array([qids[j].as_py()] * len(best), qids.type), held_ids.take(pa.array(best)), pa.array(held[best, j])], names=["qid", "id", "score"])


def _products(docs: DataFrame, queries: DataFrame, k: int, counts: bool) -> DataFrame:
    """Queries (qid, list) travel to the documents (id, list) in blocks, as one matrix; k rows a query and task come back."""
    require_k(k)
    ship(docs.sparkSession)
    kinds = dict(queries.dtypes), dict(docs.dtypes)
    schema = f"qid {kinds[0]['qid']}, id {kinds[1]['id']}, score double"
    out, block, blocks = None, [], []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            blocks.append(block)
            block = []
    for rows in [*blocks, block]:
        if not rows and out is not None:
            continue
        if counts:
            q = np.zeros((len(rows), DIM))
            for i, r in enumerate(rows):
                q[i] = np.bincount(r[1], minlength=DIM)
        else:
            q = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
        size = np.sqrt(np.einsum("ij,ij->i", q, q))
        q, qids = q / np.where(size == 0, 1, size)[:, None], pa.array([r[0] for r in rows], {"bigint": pa.int64(), "int": pa.int32()}.get(kinds[0]["qid"]))
        found = docs.mapInArrow(lambda it, qids=qids, q=q: _top_products(it, qids, q, k, counts), schema) if rows else docs.sparkSession.createDataFrame([], schema)
        out = found if out is None else out.unionByName(found)
    return ranked(out, k)


def dense(docs: DataFrame, queries: DataFrame, *, k: int = 10, vector: str = "vector") -> DataFrame:
    """Exact cosine top k of ``docs`` (id, vector) for ``queries`` (qid, vector); null vectors take no part, a zero one scores 0.

    All vectors have one length.
    """
    some = lambda rows, key: rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("list"))
    return _products(some(docs, "id"), some(queries, "qid"), k, counts=False)


#: Dimensions of the stand-in embedder.
DIM = 64


def buckets(text: Column) -> Column:
    """The dimension of each token of a text: a stand-in embedder that any engine can repeat, whose vector counts them.

    It comes from the token's first and last character and its length.
    """
    return F.transform(T.search_tokens(text), lambda t: F.pmod(F.ascii(t) * 131 + F.ascii(F.right(t, F.lit(1))) * 31 + F.length(t), F.lit(DIM)).cast("int"))


def dense_hashed(docs: DataFrame, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """Cosine top k over counts of buckets."""
    held = lambda rows, key: rows.select(key, buckets(F.col("text")).alias("list"))
    return _products(held(docs, "id"), held(queries, "qid"), k, counts=True)


def hits(ranking: DataFrame, docs: DataFrame) -> DataFrame:
    """A ranking with its documents' columns; a score that is missing is 0."""
    return docs.join(ranking, "id").withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))


def rrf(rankings: list[DataFrame], *, rrf_k: int = RRF_K, k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: a document counts once in each ranking, by its best rank."""
    if not rankings:
        raise ValueError("nothing to fuse")
    # grouped by one struct, that no ranking is partitioned by: Spark 4.1 plans a union of rankings as partitioned by qid, without
    # an exchange, but concatenates it if a ranking's exchange is reused, and a document's ranks would stay apart
    key = F.struct("qid", "id").alias("_key")
    each = [r.groupBy("qid", "id").agg(F.min("rank").alias("rank")).select(key, "rank") for r in rankings]
    union = each[0]
    for r in each[1:]:
        union = union.unionByName(r)
    scores = union.groupBy("_key").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"))
    return ranked(scores.select("_key.qid", "_key.id", "score"), k)


def rerank_identity(ranking: DataFrame, k: int) -> DataFrame:
    """The same order, cut to ``k`` and numbered anew."""
    kept = ranking.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("_r") <= require_k(k))
    return kept.withColumn("rank", F.col("_r")).drop("_r")


def _pairs(ranking: DataFrame, docs: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """(qid, id, query, text) of the hits; ``pool``: how many a query has at most."""
    asked = ranking.select("qid", "id").join(small(queries.select("qid", F.col("text").alias("query"))), "qid")
    return docs.select("id", "text").join(small_ranking(asked, queries, pool), "id")


def rerank(ranking: DataFrame, docs: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], k: int, *, pool: int = CANDIDATES) -> DataFrame:
    """The hits in order of ``score`` (query, text), a column function such as ``vectors.scorer`` makes of a model."""
    pairs = _pairs(ranking, docs, queries, pool)
    return ranked(pairs.select("qid", "id", F.round(score(F.col("query"), F.col("text")), DIGITS).alias("score")), k)


def shared_terms(query: Column, text: Column) -> Column:
    """The share of the query's terms that the text has: a score without a model."""
    asked = F.array_distinct(T.search_tokens(query))
    return F.size(F.array_intersect(asked, T.search_tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def rerank_lexical(ranking: DataFrame, docs: DataFrame, queries: DataFrame, k: int, *, pool: int = CANDIDATES) -> DataFrame:
    return rerank(ranking, docs, queries, shared_terms, k, pool=pool)


def pool_size(k: int, *, mode: str, rerank: bool, candidates: int = CANDIDATES) -> int:
    """How many hits each ranker hands on."""
    return candidates if rerank or mode == "hybrid" else k


MODES = ("dense", "sparse", "hybrid")


Embed = Callable[[Column], Column]


def encode_queries(queries: DataFrame, embed: Embed, prefix: str = T.QUERY_PREFIX) -> DataFrame:
    """(qid, vector): the prefix goes before queries alone."""
    return queries.select("qid", embed(T.query_text(F.col("text"), prefix)).alias("vector"))


def require_queries(queries: DataFrame) -> DataFrame:
    """``queries`` whose texts aren't blank; a blank or null one fails the job."""
    given = F.coalesce(T.strip(F.col("text")) != "", F.lit(False))
    return queries.withColumn("text", F.when(F.assert_true(given, F.lit("query must be non-empty")).isNull(), F.col("text")))


def search(docs: DataFrame, queries: DataFrame, *, mode: str = "hybrid", rerank: bool = False, k: int = TOP_K, filters: Filters | None = None, candidates: int = CANDIDATES, rrf_k: int = RRF_K, embed: Embed | None = None, score: Callable[[Column, Column], Column] | None = None, sparse: SparseIndex | None = None, prefix: str = T.QUERY_PREFIX) -> DataFrame:
    """The whole search, for many queries at once: rank, fuse, rerank or cut.

    ``docs`` has id, text and the filters' columns; ``queries`` has qid and text, none blank.  ``embed`` encodes queries if
    ``docs`` has the column vector (else counts of buckets stand in), ``score`` reranks, ``sparse`` is a stored index.
    """
    mode = mode.strip().lower()
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}. Known: {', '.join(MODES)}")
    queries = require_queries(queries)
    pool = pool_size(require_k(k), mode=mode, rerank=rerank, candidates=candidates)
    scope = None if filters is None else docs.where(filters.predicate()).select("id")
    found: list[DataFrame] = []
    if mode in ("dense", "hybrid"):
        own = docs if filters is None else docs.where(filters.predicate())
        found.append(dense(own, encode_queries(queries, embed, prefix), k=pool) if embed else dense_hashed(own, queries, k=pool))
    if mode in ("sparse", "hybrid"):
        found.append(sparse.search(queries, k=pool, allowed=scope) if sparse else bm25(docs, queries, k=pool, allowed=scope))
    ranking = found[0] if len(found) == 1 else rrf(found, rrf_k=rrf_k, k=pool if rerank else k)
    if rerank:
        return _reranked(ranking, docs, queries, score or shared_terms, k, pool)
    return ranking.where(F.col("rank") <= k).select("qid", "id", "score", "rank")


def _reranked(ranking: DataFrame, docs: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], k: int, pool: int) -> DataFrame:
    return rerank(ranking, docs, queries, score, k, pool=pool)
