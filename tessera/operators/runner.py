"""Evaluation over a grid: every question through every strategy, mode and reranking, in batches.

All questions of a cell are one job; its wall-clock time, spread over the questions, is what a log calls total_ms.
Rankings are written before they are scored, so that no ranking is computed twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import scratch
from . import evaluation as E
from . import generation as G
from . import retrieval as R

STRATEGIES = ("fixed", "structural", "semantic")
KEYS = ["accession", "item_code"]


@dataclass(frozen=True)
class Grid:
    """The cells of a run, in order."""

    strategies: tuple[str, ...] = STRATEGIES
    modes: tuple[str, ...] = R.MODES
    rerank: tuple[bool, ...] = (False, True)

    def frame(self, spark: SparkSession) -> DataFrame:
        return E.grid(spark, list(self.strategies), list(self.modes), list(self.rerank))


@dataclass(frozen=True)
class Models:
    """What is injected; without them counts of buckets stand in for vectors and shared terms for a reranker."""

    embed: Callable[[Column], Column] | None = None
    score: Callable[[Column, Column], Column] | None = None


def rankings(chunks: dict[str, DataFrame], questions: DataFrame, grid: Grid, folder: str, *, k: int = 10, models: Models | None = None, candidates: int = R.CANDIDATES, sparse: dict[str, R.SparseIndex] | None = None) -> DataFrame:
    """(strategy, mode, rerank, qid, id, rank, score, total_ms) of all cells, read back from ``folder``.

    ``chunks`` has a table (id, text, and a vector if a model embeds) for each strategy of the grid.  Pools are
    ranked once: fusion and reranking start from the same two of each strategy.
    """
    models = models or Models()
    spark = questions.sparkSession
    asked = R.require_queries(questions.select("qid", "text"))
    n = questions.count()
    if not n:
        raise ValueError("there are no questions")
    for strategy in grid.strategies:
        docs = chunks[strategy]
        pools: dict[str, DataFrame] = {}
        taken: dict[str, float] = {}

        def pool(name: str, make: Callable[[], DataFrame], strategy: str = strategy, pools: dict = pools, taken: dict = taken) -> DataFrame:
            if name not in pools:
                began, path = time.perf_counter(), f"{folder}/pools/{strategy}-{name}"
                make().write.mode("overwrite").parquet(path)
                pools[name], taken[name] = spark.read.parquet(path), (time.perf_counter() - began) * 1000 / n
            return pools[name]

        index = (sparse or {}).get(strategy)
        dense = lambda docs=docs: R.dense(docs, R.encode_queries(asked, models.embed), k=candidates) if models.embed else R.dense_hashed(docs, asked, k=candidates)
        terms = lambda docs=docs, index=index: index.search(asked, k=candidates) if index else R.bm25(docs, asked, k=candidates)
        for mode in grid.modes:
            parts = {"dense": [("dense", dense)], "sparse": [("sparse", terms)]}.get(mode, [("dense", dense), ("sparse", terms)])
            found = [pool(name, make) for name, make in parts]
            base = sum(taken[name] for name, _ in parts)
            hits = found[0] if len(found) == 1 else R.rrf(found, k=candidates)
            for rerank in grid.rerank:
                began = time.perf_counter()
                cell = R.rerank(hits, docs, asked, models.score or R.shared_terms, k, pool=candidates) if rerank else hits.where(F.col("rank") <= R.require_k(k))
                path = f"{folder}/hits/strategy={strategy}/mode={mode}/rerank={str(rerank).lower()}"
                cell.select("qid", "id", "rank", "score").write.mode("overwrite").parquet(path)
                spent = base + (time.perf_counter() - began) * 1000 / n
                spark.createDataFrame([(strategy, mode, rerank, spent)], "strategy string, mode string, rerank boolean, total_ms double").write.mode("append").parquet(f"{folder}/times")
    times = spark.read.parquet(f"{folder}/times").groupBy(*E.CELL).agg(F.max("total_ms").alias("total_ms"))
    return spark.read.parquet(f"{folder}/hits").join(F.broadcast(times), E.CELL)


def score(ranked: DataFrame, chunks: dict[str, DataFrame], questions: DataFrame, gold: DataFrame, grid: Grid, *, keys: list[str] = KEYS, k: int = 10) -> DataFrame:
    """Rows of a retrieval log: metrics of every question in every cell, from the sections (``keys``) of its hits."""
    spark = questions.sparkSession
    by = [*E.CELL, "qid"]
    sections = None
    for strategy in grid.strategies:
        own = R.small_ranking(ranked.where(F.col("strategy") == strategy), questions, k * len(grid.modes) * len(grid.rerank))
        rows = chunks[strategy].select("id", *keys).join(own, "id")
        sections = rows if sections is None else sections.unionByName(rows)
    cells = grid.frame(spark)
    asked = questions.select("qid").crossJoin(F.broadcast(cells.drop("position")))
    collapsed = E.collapse(sections, keys, by)
    rows = E.metrics(collapsed, gold, asked, keys, by=by)
    times = F.broadcast(ranked.select(*E.CELL, "total_ms").distinct())
    listed = collapsed.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *keys))), lambda x: F.struct(*[x[c].alias(c) for c in keys])).alias("retrieved_sections"))
    return rows.join(times, E.CELL, "left").join(listed, by, "left").join(F.broadcast(cells), E.CELL)


def evaluate(chunks: dict[str, DataFrame], questions: DataFrame, gold: DataFrame, grid: Grid | None = None, *, keys: list[str] = KEYS, k: int = 10, models: Models | None = None, folder: str | None = None, sparse: dict[str, R.SparseIndex] | None = None) -> DataFrame:
    """The first stage: a log's rows for ``questions`` (qid, text) and ``gold`` (qid, keys) over the grid."""
    grid = grid or Grid()
    ranked = rankings(chunks, questions, grid, folder or scratch(questions.sparkSession, "evaluation"), k=k, models=models, sparse=sparse)
    return score(ranked, chunks, questions, gold, grid, keys=keys, k=k)


def evaluate_answers(ranked: DataFrame, docs: DataFrame, questions: DataFrame, answerer: G.Answerer, judge: Callable | None, grid: Grid, *, k: int = R.TOP_K) -> DataFrame:
    """The second stage, of one strategy: answers to ``questions`` (qid, text, answerable, answer) over each cell's top k, judged if
    there is a judge.  ``ranked`` is what ``rankings`` gave; ``docs`` has a hit's columns.  A failing model or judge is an error of its row."""
    out = None
    for mode in grid.modes:
        for rerank in grid.rerank:
            cell = ranked.where((F.col("strategy") == grid.strategies[0]) & (F.col("mode") == mode) & (F.col("rerank") == rerank) & (F.col("rank") <= k))
            hits = R.hits(R.small_ranking(cell.select("qid", "id", "rank", "score", "total_ms"), questions, k), docs)
            prompted = G.prompts(questions, hits)
            rows = G.answers(prompted, answerer).join(prompted.select("qid", F.substring_index("user", "\n\nContexts:\n", -1).alias("contexts")), "qid")
            rows = questions.select("qid", F.col("text").alias("query"), "answerable", F.col("answer").alias("reference")).join(rows, "qid")
            if judge is not None:
                rows = G.judged(rows, judge)
            times = hits.groupBy("qid").agg(F.max("total_ms").alias("total_ms"))
            rows = rows.join(times, "qid", "left").withColumns({"strategy": F.lit(grid.strategies[0]), "mode": F.lit(mode), "rerank": F.lit(rerank)})
            out = rows if out is None else out.unionByName(rows)
    from ..functions import text as T

    return out.withColumn("serving_ms", T.serving_ms(F.col("total_ms"), F.col("generate_ms")))


def pick_strategy(log: DataFrame, strategies: Iterable[str] = STRATEGIES) -> str:
    """The winner of a first stage's log, which the second stage is run on."""
    order = {s: i for i, s in enumerate(strategies)}
    place = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(i)) for s, i in order.items()])
    best = E.winner(log.withColumn("position", place)).first()
    if best is None:
        raise ValueError("the log has no scored rows")
    return best["strategy"]
