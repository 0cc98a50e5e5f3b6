"""Information-retrieval metrics and the reports over an evaluation's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import small

CUTS = (1, 5, 10)
JUDGED = ("faithfulness", "context_precision", "context_recall", "relevancy")
NDCG_K = 10


def collapse(hits: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Sections in the order in which they are first seen: ``by`` (qid by default), keys and a compact rank."""
    by = by or ["qid"]
    first = hits.groupBy(*by, *keys).agg(F.min("rank").alias("_first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_first"))).drop("_first")


def metrics(sections: DataFrame, gold: DataFrame, questions: DataFrame, keys: list[str], *, cuts: tuple[int, ...] = CUTS, ndcg_k: int = NDCG_K, by: list[str] | None = None) -> DataFrame:
    """recall at each cut, mrr and ndcg of each question, null for those without gold.

    ``sections`` is a collapsed ranking, ``gold`` has qid and keys, ``questions`` has qid; ``by`` adds grouping columns that
    ``sections`` and ``questions`` share.
    """
    by = by or ["qid"]
    golden = gold.select("qid", *keys).distinct()
    size = golden.groupBy("qid").agg(F.count(F.lit(1)).alias("_gold"))
    hit = sections.join(golden, ["qid", *keys], "left_semi").groupBy(*by)
    found = hit.agg(*[F.sum(F.when(F.col("rank") <= c, 1).otherwise(0)).alias(f"_r{c}") for c in cuts], F.min("rank").alias("_best"), F.sum(F.when(F.col("rank") <= ndcg_k, 1.0 / F.log2(F.col("rank") + 1.0))).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_gold"), F.lit(ndcg_k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    joined = questions.select(*by).distinct().join(size, "qid", "left").join(found, by, "left")
    asked = F.col("_gold").isNotNull()
    out = [F.when(asked, F.round(F.coalesce(F.col(f"_r{c}"), F.lit(0)) / F.col("_gold"), 6)).alias(f"recall_at_{c}") for c in cuts]
    return joined.select(*by, asked.alias("answerable"), *out, F.when(asked, F.round(F.coalesce(1.0 / F.col("_best"), F.lit(0.0)), 6)).alias("mrr"), F.when(asked, F.round(F.coalesce(F.col("_dcg"), F.lit(0.0)) / ideal, 6)).alias(f"ndcg_at_{ndcg_k}"))


def percentile(value: Column, p: float) -> Column:
    """Linear interpolation over the sorted sample; ``p`` in [0, 1]."""
    if not 0.0 <= p <= 1.0:
        raise ValueError("p must be in [0, 1]")
    return F.percentile(value, F.lit(p))


CELL = ["strategy", "mode", "rerank"]


def report(rows: DataFrame) -> DataFrame:
    """A retrieval report by cell: macro means over answerable rows, latency percentiles over all."""
    quality = [F.round(F.avg(F.when(F.col("answerable"), F.col(c))), 6).alias(c) for c in ("recall_at_1", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")]
    return rows.groupBy(*CELL).agg(*quality, F.round(percentile(F.col("total_ms"), 0.5), 6).alias("p50_ms"), F.round(percentile(F.col("total_ms"), 0.95), 6).alias("p95_ms"), F.count(F.lit(1)).alias("n"), F.sum(F.col("answerable").cast("int")).alias("n_answerable"))


def rag_report(rows: DataFrame) -> DataFrame:
    """A generation report by cell: a missing judge's metric of an answerable row counts as 0; refusals of the others."""
    judged = [F.round(F.avg(F.when(F.col("answerable"), F.coalesce(F.col(c), F.lit(0.0)))), 6).alias(c) for c in ("faithfulness", "context_precision", "context_recall", "relevancy")]
    refused = F.round(F.avg(F.when(~F.col("answerable"), F.col("refused").cast("int"))), 6)
    unanswerable = F.sum((~F.col("answerable")).cast("long")).alias("n_unanswerable")
    return rows.groupBy(*CELL).agg(*judged, unanswerable, refused.alias("refusal_rate"), F.round(F.avg("usd"), 9).alias("usd"), F.round(percentile(F.col("serving_ms"), 0.5), 6).alias("p50_ms"), F.round(percentile(F.col("serving_ms"), 0.95), 6).alias("p95_ms"))


def mean_judged(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means of the judged metrics over the rows that have them; a group without any has nulls."""
    return rows.groupBy(*by).agg(*[F.round(F.avg(c), 6).alias(c) for c in (*JUDGED, "judge_ms")], F.count("faithfulness").alias("n_scored"))


def _strategy_means(rows: DataFrame) -> DataFrame:
    """A row for each strategy, three at most: unrounded means over the scored rows."""
    scored = rows.where("answerable AND recall_at_5 IS NOT NULL AND ndcg_at_10 IS NOT NULL AND mrr IS NOT NULL")
    return scored.groupBy("strategy").agg(*[F.round(F.avg(c), 9).alias(c) for c in ("recall_at_5", "ndcg_at_10", "mrr")], F.min("position").alias("position"))


def winner(rows: DataFrame) -> DataFrame:
    """The strategy with the best mean recall at 5, then ndcg, then mrr, then the first seen; its lead over the next."""
    order = Window.orderBy(F.desc("recall_at_5"), F.desc("ndcg_at_10"), F.desc("mrr"), "position")
    placed = _strategy_means(rows).withColumn("place", F.row_number().over(order)).withColumn("lead", F.round(F.col("recall_at_5") - F.lead("recall_at_5").over(order), 6))
    return placed.where("place = 1").select("strategy", F.round("recall_at_5", 6).alias("recall_at_5"), F.round("ndcg_at_10", 6).alias("ndcg_at_10"), F.round("mrr", 6).alias("mrr"), "lead")


def leads(rows: DataFrame) -> DataFrame:
    """How far the winner's mean recall is above each other strategy's, from unrounded means: (strategy, other, lead)."""
    means = _strategy_means(rows).select("strategy", "recall_at_5", "position")
    best = F.broadcast(winner(rows).select(F.col("strategy").alias("best")))
    top = means.join(best, F.col("strategy") == F.col("best")).select(F.col("strategy").alias("winner"), F.col("recall_at_5").alias("r"))
    return means.crossJoin(F.broadcast(top)).where("strategy <> winner").select(F.col("winner").alias("strategy"), F.col("strategy").alias("other"), F.round(F.col("r") - F.col("recall_at_5"), 6).alias("lead"))


def best_retrieval(reports: DataFrame) -> DataFrame:
    """The cell with the best recall at 5, then ndcg, then mrr; of equal ones the first."""
    return reports.where("recall_at_5 IS NOT NULL").orderBy(F.desc("recall_at_5"), F.desc("ndcg_at_10"), F.desc("mrr"), *CELL).limit(1)


def best_generation(reports: DataFrame) -> DataFrame:
    """The cell with the best faithfulness; of equal ones the first."""
    return reports.where("faithfulness IS NOT NULL").orderBy(F.desc("faithfulness"), *CELL).limit(1)


def fusion_steps(reports: DataFrame) -> DataFrame:
    """Of each strategy what reranking dense, fusing, and reranking the fusion add to recall at 5, of figures of three digits."""
    at = lambda mode, rerank: F.round(F.max(F.when((F.col("mode") == mode) & (F.col("rerank") == rerank), F.col("recall_at_5"))), 3)
    four = reports.groupBy("strategy").agg(at("dense", False).alias("a"), at("dense", True).alias("b"), at("hybrid", False).alias("c"), at("hybrid", True).alias("d"))
    gain = lambda x, y, name: F.round(F.col(x) - F.col(y), 3).alias(name)
    return four.select("strategy", gain("b", "a", "rerank_dense"), gain("c", "a", "fuse"), gain("d", "c", "rerank_hybrid"))


def log_counts(log: DataFrame) -> DataFrame:
    """Questions of a log, and how many of them have no answer."""
    return log.agg(F.count_distinct("question_id").alias("questions"), F.count_distinct(F.when(~F.col("answerable"), F.col("question_id"))).alias("unanswerable"))


def retrieved_gold(retrieved: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct sections that are both retrieved and gold."""
    return retrieved.select(*keys).intersect(gold.select(*keys))


def rerank_pivot(reports: DataFrame, metric: str = "recall_at_5") -> DataFrame:
    """``metric`` of each strategy and mode with and without reranking, and the difference of the rounded figures."""
    wide = reports.groupBy("strategy", "mode").pivot("rerank", [False, True]).agg(F.round(F.first(metric), 3))
    return wide.select("strategy", "mode", F.col("false").alias("off"), F.col("true").alias("on"), F.round(F.col("true") - F.col("false"), 3).alias("gain"))


def spread(reports: DataFrame, metric: str, *, flat: float = 0.10) -> DataFrame:
    """Least and greatest of a metric; flat if they differ by a tenth of the least or less."""
    ends = reports.agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    return ends.withColumn("flat", F.coalesce((F.col("hi") - F.col("lo")) / F.when(F.col("lo") != 0, F.col("lo")) <= flat, F.col("hi") == F.col("lo")))


def all_hurt(reports: DataFrame, metric: str) -> DataFrame:
    """Whether reranking lowers a metric in every mode; false if there's no pair."""
    pairs = reports.groupBy("strategy", "mode").pivot("rerank", [False, True]).agg(F.first(metric)).where("`false` IS NOT NULL AND `true` IS NOT NULL")
    return pairs.agg(F.coalesce(F.bool_and(F.col("true") < F.col("false")), F.lit(False)).alias("all_hurt"))


def grid(spark: SparkSession, strategies: list[str], modes: list[str], rerank: list[bool]) -> DataFrame:
    """Every combination, numbered in the order of the axes."""
    axis = lambda name, values, kind: spark.createDataFrame(list(enumerate(values)), f"_{name} int, {name} {kind}")
    cells = axis("strategy", strategies, "string").crossJoin(axis("mode", modes, "string")).crossJoin(axis("rerank", rerank, "boolean"))
    at = (F.col("_strategy") * len(modes) + F.col("_mode")) * len(rerank) + F.col("_rerank")
    return cells.select(at.cast("int").alias("position"), "strategy", "mode", "rerank")


#: Words of a quote that are looked up; a shorter quote is compared with every text.
GRAM = 3


def _grams(text: Column) -> Column:
    words = F.split(text, r"(?U)\s+")
    return T.let(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - GRAM, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def holding(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(qid, and the columns of ``docs`` but text) of the documents (text) that hold a quote (qid, quote).

    Three whole words of a quote are its key, the longest ones: documents are joined on the keys that they hold, and only
    those pairs are compared.  Quotes without three words inside are compared with every document.
    """
    inner = F.expr("slice(_w, 2, greatest(size(_w) - 2, 0))")
    keyed = quotes.select("qid", "quote", F.split("quote", r"(?U)\s+").alias("_w")).withColumn("_i", inner)
    grams = F.transform(F.sequence(F.lit(0), F.size("_i") - GRAM), lambda i: F.concat_ws(" ", F.get("_i", i), F.get("_i", i + 1), F.get("_i", i + 2)))
    longest = F.array_max(F.transform(grams, lambda g: F.struct(F.length(g).alias("n"), g.alias("g"))))["g"]
    keyed = keyed.select("qid", "quote", F.when(F.size("_i") >= GRAM, longest).alias("_key"))
    rest = [c for c in docs.columns if c != "text"]
    words = [r["_key"] for r in keyed.where("_key IS NOT NULL").select("_key").distinct().limit(KEYS + 1).collect()]
    held = F.filter(F.array_distinct(_grams(F.col("text"))), lambda g: g.isin(words)) if len(words) <= KEYS else F.array_distinct(_grams(F.col("text")))
    candidates = docs.select(*docs.columns, F.explode(held).alias("_key"))
    asked = keyed.where("_key IS NOT NULL")
    found = candidates.join(F.broadcast(asked) if len(words) <= KEYS else asked, "_key").where(F.col("text").contains(F.col("quote"))).select("qid", *rest)
    short = keyed.where("_key IS NULL").drop("_key")
    if short.isEmpty():
        return found
    return found.unionByName(docs.join(small(short), F.col("text").contains(F.col("quote"))).select("qid", *rest))


#: Keys of quotes that are looked up while a text is read; more are joined.
KEYS = 100_000
