"""Rankings, fusion, metrics and reports by hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import retrieval as R


def ranking(spark, *ids, qid=0):
    return spark.createDataFrame([(qid, i, float(-n), n + 1) for n, i in enumerate(ids)], "qid int, id int, score double, rank int")


def order(df):
    return [r["id"] for r in df.orderBy("qid", "rank").collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "cybersecurity cybersecurity risk", "A"), (2, "market risk cybersecurity", "B"), (3, "plain words", "B")], "id int, text string, ticker string")


def test_bm25(spark, docs):
    q = spark.createDataFrame([(0, "cybersecurity")], "qid int, text string")
    assert order(R.bm25(docs, q, k=3)) == [1, 2, 3]  # the last one fills up with 0
    only = R.bm25(docs, q, k=1, allowed=docs.where("id = 3").select("id")).first()
    assert (only["id"], only["score"]) == (3, 0.0)


def test_filters(spark, docs):
    assert docs.where(R.Filters({"ticker": None}).predicate()).count() == 3
    assert docs.where(R.Filters({"ticker": []}).predicate()).count() == 0
    assert docs.where(R.Filters({"ticker": ["B"]}).predicate()).count() == 2


def test_dense(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "id int, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, vector array<double>")
    assert [(r["id"], r["score"]) for r in R.dense(d, q, k=5).orderBy("rank").collect()] == [(0, 1.0), (1, 0.0)]


def test_rrf(spark):
    out = R.rrf([ranking(spark, 1, 2), ranking(spark, 2, 3)]).orderBy("rank").collect()
    assert [r["id"] for r in out] == [2, 1, 3]
    assert [r["score"] for r in out] == pytest.approx([1 / 62 + 1 / 61, 1 / 61, 1 / 62], abs=1e-9)


def test_rrf_counts_once(spark):
    out = R.rrf([ranking(spark, 1, 1)]).collect()
    assert len(out) == 1 and out[0]["score"] == pytest.approx(1 / 61, abs=1e-9)


def test_rrf_beside_its_rankings(spark):
    """In one plan with a ranking that it is made of, whose exchange it reuses, a fusion still counts a document once."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 17}x" for j in range(1, 2 + i % 7))) for i in range(60)], "id long, text string")
    asked = spark.createDataFrame([(q, f"w{q}x w{q + 3}x w{2 * q}x") for q in range(8)], "qid long, text string")
    dense, sparse = R.dense_hashed(docs, asked, k=10), R.bm25(docs, asked, k=10)
    fused = R.rrf([dense, sparse], k=10)
    cells = [R.rerank_lexical(hits, docs, asked, 50).select("qid", "id", F.lit(name).alias("cell")) for name, hits in (("dense", dense), ("fused", fused))]
    scores = {}
    for r in dense.collect() + sparse.collect():
        scores.setdefault(r["qid"], {}).setdefault(r["id"], []).append(1 / (60 + r["rank"]))
    best = [(q, i) for q, of in scores.items() for i in sorted(of, key=lambda i: (-round(sum(of[i]), 9), i))[:10]]
    assert sorted((r["qid"], r["id"]) for r in cells[0].unionByName(cells[1]).collect() if r["cell"] == "fused") == sorted(best)


def test_identity(spark):
    assert order(R.rerank_identity(ranking(spark, 3, 1, 2), 2)) == [3, 1]


def test_search_modes(spark, docs):
    q = spark.createDataFrame([(0, "market risk")], "qid int, text string")
    for mode in R.MODES:
        for rerank in (False, True):
            assert order(R.search(docs, q, mode=mode, rerank=rerank, k=1)) == [2]
    with pytest.raises(ValueError):
        R.search(docs, q, mode="other")
    with pytest.raises(ValueError):
        R.search(docs, q, k=0)


def hits(spark, *sections):
    return spark.createDataFrame([(0, s, n + 1) for n, s in enumerate(sections)], "qid int, s string, rank int")


def test_collapse(spark):
    assert [r["s"] for r in E.collapse(hits(spark, "A", "A", "B", "A"), ["s"]).orderBy("rank").collect()] == ["A", "B"]


def test_metrics(spark):
    gold = spark.createDataFrame([(0, "A"), (0, "B")], "qid int, s string")
    row = E.metrics(hits(spark, "C", "A", "B"), gold, spark.createDataFrame([(0,), (1,)], "qid int"), ["s"]).orderBy("qid").collect()
    assert (row[0]["recall_at_1"], row[0]["recall_at_5"], row[0]["mrr"]) == (0.0, 1.0, 0.5)
    assert row[1]["answerable"] is False and row[1]["mrr"] is None and row[1]["ndcg_at_10"] is None


def test_ndcg(spark):
    gold = spark.createDataFrame([(0, "A")], "qid int, s string")
    assert E.metrics(hits(spark, "C", "A"), gold, gold.select("qid"), ["s"]).first()["ndcg_at_10"] == pytest.approx(1 / math.log2(3), abs=1e-6)


def test_percentile(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "x double")
    assert df.agg(E.percentile(F.col("x"), 0.5), E.percentile(F.col("x"), 0.95)).first()[:] == (30.0, 48.0)
    with pytest.raises(ValueError):
        E.percentile(F.col("x"), 1.5)


def test_grid(spark):
    rows = E.grid(spark, ["fixed", "structural", "semantic"], ["dense", "sparse", "hybrid"], [False, True]).orderBy("position").collect()
    assert len(rows) == 18 and rows[0][1:] == ("fixed", "dense", False) and rows[-1][1:] == ("semantic", "hybrid", True)


def test_winner_ties(spark):
    rows = [("a", 0, 0.5, 0.4, 0.1), ("b", 1, 0.5, 0.5, 0.1), ("c", 2, 0.5, 0.5, 0.2)]
    df = spark.createDataFrame([(s, p, True, r, n, m) for s, p, r, n, m in rows], "strategy string, position int, answerable boolean, recall_at_5 double, ndcg_at_10 double, mrr double")
    assert E.winner(df).first()["strategy"] == "c"
