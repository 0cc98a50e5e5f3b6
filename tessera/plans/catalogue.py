"""The registered queries of the retrieval operators and their SQL.

Each query has its SQL beside it.  Documents stand in for sections, benchmark passages for queries and gold quotes,
embeddings for chunk vectors, orders for filings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import generation as G
from ..operators import retrieval as R
from ..operators import store as S
from ..shipping import scratch
from ..sources import tables as logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Figures in every SQL text are the operators' defaults.
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_SMALL = ", ".join(f"'{w}'" for w in T.SMALL_WORDS)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", *more)


def passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


# ---------------------------------------------------------------- text and chunks


@query(r"""
WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '\S+\s*') AS pieces, length(regexp_extract(text, '^\s*')) AS lead FROM documents),
n AS (SELECT *, len(pieces) AS n FROM p WHERE len(pieces) > 0),
w AS (SELECT *, unnest(range(0, CASE WHEN n <= 400 THEN 1 ELSE CAST(ceil((n - 400) / 320.0) AS BIGINT) + 1 END)) AS i FROM n),
e AS (SELECT *, i * 320 AS s, least(i * 320 + 400, n) AS e FROM w)
SELECT doc_id, CAST(i AS INT) AS local_index,
  CAST(CASE WHEN s = 0 THEN 0 ELSE lead + length(array_to_string(pieces[1:s], '')) END AS INT) AS char_start,
  CAST(CASE WHEN e = n THEN length(text) ELSE lead + length(regexp_replace(array_to_string(pieces[1:e], ''), '\s+$', '')) END AS INT) AS char_end,
  CAST(e - s AS INT) AS token_count FROM e""")
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "local_index", "char_start", "char_end", "token_count")


_HEADERS = rf"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
flat AS (SELECT doc_id, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM lines),
bare AS (SELECT *, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS b,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM flat),
test AS (SELECT *, regexp_replace(b, '[^\p{{L}}]', '', 'g') AS letters, regexp_split_to_array(b, '\s+') AS words FROM bare),
head AS (SELECT doc_id, text, i, ofs, b, (b <> '' AND length(b) <= 120
  AND NOT (contains(b, ' | ') OR length(b) - length(replace(b, '|', '')) >= 2)
  AND ((length(letters) >= 2 AND regexp_full_match(letters, '\p{{Lu}}+'))
    OR (regexp_matches(b, '\p{{Lu}}') AND len(list_filter(words, lambda w: NOT (trim(w, '.,:;()[]"''') = ''
      OR lower(trim(w, '.,:;()[]"''')) IN ({_SMALL}) OR regexp_matches(trim(w, '.,:;()[]"'''), '^[\p{{Nd}}\p{{Lu}}]')))) = 0))) AS h FROM test),
prose AS (SELECT *, first_value(CASE WHEN b <> '' AND NOT h THEN length(b) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM head),
"""


@query(_HEADERS + r"""
kept AS (SELECT doc_id, text, ofs AS s FROM prose WHERE h AND next > length(b)),
starts AS (SELECT doc_id, text, s FROM kept UNION
  SELECT d.doc_id, d.text, 0 FROM documents d LEFT JOIN (SELECT doc_id, min(s) AS f FROM kept GROUP BY doc_id) k USING (doc_id)
  WHERE k.f IS NULL OR (k.f > 0 AND regexp_matches(substr(d.text, 1, CAST(k.f AS BIGINT)), '\S')))
SELECT doc_id, CAST(s AS INT) AS char_start, CAST(coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), length(text)) AS INT) AS char_end
FROM starts WHERE regexp_matches(text, '\S')""")
def structural_spans(spark: SparkSession, d: str) -> DataFrame:
    return C.structural_spans(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "char_start", "char_end")


@query(_HEADERS + "x AS (SELECT 1) SELECT doc_id, CAST(sum(CAST(h AS INT)) AS BIGINT) AS headers, CAST(sum(CAST(coalesce(h AND next > length(b), false) AS INT)) AS BIGINT) AS kept FROM prose GROUP BY doc_id")
def header_lines(spark: SparkSession, d: str) -> DataFrame:
    heads = C.header_marks(table(spark, d, "documents").select("doc_id", "text"))
    return heads.select("doc_id", _count("head").alias("headers"), _count("kept").alias("kept"))


def _count(flag: str):
    return F.size(F.filter("_heads", lambda h: h[flag])).cast("long")


@query(r"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z("''])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM documents)
SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars, CAST(max(length(s)) AS BIGINT) AS longest FROM s WHERE regexp_matches(s, '\S') GROUP BY doc_id""")
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = C.sentence_spans(table(spark, d, "documents").select("doc_id", "text"))
    n = F.col("char_end") - F.col("char_start")
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(n.cast("long")).alias("chars"), F.max(n.cast("long")).alias("longest"))


_COS = "list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda z: z[1] * z[2]))"


@query(f"""
WITH v AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
d AS (SELECT label, vec_id, CASE WHEN p IS NULL THEN NULL ELSE 1 - {_COS.format(a="e", b="p")} / (sqrt({_COS.format(a="e", b="e")}) * sqrt({_COS.format(a="p", b="p")})) END AS distance FROM v),
l AS (SELECT label, quantile_cont(distance, 0.95) AS lim FROM d GROUP BY label)
SELECT d.label, d.vec_id, round(d.distance, 6) AS distance, CAST(sum(CASE WHEN d.distance > l.lim THEN 1 ELSE 0 END) OVER (PARTITION BY d.label ORDER BY d.vec_id ROWS UNBOUNDED PRECEDING) AS INT) AS "group"
FROM d JOIN l ON d.label = l.label""")
def semantic_breaks(spark: SparkSession, d: str) -> DataFrame:
    rows = C.change_points(table(spark, d, "embeddings"), ["label"], ["vec_id"], "embedding")
    return rows.select("label", "vec_id", F.round("distance", 6).alias("distance"), "group")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, line, regexp_extract_all(line, '\S+\s*') AS pieces, length(regexp_extract(line, '^\s*')) AS lead FROM l WHERE regexp_matches(line, '\S')),
n AS (SELECT *, len(pieces) AS n FROM p),
w AS (SELECT *, unnest(range(0, CASE WHEN n <= 48 THEN 1 ELSE CAST(ceil((n - 40) / 32.0) AS BIGINT) + 1 END)) AS k FROM n),
e AS (SELECT *, CASE WHEN n <= 48 THEN 0 ELSE k * 32 END AS s, CASE WHEN n <= 48 THEN n ELSE least(k * 32 + 40, n) END AS e FROM w)
SELECT doc_id, CAST(i - 1 AS INT) AS line, CAST(k AS INT) AS local_index, CAST(e - s AS INT) AS token_count,
  CAST(CASE WHEN s = 0 THEN 0 ELSE lead + length(array_to_string(pieces[1:s], '')) END AS INT) AS char_start,
  CAST(CASE WHEN e = n THEN length(line) ELSE lead + length(regexp_replace(array_to_string(pieces[1:e], ''), '\s+$', '')) END AS INT) AS char_end FROM e""")
def cap_spans(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return C.capped(lines, "t", cap=48, size=40, overlap=8).select("doc_id", "line", "local_index", "token_count", "char_start", "char_end")


@query(r"""
SELECT doc_id, CASE WHEN length(c) <= 96 THEN c ELSE substr(c, 1, 93) || '...' END AS snippet
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(r"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS pieces, regexp_extract(text, '^\s*') AS lead FROM documents)
SELECT doc_id, len(pieces) AS tokens, CASE WHEN len(pieces) = 0 THEN '' ELSE lead || regexp_replace(array_to_string(pieces[1:20], ''), '\s+$', '') END AS head FROM p""")
def token_truncation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"), T.truncate_tokens(F.col("text"), 20).alias("head"))


# ---------------------------------------------------------------- retrieval

_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP}))"
_BM25 = f"""
toks AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
terms AS (SELECT DISTINCT item_id AS qid, term FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark)),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM toks) WHERE term IN (SELECT term FROM terms) GROUP BY id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
score AS (SELECT t.qid, f.id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * f.tf / (f.tf + 1.5 * (1 - 0.75 + 0.75 * f.dl / s.avgdl))), 6) AS score
  FROM terms t JOIN tf f ON t.term = f.term JOIN df d ON d.term = f.term CROSS JOIN stats s GROUP BY t.qid, f.id)"""


def _padded(k: int, name: str, score: str = "score", docs: str = "documents") -> str:
    """A ranking cut to k, filled up with unmatched documents at 0 in order of their ids."""
    return f"""{name} AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM (
  SELECT b.item_id AS qid, d.doc_id AS id, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN (SELECT doc_id FROM {docs}) d LEFT JOIN {score} s ON s.qid = b.item_id AND s.id = d.doc_id)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= {k})"""


@query(f"WITH {_BM25} SELECT s.n, round(s.avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS terms, CAST((SELECT sum(df) FROM df) AS BIGINT) AS postings FROM stats s")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    lengths, stats = R.index(docs(spark, d))
    terms = passages(spark, d).select(F.explode(T.search_tokens(F.col("text"))).alias("term")).distinct()
    df = lengths.select("id", F.explode(F.array_distinct("tokens")).alias("term")).join(R.small(terms), "term").groupBy("term").count()
    return stats.crossJoin(df.agg(F.count(F.lit(1)).alias("terms"), F.sum("count").alias("postings"))).select("n", F.round("avgdl", 6).alias("avgdl"), "terms", "postings")


@query(f"WITH {_BM25}, {_padded(10, 'r')} SELECT qid, id, score, rank FROM r")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(docs(spark, d), passages(spark, d), k=10).select("qid", "id", "score", "rank")


@query(f"WITH {_BM25}, {_padded(10, 'r', docs='(SELECT * FROM documents WHERE lang IN (' + chr(39) + 'de' + chr(39) + ', ' + chr(39) + 'fr' + chr(39) + '))')} SELECT qid, id, score, rank FROM r")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    scope = docs(spark, d, "lang").where(R.Filters({"lang": ["de", "fr"], "source": None}).predicate())
    return R.bm25(docs(spark, d), passages(spark, d), k=10, allowed=scope).select("qid", "id", "score", "rank")


_DENSE = f"""
WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.qid, e.vec_id AS id, e.label, round({_COS.format(a="q.q", b="e.embedding")} / (sqrt({_COS.format(a="q.q", b="q.q")}) * sqrt({_COS.format(a="e.embedding", b="e.embedding")})), 6) AS score FROM q CROSS JOIN embeddings e)
SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM s """


@query(_DENSE + "QUALIFY rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return R.dense(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), queries, k=10).select("qid", "id", "score", "rank")


@query(_DENSE + "WHERE label IN (1, 3) QUALIFY rank <= 10")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    scope = v.where(R.Filters({"label": [1, 3]}).predicate())
    return R.dense(scope.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), queries, k=10).select("qid", "id", "score", "rank")


@query("SELECT vec_id, label FROM embeddings WHERE false")
def empty_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(R.Filters({"label": []}).predicate()).select("vec_id", "label")


_HASHED = f"""
dt AS (SELECT doc_id AS k, unnest({_TOKENS}) AS t FROM documents), qt AS (SELECT item_id AS k, unnest({_TOKENS}) AS t FROM benchmark),
db AS (SELECT k, (unicode(t) * 131 + unicode(right(t, 1)) * 31 + length(t)) % 64 AS b, count(*) AS c FROM dt GROUP BY ALL),
qb AS (SELECT k, (unicode(t) * 131 + unicode(right(t, 1)) * 31 + length(t)) % 64 AS b, count(*) AS c FROM qt GROUP BY ALL),
dw AS (SELECT k, b, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS w FROM db), qw AS (SELECT k, b, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS w FROM qb),
hs AS (SELECT qw.k AS qid, dw.k AS id, round(sum(dw.w * qw.w), 6) AS score FROM dw JOIN qw USING (b) GROUP BY ALL)"""


def _top(k: int, name: str, source: str) -> str:
    return f"{name} AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM {source} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= {k})"


@query(f"WITH {_HASHED}, {_top(10, 'r', 'hs')} SELECT qid, id, score, rank FROM r")
def dense_hashed(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_hashed(docs(spark, d), passages(spark, d), k=10).select("qid", "id", "score", "rank")


_FUSED = f"{_BM25}, {_HASHED}, {_padded(50, 'sparse')}, {_top(50, 'dense', 'hs')}, fs AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT qid, id, rank FROM sparse UNION ALL SELECT qid, id, rank FROM dense) GROUP BY qid, id)"


@query(f"WITH {_FUSED}, {_top(10, 'r', 'fs')} SELECT qid, id, score, rank FROM r")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.search(docs(spark, d), passages(spark, d), mode="hybrid", k=10).select("qid", "id", "score", "rank")


_QUERY_TERMS = f"qs AS (SELECT item_id AS qid, list_distinct({_TOKENS}) AS q FROM benchmark)"


def _lexical(pool: str, name: str) -> str:
    return f"{name} AS (SELECT p.qid, p.id, round(len(list_intersect(qs.q, t.ts)) / greatest(len(qs.q), 1), 6) AS score FROM {pool} p JOIN qs USING (qid) JOIN toks t ON t.id = p.id)"


@query(f"WITH {_BM25}, {_padded(50, 'pool')}, {_QUERY_TERMS}, {_lexical('pool', 'ls')}, {_top(10, 'r', 'ls')} SELECT qid, id, score, rank FROM r")
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    return R.search(docs(spark, d), passages(spark, d), mode="sparse", rerank=True, k=10).select("qid", "id", "score", "rank")


@query(f"WITH {_BM25}, {_padded(10, 'r')} SELECT qid, id, score, rank FROM r WHERE rank <= 3")
def rerank_identity(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank_identity(R.bm25(docs(spark, d), passages(spark, d), k=10), 3).select("qid", "id", "score", "rank")


# ---------------------------------------------------------------- evaluation

_GOLD = "gold AS (SELECT DISTINCT b.item_id AS qid, d.source, d.lang FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_SECTIONS = "sec AS (SELECT {by}, source, lang, CAST(row_number() OVER (PARTITION BY {by} ORDER BY f) AS INT) AS rank FROM (SELECT {by}, source, lang, min(rank) AS f FROM {r} r JOIN documents d ON d.doc_id = r.id GROUP BY {by}, source, lang))"
_METRICS = """
gs AS (SELECT qid, count(*) AS g FROM gold GROUP BY qid),
hit AS (SELECT {bys}, sum(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) AS r1, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS r5, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS r10, min(rank) AS best, sum(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1.0) END) AS dcg FROM sec s JOIN gold USING (qid, source, lang) GROUP BY {bys}),
m AS (SELECT {by}, gs.g IS NOT NULL AS answerable, CASE WHEN gs.g IS NOT NULL THEN round(coalesce(r1, 0) / g, 6) END AS recall_at_1, CASE WHEN gs.g IS NOT NULL THEN round(coalesce(r5, 0) / g, 6) END AS recall_at_5, CASE WHEN gs.g IS NOT NULL THEN round(coalesce(r10, 0) / g, 6) END AS recall_at_10,
  CASE WHEN gs.g IS NOT NULL THEN round(coalesce(1.0 / best, 0), 6) END AS mrr,
  CASE WHEN gs.g IS NOT NULL THEN round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(g, 10) + 1), lambda i: 1.0 / log2(i + 1.0))), 6) END AS ndcg_at_10
  FROM {questions} LEFT JOIN gs USING (qid) LEFT JOIN hit USING ({by}))"""


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Sections that hold a passage."""
    return E.holding(docs(spark, d, "source", "lang"), passages(spark, d).withColumnRenamed("text", "quote")).select("qid", "source", "lang").distinct()


def _sections(spark: SparkSession, d: str, ranking: DataFrame, by: list[str] | None = None, most: int = 10) -> DataFrame:
    return E.collapse(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang").join(R.small_ranking(ranking, passages(spark, d), most), "id"), ["source", "lang"], by)


@query(f"WITH {_BM25}, {_padded(10, 'r')}, {_SECTIONS.format(by='qid', r='r')} SELECT qid, source, lang, rank FROM sec")
def section_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d, R.bm25(docs(spark, d), passages(spark, d), k=10)).select("qid", "source", "lang", "rank")


@query(f"WITH {_BM25}, {_padded(10, 'r')}, {_SECTIONS.format(by='qid', r='r')}, {_GOLD}, {_METRICS.format(by='qid', bys='qid', questions='(SELECT item_id AS qid FROM benchmark)')} SELECT * FROM m")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    sections = _sections(spark, d, R.bm25(docs(spark, d), passages(spark, d), k=10))
    return E.metrics(sections, _gold(spark, d), passages(spark, d).select("qid"), ["source", "lang"])


_MODES = [("dense", False), ("dense", True), ("sparse", False), ("sparse", True), ("hybrid", False), ("hybrid", True)]
#: A latency that any engine can repeat: by mode and question.
_LATENCY_SQL = "CAST((qid * 37 + length(mode) * 11 + CASE WHEN rerank THEN 900 ELSE 0 END) % 1000 AS DOUBLE)"


def _eval_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row for each cell of the grid and question: the six rankings share one collapse and one scoring."""
    rankings = None
    # rankings are pools of one set of rankers: fused and reranked from them
    dd, q = docs(spark, d), passages(spark, d)
    pools = {"dense": R.dense_hashed(dd, q, k=50), "sparse": R.bm25(dd, q, k=50)}
    pools["hybrid"] = R.rrf([pools["dense"], pools["sparse"]], k=50)
    for mode, rerank in _MODES:
        hits = R.rerank_lexical(pools[mode], dd, q, 10) if rerank else pools[mode].where("rank <= 10")
        rows = hits.select("qid", "id", "rank", F.lit("fixed").alias("strategy"), F.lit(mode).alias("mode"), F.lit(rerank).alias("rerank"))
        rankings = rows if rankings is None else rankings.unionByName(rows)
    by = ["strategy", "mode", "rerank", "qid"]
    cells = E.grid(spark, ["fixed"], ["dense", "sparse", "hybrid"], [False, True]).drop("position")
    questions = passages(spark, d).select("qid").crossJoin(F.broadcast(cells))
    rows = E.metrics(_sections(spark, d, rankings, by), _gold(spark, d), questions, ["source", "lang"], by=by)
    latency = (F.col("qid") * 37 + F.length("mode") * 11 + F.when(F.col("rerank"), 900).otherwise(0)) % 1000
    return rows.withColumn("total_ms", latency.cast("double"))


_EVAL = f"""{_FUSED}, {_top(50, 'hybrid', 'fs')}, {_QUERY_TERMS}, {_lexical('dense', 'l1')}, {_lexical('sparse', 'l2')}, {_lexical('hybrid', 'l3')},
{_top(10, 'r1', 'l1')}, {_top(10, 'r2', 'l2')}, {_top(10, 'r3', 'l3')},
allr AS (SELECT 'fixed' AS strategy, 'dense' AS mode, false AS rerank, qid, id, rank FROM dense WHERE rank <= 10 UNION ALL SELECT 'fixed', 'dense', true, qid, id, rank FROM r1
  UNION ALL SELECT 'fixed', 'sparse', false, qid, id, rank FROM sparse WHERE rank <= 10 UNION ALL SELECT 'fixed', 'sparse', true, qid, id, rank FROM r2
  UNION ALL SELECT 'fixed', 'hybrid', false, qid, id, rank FROM hybrid WHERE rank <= 10 UNION ALL SELECT 'fixed', 'hybrid', true, qid, id, rank FROM r3),
cells AS (SELECT 'fixed' AS strategy, m AS mode, r AS rerank FROM (VALUES ('dense'), ('sparse'), ('hybrid')) a(m) CROSS JOIN (VALUES (false), (true)) b(r)),
{_SECTIONS.format(by='strategy, mode, rerank, qid', r='allr')}, {_GOLD},
{_METRICS.format(by='strategy, mode, rerank, qid', bys='strategy, mode, rerank, qid', questions='(SELECT strategy, mode, rerank, item_id AS qid FROM benchmark CROSS JOIN cells)')},
rows AS (SELECT *, {_LATENCY_SQL} AS total_ms FROM m),
rep AS (SELECT strategy, mode, rerank, round(avg(recall_at_1), 6) AS recall_at_1, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_10), 6) AS ndcg_at_10,
  round(quantile_cont(total_ms, 0.5), 6) AS p50_ms, round(quantile_cont(total_ms, 0.95), 6) AS p95_ms, count(*) AS n, CAST(sum(CAST(answerable AS INT)) AS BIGINT) AS n_answerable FROM rows GROUP BY strategy, mode, rerank)"""


@query(f"WITH {_EVAL} SELECT * FROM rep")
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    return E.report(_eval_rows(spark, d))


@query(f"WITH {_EVAL}, w AS (SELECT strategy, mode, max(CASE WHEN NOT rerank THEN round(recall_at_5, 3) END) AS off, max(CASE WHEN rerank THEN round(recall_at_5, 3) END) AS \"on\" FROM rep GROUP BY strategy, mode) SELECT strategy, mode, off, \"on\", round(\"on\" - off, 3) AS gain FROM w")
def rerank_pivot(spark: SparkSession, d: str) -> DataFrame:
    return E.rerank_pivot(E.report(_eval_rows(spark, d)))


#: Reports over the vectors: a cell's rows are vectors, their "metrics" components, so that the reports have three strategies.
_CELL_SQL = """rows AS (SELECT CASE label % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN 'structural' ELSE 'semantic' END AS strategy, CASE vec_id % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'sparse' ELSE 'hybrid' END AS mode, vec_id % 2 = 1 AS rerank,
  vec_id % 10 <> 0 AS answerable, vec_id % 4 = 0 AS refused, CAST(label % 3 AS INT) AS position,
  round(abs(CAST(embedding[1] AS DOUBLE)), 6) AS recall_at_5, round(abs(CAST(embedding[2] AS DOUBLE)), 6) AS ndcg_at_10, round(abs(CAST(embedding[3] AS DOUBLE)), 6) AS mrr,
  CASE WHEN vec_id % 7 <> 0 THEN round(abs(CAST(embedding[4] AS DOUBLE)), 6) END AS faithfulness, round(abs(CAST(embedding[5] AS DOUBLE)), 6) AS context_precision, round(abs(CAST(embedding[6] AS DOUBLE)), 6) AS context_recall, round(abs(CAST(embedding[7] AS DOUBLE)), 6) AS relevancy,
  round(((vec_id * 13 % 5000) * 0.2 + (vec_id * 7 % 800) * 1.2) / 1000000, 9) AS usd, CAST(vec_id * 31 % 2000 AS DOUBLE) AS serving_ms, vec_id FROM embeddings)"""


def _cell_rows(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    at = lambda i: F.round(F.abs(F.get("embedding", F.lit(i)).cast("double")), 6)
    i = F.col("vec_id")
    return v.select(
        F.get(F.array(*map(F.lit, ("fixed", "structural", "semantic"))), F.col("label") % 3).alias("strategy"), F.get(F.array(*map(F.lit, ("dense", "sparse", "hybrid"))), (i % 3).cast("int")).alias("mode"), (i % 2 == 1).alias("rerank"),
        (i % 10 != 0).alias("answerable"), (i % 4 == 0).alias("refused"), (F.col("label") % 3).alias("position"), at(0).alias("recall_at_5"), at(1).alias("ndcg_at_10"), at(2).alias("mrr"),
        F.when(i % 7 != 0, at(3)).alias("faithfulness"), at(4).alias("context_precision"), at(5).alias("context_recall"), at(6).alias("relevancy"),
        F.round(T.cost_usd(i * 13 % 5000, i * 7 % 800), 9).alias("usd"), (i * 31 % 2000).cast("double").alias("serving_ms"), "vec_id",
    )


@query(f"""WITH {_CELL_SQL}, m AS (SELECT strategy, round(avg(recall_at_5), 9) AS r, round(avg(ndcg_at_10), 9) AS n, round(avg(mrr), 9) AS m, min(position) AS p FROM rows WHERE answerable GROUP BY strategy),
o AS (SELECT *, row_number() OVER w AS place, round(r - lead(r) OVER w, 6) AS lead FROM m WINDOW w AS (ORDER BY r DESC, n DESC, m DESC, p))
SELECT strategy, round(r, 6) AS recall_at_5, round(n, 6) AS ndcg_at_10, round(m, 6) AS mrr, lead FROM o WHERE place = 1""")
def winner(spark: SparkSession, d: str) -> DataFrame:
    return E.winner(_cell_rows(spark, d))


_RAG = f"""WITH {_CELL_SQL}, rep AS (SELECT strategy, mode, rerank, {", ".join(f"round(avg(CASE WHEN answerable THEN coalesce({c}, 0) END), 6) AS {c}" for c in ("faithfulness", "context_precision", "context_recall", "relevancy"))},
  round(avg(CASE WHEN NOT answerable THEN CAST(refused AS INT) END), 6) AS refusal_rate, CAST(sum(CASE WHEN answerable THEN 0 ELSE 1 END) AS BIGINT) AS n_unanswerable, round(avg(usd), 9) AS usd, round(quantile_cont(serving_ms, 0.5), 6) AS p50_ms, round(quantile_cont(serving_ms, 0.95), 6) AS p95_ms FROM rows GROUP BY strategy, mode, rerank)"""


@query(f"{_RAG} SELECT * FROM rep")
def rag_report(spark: SparkSession, d: str) -> DataFrame:
    return E.rag_report(_cell_rows(spark, d))


@query(f"{_RAG} SELECT min(context_precision) AS lo, max(context_precision) AS hi, (max(context_precision) - min(context_precision)) / min(context_precision) <= 0.10 AS flat FROM rep")
def spread(spark: SparkSession, d: str) -> DataFrame:
    return E.spread(E.rag_report(_cell_rows(spark, d)), "context_precision")


@query(f"{_RAG}, w AS (SELECT strategy, mode, max(CASE WHEN NOT rerank THEN context_precision END) AS off, max(CASE WHEN rerank THEN context_precision END) AS o FROM rep GROUP BY strategy, mode) SELECT coalesce(bool_and(o < off), false) AS all_hurt FROM w WHERE off IS NOT NULL AND o IS NOT NULL")
def all_rerank_hurt(spark: SparkSession, d: str) -> DataFrame:
    return E.all_hurt(E.rag_report(_cell_rows(spark, d)), "context_precision")


@query(f"{_RAG} SELECT strategy, mode, rerank, faithfulness FROM rep ORDER BY faithfulness DESC, strategy, mode, rerank LIMIT 1")
def best_generation(spark: SparkSession, d: str) -> DataFrame:
    return E.best_generation(E.rag_report(_cell_rows(spark, d))).select("strategy", "mode", "rerank", "faithfulness")


@query("""SELECT CAST((s * 3 + m) * 2 + r AS INT) AS position, sn AS strategy, mn AS mode, rn AS rerank
FROM (VALUES (0, 'fixed'), (1, 'structural'), (2, 'semantic')) a(s, sn) CROSS JOIN (VALUES (0, 'dense'), (1, 'sparse'), (2, 'hybrid')) b(m, mn) CROSS JOIN (VALUES (0, false), (1, true)) c(r, rn)""")
def eval_grid(spark: SparkSession, d: str) -> DataFrame:
    return E.grid(spark, ["fixed", "structural", "semantic"], list(R.MODES[:2]) + ["hybrid"], [False, True])


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_check(spark: SparkSession, d: str) -> DataFrame:
    found = E.holding(docs(spark, d), passages(spark, d).withColumnRenamed("text", "quote"))
    return found.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(E.percentile(F.col("value"), 0.5), 6).alias("p50"), F.round(E.percentile(F.col("value"), 0.95), 6).alias("p95"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- store, catalogue of filings, pages


@query("SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS fiscal_year, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_per_year(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("fiscal_year", F.year("o_orderdate"))
    return S.latest_per_year(rows, ["o_custkey", "fiscal_year"], date="o_orderdate", order="o_orderkey").select("o_custkey", "fiscal_year", "o_orderkey", "o_totalprice")


@query("SELECT o.o_orderkey, c.c_name, c.c_mktsegment, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F'")
def filings_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand in for chunks, customers for filings."""
    chunks = table(spark, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return S.with_filings(chunks, table(spark, d, "customer"), key="c_custkey", columns=("c_name", "c_mktsegment")).select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


_HALVES = "o AS (SELECT doc_id, text, n_chars FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '!' END AS text, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 3 <> 1)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    new = t.where("doc_id % 3 <> 1").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text"), (F.col("n_chars") + 1).alias("n_chars"))
    return t.where("doc_id % 3 <> 0"), new


@query(f"WITH {_HALVES} SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.n_chars, o.n_chars) AS n_chars, md5(coalesce(n.text, o.text)) AS digest FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    return S.upsert(*_halves(spark, d), ["doc_id"], ["text", "n_chars"]).select("doc_id", "n_chars", F.md5("text").alias("digest"))


@query(f"WITH {_HALVES} SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL OR o.text IS NOT DISTINCT FROM n.text THEN o.doc_id * 2 ELSE -1 END AS embedding FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def embedding_reuse(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return S.upsert_chunks(old.withColumn("embedding", F.col("doc_id") * 2), new, ["doc_id"]).select("doc_id", F.coalesce("embedding", F.lit(-1)).alias("embedding"))


@query(f"WITH {_HALVES} SELECT count(*) AS pending FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE NOT (n.doc_id IS NULL OR o.text IS NOT DISTINCT FROM n.text)")
def pending(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return S.unembedded(S.upsert_chunks(old.withColumn("embedding", F.col("doc_id") * 2), new, ["doc_id"])).agg(F.count(F.lit(1)).alias("pending"))


@query("SELECT l.lang, s.source FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = l.lang AND d.source = s.source AND d.n_chars > 3000)")
def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("lang", "source", "n_chars")
    expected = t.select("lang").distinct().crossJoin(t.select("source").distinct())
    return S.gaps(expected, t.where("n_chars > 3000"), ["lang", "source"])


@query("SELECT conv_id, turn, role, length(text) AS chars, NULL::VARCHAR AS note FROM conversations WHERE turn < 2 UNION ALL SELECT conv_id, turn, role, length(text), 'late' FROM conversations WHERE turn >= 2")
def page_union(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    return S.union_pages([t.where("turn < 2"), t.where("turn >= 2").withColumn("note", F.lit("late"))])


def _decoded(text: str) -> str:
    for entity, char in T.ENTITIES.items():
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


#: No page has a table or an exhibit: those steps have queries of their own.
_NODES = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
'(?is)<ix:hidden\b[^>]*>.*?</ix:hidden>', '', 'g'), '(?i)</?ix:[a-z0-9_.-]+\b[^>]*>', '', 'g'),
'(?is)<(script|style)\b[^>]*>.*?</(script|style)>', chr(3), 'g'), '(?s)<!--.*?-->', chr(3), 'g'), '(?s)<[^>]+>', chr(3), 'g')"""
_CLEAN = rf"""trim(regexp_replace(regexp_replace(regexp_replace({_decoded(_NODES)}, '[\s\x{{A0}}]*\x03[\s\x{{A0}}\x03]*', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(160))"""


@query(f"SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, {_CLEAN} AS t FROM pages)")
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


@query("SELECT page_id, code, CAST(char_start AS INT) AS char_start, CAST(char_end AS INT) AS char_end FROM (SELECT page_id, length(url) AS u FROM pages) CROSS JOIN LATERAL (VALUES ('1A', 30 + u, 87 + 2 * u), ('7', 87 + 2 * u, 104 + 4 * u)) v(code, char_start, char_end)")
def item_spans(spark: SparkSession, d: str) -> DataFrame:
    # a filing's shape made of the page's url: a contents list, then two items
    filing = F.concat(F.lit("Item 1A. x\nItem 7. y\nContents"), F.col("url"), F.lit("\nItem 1A. Risk Factors of "), F.col("url"), F.lit(" that are long enough, so it is\nItem 7. Analysis "), F.col("url"), F.col("url"))
    rows = table(spark, d, "pages").select("page_id", F.explode(S.item_spans(filing)).alias("s"))
    return rows.select("page_id", "s.code", "s.char_start", "s.char_end")


# ---------------------------------------------------------------- generation


@query("""WITH f AS (SELECT o_orderkey, c_name, CAST(year(o_orderdate) AS INT) AS y, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, '[' || c_name || ' FY' || y || ' Item ' || p || ']' AS tag FROM f""")
def citation_header(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "o_orderpriority")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", T.citation_tag(F.col("c_name"), F.col("y"), F.col("o_orderpriority")).alias("tag"))


@query(f"""WITH {_BM25}, {_padded(3, 'r')}
SELECT b.item_id AS qid, md5('Question:' || chr(10) || regexp_replace(b.text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'Contexts:' || chr(10) || string_agg('[' || r.rank || '] ' || d.source || ' FY' || 2024 || ' Item ' || d.lang || ' accession=' || d.doc_id || ' url=u' || chr(10) || d.text, chr(10) || chr(10) ORDER BY r.rank)) AS digest
FROM r JOIN benchmark b ON b.item_id = r.qid JOIN documents d ON d.doc_id = r.id GROUP BY b.item_id, b.text""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    q = passages(spark, d)
    hits = docs(spark, d, "source", "lang").join(R.small_ranking(R.bm25(docs(spark, d), q, k=3), q, 3), "id")
    hits = hits.select("qid", "rank", F.col("source").alias("ticker"), F.lit(2024).alias("fiscal_year"), F.col("lang").alias("item_code"), F.col("id").cast("string").alias("accession"), F.lit("u").alias("edgar_url"), "text")
    return G.prompts(q, hits).select("qid", F.md5("user").alias("digest"))


@query(r"""SELECT role, round(avg(CASE WHEN contains(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')), 'of the') THEN 1 ELSE 0 END), 6) AS refusal_rate, count(*) AS n FROM conversations GROUP BY role""")
def refusal_rate(spark: SparkSession, d: str) -> DataFrame:
    refused = T.is_refusal(F.col("text"), "Of the.")
    return table(spark, d, "conversations").groupBy("role").agg(F.round(F.avg(refused.cast("int")), 6).alias("refusal_rate"), F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT conv_id, CAST(sum(CASE WHEN role <> 'assistant' THEN len(regexp_extract_all(text, '\S+')) ELSE 0 END) AS BIGINT) AS p, CAST(sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '\S+')) ELSE 0 END) AS BIGINT) AS c FROM conversations GROUP BY conv_id)
SELECT conv_id, p AS prompt_tokens, c AS completion_tokens, round((p * 0.2 + c * 1.2) / 1000000, 9) AS usd FROM t""")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    n = T.token_count(F.col("text")).cast("long")
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", n).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("completion_tokens"))
    return t.withColumn("usd", F.round(T.cost_usd(F.col("prompt_tokens"), F.col("completion_tokens")), 9))


@query("SELECT conv_id, arg_min(CASE WHEN role = 'system' THEN text END, CASE WHEN role = 'system' THEN turn END) AS instructions, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END)::BIGINT AS turns FROM conversations GROUP BY conv_id HAVING sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) > 0")
def instructions_split(spark: SparkSession, d: str) -> DataFrame:
    return G.split_instructions(table(spark, d, "conversations"), "conv_id")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer, arg_max(turn, turn) AS last_turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Deltas of an answer in order, and the last usage: a conversation's turns are its deltas."""
    rows = table(spark, d, "conversations").where("role = 'assistant'").withColumn("last_turn", F.col("turn"))
    return G.join_stream(rows, "conv_id", order="turn", text="text", usage="last_turn")


@query("SELECT conv_id, turn, greatest(coalesce(TRY_CAST(text AS BIGINT), length(text) - 50, 0), 0) AS tokens FROM conversations")
def usage_coercion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.usage_count(F.col("text"), F.length("text") - 50).alias("tokens"))


@query("""SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f KiB', n_chars / 1024.0) END AS size, lpad(CAST(doc_id AS VARCHAR), 10, '0') AS cik, replace(source || '-' || lang, '-', '') AS accession FROM documents""")
def formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.format_bytes(F.col("n_chars")).alias("size"), T.pad_cik(F.col("doc_id")).alias("cik"), T.accession_key(F.concat_ws("-", "source", "lang")).alias("accession"))




# ---------------------------------------------------------------- keys, sets and numbering


@query(r"""
WITH p AS (SELECT doc_id, source, len(regexp_extract_all(text, '\S+\s*')) AS n FROM documents),
w AS (SELECT doc_id, source, unnest(range(0, CASE WHEN n <= 400 THEN 1 ELSE CAST(ceil((n - 400) / 320.0) AS BIGINT) + 1 END)) AS i FROM p WHERE n > 0)
SELECT source, doc_id, CAST(i AS INT) AS local_index, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS INT) AS chunk_index FROM w""")
def chunk_numbering(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.fixed(table(spark, d, "documents").select("doc_id", "source", "text")).select("source", "doc_id", "local_index")
    return C.number(chunks, ["source"], ["doc_id", "local_index"])


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    return S.duplicates(rows, ["digest"]).join(first, "digest")


@query("SELECT conv_id, role, min(turn) AS first_turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS INT) AS position FROM conversations GROUP BY conv_id, role")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "conversations").select("conv_id", "role", F.col("turn").alias("rank"))
    first = hits.groupBy("conv_id", "role").agg(F.min("rank").alias("first_turn"))
    return E.collapse(hits, ["role"], ["conv_id"]).withColumnRenamed("rank", "position").join(first, ["conv_id", "role"])


@query("SELECT l_orderkey, count(*) AS chunks, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS pending FROM lineitem GROUP BY l_orderkey")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.counts(table(spark, d, "lineitem"), ["l_orderkey"], pending=F.col("l_returnflag") == "N").withColumnRenamed("n", "chunks")


@query("SELECT l.l_orderkey, CAST(l.l_linenumber AS INT) AS l_linenumber, o.o_custkey, l.l_extendedprice FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderpriority = '1-URGENT'")
def chunk_scan(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_orderkey", "l_orderkey")
    return S.chunk_scan(table(spark, d, "lineitem"), orders, key="l_orderkey", order="l_linenumber", columns=("o_custkey",)).select("l_orderkey", "l_linenumber", "o_custkey", "l_extendedprice")


@query("""SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INT) AS fiscal_year, count(*) AS n, count(DISTINCT o_custkey) AS companies FROM orders GROUP BY 1, 2""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("fiscal_year"), "o_custkey")
    return S.run_counters(rows, ["status", "fiscal_year"], "o_custkey").withColumnRenamed("distinct", "companies")


@query("SELECT DISTINCT source, lang FROM documents JOIN labels USING (doc_id) INTERSECT SELECT DISTINCT source, lang FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def retrieved_and_gold(spark: SparkSession, d: str) -> DataFrame:
    """Sections with a labelled document, and those that hold a passage."""
    labelled = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return E.retrieved_gold(labelled, _gold(spark, d), ["source", "lang"])


@query("SELECT strategy || '/' || mode || '/' || CASE WHEN rerank THEN 'on' ELSE 'off' END AS label FROM (VALUES ('fixed'), ('structural'), ('semantic')) a(strategy) CROSS JOIN (VALUES ('dense'), ('sparse'), ('hybrid')) b(mode) CROSS JOIN (VALUES (false), (true)) c(rerank)")
def config_labels(spark: SparkSession, d: str) -> DataFrame:
    g = E.grid(spark, ["fixed", "structural", "semantic"], ["dense", "sparse", "hybrid"], [False, True])
    return g.select(T.config_label(F.col("strategy"), F.col("mode"), F.col("rerank")).alias("label"))



@query(rf"""WITH {_BM25}, {_padded(3, 'r')}, f AS (SELECT min(item_id) AS qid FROM benchmark),
h AS (SELECT r.rank, d.source, d.lang, d.doc_id, CASE WHEN length(c) <= 96 THEN c ELSE substr(c, 1, 93) || '...' END AS snippet FROM r JOIN f USING (qid) JOIN (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents) d ON d.doc_id = r.id)
SELECT CAST(rank - 1 AS INT) AS position, 'citations' AS kind, rank || ' ' || source || ' ' || lang || ' ' || doc_id || ' ' || snippet AS body FROM h
UNION ALL SELECT * FROM (VALUES (3, 'token', 'An'), (4, 'token', ' answer'), (5, 'done', '12 2'))""")
def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of one streamed answer: citations of the first passage's hits, two tokens, done."""
    q = passages(spark, d).orderBy("qid").limit(1)
    hits = docs(spark, d, "source", "lang").join(R.small_ranking(R.bm25(docs(spark, d), q, k=3), q, 3), "id")
    hits = hits.select("rank", "score", F.col("source").alias("ticker"), F.lit(2024).alias("fiscal_year"), F.col("lang").alias("item_code"), F.col("id").cast("string").alias("accession"), F.lit("").alias("edgar_url"), "text")
    rows: list[tuple[str, str]] = []
    for e in G.answer_events(hits, [{"delta": "An"}, {"delta": ""}, {"delta": " answer"}, {"type": "completed", "input_tokens": 12, "output_tokens": 2}]):
        if e.kind == "citations":
            rows += [(e.kind, f"{c['rank']} {c['ticker']} {c['item_code']} {c['accession']} {c['snippet']}") for c in e.data["citations"]]
        else:
            rows.append((e.kind, e.data["delta"] if e.kind == "token" else f"{e.data['prompt_tokens']} {e.data['completion_tokens']}"))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, kind string, body string")


# ---------------------------------------------------------------- stored index, lookups, pages, reports


@query(f"WITH {_BM25}, {_padded(10, 'r')} SELECT qid, id, score, rank FROM r")
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking from an index that is built, stored and read again."""
    return R.load_or_build(docs(spark, d), scratch(spark, "index")).search(passages(spark, d), k=10).select("qid", "id", "score", "rank")


@query("SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, o_orderpriority, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every line with its order's columns; a line without an order would fail the job."""
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_custkey")
    return S.require_known(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), known, ["l_orderkey"], "order")


_OLD_NEW = "o AS (SELECT doc_id, text, n_chars, lang FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '!' END AS text, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 3 <> 1)"


@query(f"WITH {_OLD_NEW} SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, md5(CASE WHEN n.doc_id IS NULL THEN o.text ELSE n.text END) AS digest, CASE WHEN n.doc_id IS NULL THEN o.n_chars ELSE n.n_chars END AS n_chars, o.lang, CASE WHEN n.doc_id IS NULL OR o.text IS NOT DISTINCT FROM n.text THEN o.doc_id * 2 END AS embedding FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All columns of a chunk survive an upsert: the new row's, and the old row's where the new has none."""
    old, new = _halves(spark, d)
    old = old.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("embedding", F.col("doc_id") * 2)
    return S.upsert_chunks(old, new, ["doc_id"]).select("doc_id", F.md5("text").alias("digest"), "n_chars", "lang", "embedding")


@query("SELECT vec_id, CASE WHEN label <> 3 THEN embedding[1] END AS first FROM embeddings")
def clear_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return S.clear_embeddings(table(spark, d, "embeddings"), F.col("label") == 3).select("vec_id", F.get("embedding", F.lit(0)).alias("first"))


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN embedding[2] ELSE embedding[1] END AS first FROM embeddings")
def write_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    turned = v.where("vec_id % 2 = 0").select("vec_id", F.reverse(F.slice("embedding", 1, 2)).alias("embedding"))
    two = v.select("vec_id", F.slice("embedding", 1, 2).alias("embedding"))
    return S.write_embeddings(two, turned, "vec_id", dim=2).select("vec_id", F.get("embedding", F.lit(0)).alias("first"))


@query("""WITH c AS (SELECT item_id, item_id % 50 AS doc_id, text FROM benchmark) SELECT c.item_id, CASE WHEN d.text IS NULL THEN 'section missing' ELSE 'quote not in section' END AS problem
FROM c LEFT JOIN documents d USING (doc_id) WHERE d.text IS NULL OR NOT contains(d.text, c.text)""")
def quote_misses(spark: SparkSession, d: str) -> DataFrame:
    """Each passage is cited from one document."""
    cited = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 50).alias("doc_id"), F.col("text").alias("quote"))
    return S.quote_misses(cited, table(spark, d, "documents").select("doc_id", "text"), ["doc_id"]).select("item_id", "problem")


@query("""WITH f AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS fiscal_year, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) AS r FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) IN (1996, 1998))
SELECT CAST(w.k AS VARCHAR) AS cik, w.y AS fiscal_year, CAST(f.o_orderkey AS VARCHAR) AS accession FROM (SELECT k, y FROM (SELECT DISTINCT o_custkey AS k FROM orders) CROSS JOIN (VALUES (1998), (1996)) v(y)) w LEFT JOIN f ON f.o_custkey = w.k AND f.fiscal_year = w.y AND f.r = 1""")
def select_filings(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the parallel arrays of a company's submissions."""
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("cik")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", date.alias("day"), "o_orderpriority"))).alias("o"))
    array = lambda f: F.transform("o", f)
    recent = F.struct(array(lambda x: x["o_orderkey"].cast("string")).alias("accessionNumber"), array(lambda x: x["day"]).alias("filingDate"), array(lambda x: x["day"]).alias("reportDate"), array(lambda x: x["o_orderpriority"]).alias("form"), array(lambda x: F.lit("p")).alias("primaryDocument"))
    submissions = rows.select("cik", F.lit("n").alias("name"), F.struct(recent.alias("recent")).alias("filings"))
    return S.select_filings(submissions, [1998, 1996], ["1-URGENT"]).select("cik", "fiscal_year", "accession")


@query("SELECT page_id, 'Before ' || url || chr(10) || 'Risk | ' || url || chr(10) || 'Cyber | High' || chr(10) || 'After' AS body FROM pages")
def flatten_tables(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a table of blank cells and rows, an empty table, and one with two rows."""
    html = F.concat(F.lit("<p>Before "), F.col("url"), F.lit("</p><table><tr><td> </td></tr></table><TABLE class='x'><tr><th>Risk</th><th>&nbsp;</th><th> "), F.col("url"), F.lit("</th></tr><tr><td></td></tr><tr><td><b>Cyber</b></td>\n<td>High</td></tr></TABLE><p>After</p>"))
    return table(spark, d, "pages").select("page_id", T.clean_html(html).alias("body"))


@query("SELECT page_id, 'Kept ' || url || CASE WHEN page_id % 2 = 0 THEN '' ELSE chr(10) || 'also' END AS body FROM pages")
def drop_after_exhibit(spark: SparkSession, d: str) -> DataFrame:
    anchor = F.when(F.col("page_id") % 2 == 0, F.lit('<a name="EX-10.1">x</a>')).otherwise(F.lit('<a name="EXTRA">also</a>'))
    html = F.concat(F.lit("<p>Kept "), F.col("url"), F.lit("</p>"), anchor, F.when(F.col("page_id") % 2 == 0, F.lit("<p>gone</p>")).otherwise(F.lit("")))
    return table(spark, d, "pages").select("page_id", T.clean_html(html).alias("body"))


@query("""WITH p AS (SELECT page_id, length(url) AS u, url FROM pages),
r AS (SELECT page_id, 0 AS section_pos, '7' AS item_code, 'ok' AS status, 'Item 7. Analysis ' || url || url AS text FROM p UNION ALL SELECT page_id, 1, '1A', 'ok', 'Item 1A. Risk Factors of ' || url || ' that are long enough, so it is' FROM p UNION ALL SELECT page_id, 2, '9', 'missing', NULL FROM p)
SELECT page_id, CAST(section_pos AS INT) AS section_pos, item_code, CASE item_code WHEN '1A' THEN 'Risk Factors' WHEN '9' THEN 'Item 9' ELSE 'Management''s Discussion and Analysis of Financial Condition and Results of Operations' END AS item_title, text, status FROM r""")
def parse_filings(spark: SparkSession, d: str) -> DataFrame:
    """Wanted items in the order wanted, trimmed; one that the page lacks."""
    html = F.concat(F.lit("<p>Item 1A. x</p><p>Item 7. y</p><p>Contents"), F.col("url"), F.lit("</p><p>Item 1A. Risk Factors of "), F.col("url"), F.lit(" that are long enough, so it is</p><p>Item 7. Analysis "), F.col("url"), F.col("url"), F.lit("</p>"))
    rows = S.parse_filings(table(spark, d, "pages").select("page_id", html.alias("html")), ["7", " 1a", "9"])
    return rows.select("page_id", "section_pos", "item_code", "item_title", "text", "status")


@query(r"""WITH t AS (SELECT doc_id, substr(text, 11, 300) AS p FROM documents), w AS (SELECT *, regexp_extract_all(p, '\S+\s*') AS w, regexp_extract(p, '^\s*') AS lead FROM t),
c AS (SELECT doc_id, CASE WHEN len(w) > 20 THEN lead || regexp_replace(array_to_string(w[1:20], ''), '\s+$', '') ELSE p END AS text FROM w)
SELECT doc_id, text, CAST(110 AS INT) AS char_start, CAST(110 + length(text) AS INT) AS char_end, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS token_count FROM c""")
def clip(spark: SparkSession, d: str) -> DataFrame:
    """Characters 10 to 310 of a text, 20 tokens at most, with offsets from 100."""
    rows = table(spark, d, "documents").select("doc_id", T.clip(F.col("text"), F.lit(10), F.lit(310), 20, offset=100).alias("c"))
    return rows.select("doc_id", "c.text", "c.char_start", "c.char_end", "c.token_count")


@query(r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS pieces, regexp_extract(text, '^\s*') AS lead, text FROM documents),
n AS (SELECT *, len(pieces) AS n FROM p WHERE len(pieces) > 0),
w AS (SELECT *, unnest(range(0, CASE WHEN n <= 40 THEN 1 ELSE CAST(ceil((n - 40) / 30.0) AS BIGINT) + 1 END)) AS i FROM n),
e AS (SELECT *, i * 30 AS s, least(i * 30 + 40, n) AS e FROM w),
k AS (SELECT *, CASE WHEN e - s > 32 THEN s + 32 ELSE e END AS ke FROM e)
SELECT doc_id, CAST(i AS INT) AS local_index, CAST(ke - s AS INT) AS token_count,
  md5(CASE WHEN ke = n THEN CASE WHEN s = 0 THEN lead ELSE '' END || array_to_string(pieces[s + 1:ke], '') ELSE regexp_replace(CASE WHEN s = 0 THEN lead ELSE '' END || array_to_string(pieces[s + 1:ke], ''), '\s+$', '') END) AS digest FROM k""")
def fixed_capped(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 40 tokens under a cap of 32: each keeps its first 32."""
    chunks = C.fixed(table(spark, d, "documents").select("doc_id", "text"), cap=32, size=40, overlap=10)
    return chunks.select("doc_id", "local_index", "token_count", F.md5("chunk").alias("digest"))


@query(_HEADERS + r"""
kept AS (SELECT doc_id, text, ofs AS s FROM prose WHERE h AND next > length(b)),
starts AS (SELECT doc_id, text, s FROM kept UNION
  SELECT d.doc_id, d.text, 0 FROM documents d LEFT JOIN (SELECT doc_id, min(s) AS f FROM kept GROUP BY doc_id) k USING (doc_id)
  WHERE k.f IS NULL OR (k.f > 0 AND regexp_matches(substr(d.text, 1, CAST(k.f AS BIGINT)), '\S'))),
spans AS (SELECT doc_id, s AS base, substr(text, CAST(s AS BIGINT) + 1, CAST(coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), length(text)) - s AS BIGINT)) AS t FROM starts WHERE regexp_matches(text, '\S')),
p AS (SELECT doc_id, base, t, regexp_extract_all(t, '\S+\s*') AS pieces, length(regexp_extract(t, '^\s*')) AS lead FROM spans WHERE regexp_matches(t, '\S')),
n AS (SELECT *, len(pieces) AS n FROM p),
w AS (SELECT *, unnest(range(0, CASE WHEN n <= 48 THEN 1 ELSE CAST(ceil((n - 40) / 32.0) AS BIGINT) + 1 END)) AS k FROM n),
e AS (SELECT *, CASE WHEN n <= 48 THEN 0 ELSE k * 32 END AS s, CASE WHEN n <= 48 THEN n ELSE least(k * 32 + 40, n) END AS e FROM w)
SELECT doc_id, CAST(base + CASE WHEN s = 0 THEN 0 ELSE lead + length(array_to_string(pieces[1:s], '')) END AS INT) AS char_start,
  CAST(base + CASE WHEN e = n THEN length(t) ELSE lead + length(regexp_replace(array_to_string(pieces[1:e], ''), '\s+$', '')) END AS INT) AS char_end, CAST(e - s AS INT) AS token_count FROM e""")
def structural(spark: SparkSession, d: str) -> DataFrame:
    """Header spans, those above a cap of 48 tokens cut into windows."""
    chunks = C.structural(table(spark, d, "documents").select("doc_id", "text"), cap=48, size=40, overlap=8)
    return chunks.select("doc_id", "char_start", "char_end", "token_count")


@query(f"""WITH {_CELL_SQL}, m AS (SELECT strategy, round(avg(recall_at_5), 9) AS r, round(avg(ndcg_at_10), 9) AS n, round(avg(mrr), 9) AS m, min(position) AS p FROM rows WHERE answerable GROUP BY strategy),
w AS (SELECT * FROM m ORDER BY r DESC, n DESC, m DESC, p LIMIT 1)
SELECT w.strategy, m.strategy AS other, round(w.r - m.r, 6) AS lead FROM m CROSS JOIN w WHERE m.strategy <> w.strategy""")
def strategy_leads(spark: SparkSession, d: str) -> DataFrame:
    return E.leads(_cell_rows(spark, d))


_CELL_REPORT = "rep AS (SELECT strategy, mode, rerank, round(avg(CASE WHEN answerable THEN recall_at_5 END), 6) AS recall_at_5, round(avg(CASE WHEN answerable THEN ndcg_at_10 END), 6) AS ndcg_at_10, round(avg(CASE WHEN answerable THEN mrr END), 6) AS mrr FROM rows GROUP BY ALL)"


def _cell_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _cell_rows(spark, d).withColumn("recall_at_1", F.col("mrr")).withColumn("recall_at_10", F.col("mrr")).withColumn("total_ms", F.col("serving_ms"))
    return E.report(rows)


@query(f"""WITH {_CELL_SQL}, {_CELL_REPORT}, f AS (SELECT strategy, {", ".join(f"round(max(CASE WHEN mode = '{m}' AND rerank = {r} THEN recall_at_5 END), 3) AS {n}" for m, r, n in (("dense", "false", "a"), ("dense", "true", "b"), ("hybrid", "false", "c"), ("hybrid", "true", "e")))} FROM rep GROUP BY strategy)
SELECT strategy, round(b - a, 3) AS rerank_dense, round(c - a, 3) AS fuse, round(e - c, 3) AS rerank_hybrid FROM f""")
def fusion_steps(spark: SparkSession, d: str) -> DataFrame:
    return E.fusion_steps(_cell_report(spark, d))


@query(f"WITH {_CELL_SQL}, {_CELL_REPORT} SELECT strategy, mode, rerank, recall_at_5 FROM rep ORDER BY recall_at_5 DESC, ndcg_at_10 DESC, mrr DESC, strategy, mode, rerank LIMIT 1")
def best_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return E.best_retrieval(_cell_report(spark, d)).select("strategy", "mode", "rerank", "recall_at_5")


@query(f"WITH {_CELL_SQL} SELECT strategy, round(avg(faithfulness), 6) AS faithfulness, round(avg(context_precision), 6) AS context_precision, round(avg(context_recall), 6) AS context_recall, round(avg(relevancy), 6) AS relevancy, round(avg(serving_ms), 6) AS judge_ms, count(faithfulness) AS n_scored FROM rows GROUP BY strategy")
def mean_judged(spark: SparkSession, d: str) -> DataFrame:
    return E.mean_judged(_cell_rows(spark, d).withColumn("judge_ms", F.col("serving_ms")), ["strategy"])


@query(f"""WITH {_CELL_SQL}, g AS (SELECT strategy, mode, rerank FROM (VALUES ('fixed'), ('structural'), ('semantic')) a(strategy) CROSS JOIN (VALUES ('dense'), ('sparse'), ('hybrid')) b(mode) CROSS JOIN (VALUES (false), (true)) c(rerank))
SELECT g.strategy, g.mode, g.rerank FROM g WHERE EXISTS (SELECT 1 FROM rows r WHERE r.strategy = g.strategy AND r.mode = g.mode AND r.rerank = g.rerank AND r.recall_at_5 > 0.3)""")
def present_cells(spark: SparkSession, d: str) -> DataFrame:
    grid = E.grid(spark, ["fixed", "structural", "semantic"], ["dense", "sparse", "hybrid"], [False, True])
    return logs.present_cells(grid, _cell_rows(spark, d).where("recall_at_5 > 0.3")).select("strategy", "mode", "rerank")


@query("SELECT count(DISTINCT conv_id) AS questions, count(DISTINCT CASE WHEN conv_id % 5 = 0 THEN conv_id END) AS unanswerable FROM conversations")
def log_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), (F.col("conv_id") % 5 != 0).alias("answerable"))
    return E.log_counts(rows)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS query, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE round(value, 3) END AS encode_ms, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 3) END AS mrr,
round(CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE round(value, 3) END + 2.5, 6) AS total, round(CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE round(value, 3) END + 2.5 + round(value, 3), 6) AS serving FROM events""")
def log_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a log that lack texts, timings and metrics: defaults, and sums of the stages."""
    e = table(spark, d, "events").withColumn("v", F.round("value", 3))
    i = F.col("event_id")
    line = F.to_json(F.struct(i.cast("string").alias("question_id"), F.when(i % 3 != 0, F.col("event_type")).alias("query"), F.when(i % 4 != 0, F.col("v")).alias("encode_ms"), F.when(i % 5 == 0, F.lit("bad")).alias("strategy"), F.when(i % 5 != 0, F.col("v")).alias("mrr"), F.lit(2.5).alias("dense_ms")))
    rows = logs.lenient(e.select("v", F.from_json(line, logs.RETRIEVAL_LOG).alias("r")).select("v", "r.*"))
    total = T.total_ms()
    return rows.select(F.col("question_id").cast("long").alias("event_id"), "query", "encode_ms", "mrr", F.round(total, 6).alias("total"), F.round(T.serving_ms(total, F.col("v")), 6).alias("serving"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS n, source AS first FROM documents")
def section_codec(spark: SparkSession, d: str) -> DataFrame:
    """Sections written as JSON and read; an entry without an item is dropped."""
    t = table(spark, d, "documents")
    entry = F.struct(F.col("source").alias("accession"), F.lit("1A").alias("item_code"))
    other = F.struct(F.lit("x").alias("accession"), F.when(F.col("doc_id") % 3 != 0, F.lit("7")).alias("item_code"))
    held = T.decode_sections(T.encode_sections(F.array(entry, other)))
    return t.select("doc_id", F.size(held).alias("n"), F.get(held, F.lit(0))["accession"].alias("first"))


@query("SELECT item_id, 'Represent this sentence for searching relevant passages: ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS asked FROM benchmark")
def query_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.query_text(F.col("text")).alias("asked"))
