"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .ann import nearest
from .decontam import decontaminate
from .mixing import mix
from .neardup import near_duplicates
from .quality import score_quality
from .secretscan import scan_secrets
from .substring import remove_repeats
from .support import shared_folder
from .tokens import read_shards, write_shards
from .toxicity import score_toxicity
from .warc import archived, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as ids in binary shards, read back: where a document's ids begin, how many, and their crc32."""
    folder = f"{shared_folder(spark)}/tokens"
    write_shards(_table(spark, sf_dir, "documents"), folder, tokenizer_file(), eos=0)
    return read_shards(spark, folder)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document lie in 10-word windows of benchmark items, and of which items."""
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Target shares of tokens by language.
LANGUAGES = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mixing query: the language of the documents that ``labels`` names."""
    return docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", docs["lang"].alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its tokens, its soft membership in the languages, and the rate that mixes them to the targets."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    mixed = mix(docs, labelled_languages(docs, labels), LANGUAGES, keep=["doc_id"])
    parts = [F.round(F.col("_mix.posterior")[i], 6).alias(f"p_{d}") for i, d in enumerate(sorted(LANGUAGES))]
    return mixed.select("doc_id", F.col("_mix.tokens").alias("tokens"), *parts, F.round("_mix.rate", 6).alias("rate"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, equal payloads stored once, read back through the data source."""
    folder = f"{shared_folder(spark)}/warc"
    return archived(spark, folder, write_warc(_table(spark, sf_dir, "pages"), folder))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 13-word passages that an earlier document has."""
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every text, learnt from the labels that are not held out."""
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every text and its n_chars, learnt from the labels that are not held out."""
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), metadata=["n_chars"])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets in every text."""
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every 20th vector with all others."""
    return nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_secret_scan": op9_secret_scan,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT d.doc_id, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) l WHERE len(d.w) >= l.n)),
h AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op5_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
m AS (SELECT v, min(u) AS root FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = d.doc_id""",
    "op6_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_SPACED.format(text="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM g JOIN f USING (s) WHERE f.first_id < g.doc_id),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT t.doc_id, count(*) AS n, string_agg(t.x, ' ' ORDER BY t.p) AS kept FROM t ANTI JOIN c ON c.doc_id = t.doc_id AND c.p = t.p GROUP BY t.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op10_nearest_neighbours": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
}
