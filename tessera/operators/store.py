"""The chunk store's operations on tables: upserts that keep vectors, pending work, counts, filings and their choice."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.filings import all_filings
from . import retrieval


def upsert(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of either side, the new one's values where both have the key.  Nothing is deleted."""
    a, b = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = a.join(b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    pick = lambda c: F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select(*[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in key], *[pick(c) for c in columns])


def upsert_chunks(old: DataFrame, new: DataFrame, key: list[str], *, text: str = "text", vector: str = "embedding") -> DataFrame:
    """Upsert of chunks: a vector is kept if the text is the same (null as null), else it's null and to be made again.

    All other columns are the new row's, those that ``new`` lacks the old row's."""
    a, b = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = a.join(b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    kept = F.when(F.col("n._new").isNull() | F.col(f"o.{text}").eqNullSafe(F.col(f"n.{text}")), F.col(f"o.{vector}"))

    def value(c: str) -> Column:
        if c in key:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        if c == vector:
            return kept
        new_one = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        old_one = F.col(f"o.{c}") if c in old.columns else F.lit(None)
        return F.when(F.col("n._new"), new_one if c in new.columns else old_one).otherwise(old_one)

    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    return joined.select(*[value(c).alias(c) for c in columns])


def unembedded(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    return chunks.where(F.col(vector).isNull())


def clear_embeddings(chunks: DataFrame, where: Column, vector: str = "embedding") -> DataFrame:
    """``chunks`` without the vectors of those that ``where`` holds for; a null condition holds for none."""
    where = F.coalesce(where, F.lit(False))
    return chunks.withColumn(vector, F.when(~where, F.col(vector)))


def write_embeddings(chunks: DataFrame, vectors: DataFrame, key: str, *, dim: int, vector: str = "embedding") -> DataFrame:
    """Set vectors by key; a vector of another length, or for a chunk that isn't there, fails the job."""
    v = vectors.select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    joined = chunks.join(v, chunks[key] == v["_k"], "full_outer")
    right = F.col("_v").isNull() | (F.size("_v") == dim)
    checked = F.when(F.assert_true(right, F.lit("vector of another length")).isNull() & F.assert_true(chunks[key].isNotNull(), F.lit("no chunk for a vector")).isNull(), F.coalesce("_v", chunks[vector]))
    return joined.select(*[checked.alias(c) if c == vector else chunks[c] for c in chunks.columns])


def gaps(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Expected keys that were not found, sorted: what a run reports as missing."""
    return expected.select(*key).distinct().join(found.select(*key).distinct(), key, "left_anti").orderBy(*key)


def latest_per_year(filings: DataFrame, key: list[str], *, date: str, order: str) -> DataFrame:
    """Of each key the row of the latest date; of equal dates the first by ``order``."""
    w = Window.partitionBy(*key).orderBy(F.col(date).desc(), F.col(order))
    return filings.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def select_filings(submissions: DataFrame, years: list[int], forms: list[str], filings: DataFrame | None = None) -> DataFrame:
    """One filing for each company and wanted year: exact form, a report date in the year, the latest filing date.

    ``filings`` are those of ``filings.all_filings`` (older pages included); the recent ones if it is left out.  A wanted year
    without a filing is a row with a null accession, so that a caller can report it.
    """
    rows = all_filings(submissions.sparkSession, submissions) if filings is None else filings
    rows = rows.where(F.col("form").isin(forms) & (F.col("report_date") != "")).withColumn("place", F.struct("page", "position"))
    rows = rows.withColumn("fiscal_year", T.fiscal_year(F.col("report_date"))).where(F.col("fiscal_year").isin(years))
    chosen = latest_per_year(rows, ["cik", "fiscal_year"], date="filing_date", order="place").drop("name", "page", "position", "place")
    wanted = submissions.select("cik", "name").crossJoin(F.broadcast(submissions.sparkSession.createDataFrame(list(enumerate(years)), "year_position int, fiscal_year int")))
    return wanted.join(chosen, ["cik", "fiscal_year"], "left").orderBy("cik", "year_position")


def quote_misses(citations: DataFrame, sections: DataFrame, key: list[str]) -> DataFrame:
    """Citations (key, quote) whose section is missing or doesn't hold the quote: an equi-join on the key."""
    joined = citations.join(sections.select(*key, F.col("text").alias("_t")), key, "left")
    problem = F.when(F.col("_t").isNull(), "section missing").when(~F.col("_t").contains(F.col("quote")), "quote not in section")
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").drop("_t")


def item_spans(text: Column) -> Column:
    """Sections of a filing's text: of each item code the longest stretch from its heading to the next heading.

    A heading is a line "Item <code>." ; the contents list has the same lines, but short stretches.  Returns an array of
    (code, char_start, char_end), the first of equally long ones.
    """
    # the line's beginning is kept apart by a mark, so that lengths add up to offsets
    marked = F.regexp_replace(text, r"(?im)^(?=[ \t]*item\s+\d{1,2}[A-Z]?\s*\.)", "\x01")
    code = lambda p: F.upper(F.regexp_extract(p, r"(?i)^[ \t]*item\s+(\d{1,2}[A-Z]?)\s*\.", 1))
    parts = F.transform(F.split(marked, "\x01"), lambda p: F.struct(code(p).alias("code"), F.length(p).alias("n")))

    def longest(found: Column, run: Column) -> Column:
        spans = F.filter(F.transform(found, lambda s, i: F.struct(s["n"].alias("n"), i.alias("i"), s["code"].alias("code"))), lambda s: s["code"] != "")
        # a heading has two digits and a letter at most, so that the codes are few however often they come
        best = lambda held: F.transform(F.array_distinct(F.transform(held, lambda s: s["code"])), lambda c: F.array_max(F.transform(F.filter(held, lambda s: s["code"] == c), lambda s: F.struct(s["n"].alias("n"), (-s["i"]).alias("i"), s["code"].alias("code")))))
        at = lambda s: T.sum_upto(run, -s["i"]).cast("int")
        return F.transform(T.let(spans, lambda held: F.array_sort(best(held), lambda x, y: y["i"] - x["i"])), lambda s: F.struct(s["code"].alias("code"), at(s).alias("char_start"), (at(s) + s["n"]).alias("char_end")))

    return T.let(parts, lambda found: T.let(T.running(F.transform(found, lambda s: s["n"])), lambda run: longest(found, run)))


ITEMS = ("1A", "7", "7A")


def parse_filings(filings: DataFrame, items: Iterable[str] = ITEMS, *, html: str = "html", key: str = "accession") -> DataFrame:
    """A row for each filing and wanted item, in the order wanted: ``filings`` without its html, section_pos, item_code, item_title,
    text (trimmed), char_start and char_end (before trimming, in the cleaned page), and status.

    An item that a page lacks has the status "missing" and null text; ``parsed`` makes an error of it.
    """
    wanted = [i.strip().upper() for i in items]
    titles = F.create_map(*[F.lit(x) for pair in T.ITEM_TITLES.items() for x in pair])
    kept = [c for c in filings.columns if c != html]
    held = filings.withColumn("_text", T.clean_html(F.col(html))).withColumn("_spans", item_spans(F.col("_text")))
    rows = held.select(*kept, "_text", "_spans", F.posexplode(F.array(*map(F.lit, wanted))).alias("section_pos", "item_code"))
    span = F.get(F.filter("_spans", lambda s: s["code"] == F.col("item_code")), F.lit(0))
    rows = rows.withColumn("_span", span)
    body = T.strip(F.substring(F.col("_text"), F.col("_span.char_start") + 1, F.col("_span.char_end") - F.col("_span.char_start")))
    title = F.coalesce(F.element_at(titles, F.col("item_code")), F.concat(F.lit("Item "), F.col("item_code")))
    return rows.select(*kept, "section_pos", "item_code", title.alias("item_title"), body.alias("text"), "_span.char_start", "_span.char_end", F.when(F.col("_span").isNull(), "missing").otherwise("ok").alias("status"))


def parsed(sections: DataFrame, key: list[str]) -> DataFrame:
    """Filings with their sections as an array, in order; a filing that lacks an item fails the job, naming it."""
    columns = [c for c in sections.columns if c not in {"section_pos", "item_code", "item_title", "text", "char_start", "char_end", "status"}]
    message = F.concat(*[F.concat(F.col(k).cast("string"), F.lit(" ")) for k in key], F.lit("lacks Item "), F.col("item_code"))
    checked = sections.withColumn("item_code", F.when(F.assert_true(F.col("status") == "ok", message).isNull(), F.col("item_code")))
    rows = checked.groupBy(*columns).agg(F.array_sort(F.collect_list(F.struct("section_pos", "item_code", "item_title", "text", "char_start", "char_end"))).alias("sections"))
    return rows.withColumn("sections", F.transform("sections", lambda s: F.struct(*[s[c].alias(c) for c in ("item_code", "item_title", "text", "char_start", "char_end")])))


def errors(sections: DataFrame, *, columns: tuple[str, ...] = ("ticker", "fiscal_year", "accession", "strategy")) -> DataFrame:
    """What went wrong: the key columns (null where a step has none) and a message, a row for each failed one."""
    keys = [(F.col(c) if c in sections.columns else F.lit(None)).cast("string").alias(c) for c in columns]
    return sections.where("status <> 'ok'").select(*keys, F.concat(F.lit("missing Item "), F.col("item_code")).alias("message"))


# ---------------------------------------------------------------- the chunk store


def require_known(rows: DataFrame, known: DataFrame, key: list[str], what: str) -> DataFrame:
    """``rows`` with the columns of ``known`` by key; a row whose key isn't known fails the job."""
    found = known.select(*known.columns, F.lit(True).alias("_known"))
    message = F.concat(F.lit(f"unknown {what} "), F.concat_ws("/", *[F.col(k).cast("string") for k in key]))
    joined = rows.join(found, key, "left")
    first = F.when(F.assert_true(F.coalesce("_known", F.lit(False)), message).isNull(), F.col(key[0]))
    return joined.withColumn(key[0], first).drop("_known")


def with_filings(chunks: DataFrame, filings: DataFrame, *, key: str = "accession", columns: tuple[str, ...] = ("ticker", "fiscal_year", "edgar_url")) -> DataFrame:
    """Chunks with their filing's columns (one filing a chunk; chunks without one are left out)."""
    return chunks.join(filings.select(key, *columns), key)


def chunk_scan(chunks: DataFrame, filings: DataFrame, strategy: str | None = None, *, key: str = "accession", order: str = "chunk_index", columns: tuple[str, ...] = ("ticker", "fiscal_year", "edgar_url")) -> DataFrame:
    """Every chunk of a strategy with its filing's columns, embedded or not, in order of filing and chunk."""
    rows = chunks if strategy is None else chunks.where(F.col("strategy") == strategy)
    return with_filings(rows, filings, key=key, columns=columns).orderBy(key, order)


def counts(rows: DataFrame, key: list[str], **flags: Column) -> DataFrame:
    """``n`` rows by key, and of them how many each flag holds for."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(flag, F.lit(False)).cast("long")).alias(name) for name, flag in flags.items()])


def run_counters(rows: DataFrame, key: list[str], distinct: str | None = None) -> DataFrame:
    """What a run did, by status (and more keys): rows, and distinct values of a column."""
    more = [] if distinct is None else [F.count_distinct(distinct).alias("distinct")]
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *more)


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def union_pages(pages: list[DataFrame]) -> DataFrame:
    """All rows of several pages; columns that a page lacks are null."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    return out


class ChunkStore:
    """Filings, sections and chunks as Parquet tables below a folder, by strategy; vectors stay while their text does.

    Every change writes a table of a new number and then the number, so that a reader sees one state or the other; an
    older table stays until ``vacuum``.
    """

    FILINGS, SECTIONS, CHUNKS = ["accession"], ["accession", "item_code"], ["accession", "strategy", "chunk_index"]

    def __init__(self, spark: SparkSession, folder: str, *, dim: int | None = None) -> None:
        self.spark, self.folder, self.dim = spark, folder.rstrip("/"), dim

    def _numbers(self, name: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = [s.getPath() for s in files.listStatus(path)]
        done = [p for p in found if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done if p.getName().isdigit())

    def table(self, name: str) -> DataFrame | None:
        """A table's last state, or None before the first."""
        numbers = self._numbers(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/{numbers[-1]}") if numbers else None

    def _write(self, name: str, rows: DataFrame) -> None:
        numbers = self._numbers(name)
        writer = rows.write.mode("overwrite")
        writer = writer.partitionBy("strategy") if "strategy" in rows.columns else writer
        writer.parquet(f"{self.folder}/{name}/{(numbers or [0])[-1] + 1}")

    def _merged(self, name: str, new: DataFrame, key: list[str]) -> None:
        old = self.table(name)
        self._write(name, new if old is None else upsert(old, new, key, [c for c in old.columns if c not in key]))

    def upsert_filings(self, filings: DataFrame, sections: DataFrame) -> None:
        """Insert or replace filings by accession and their sections by item."""
        self._merged("filings", filings, self.FILINGS)
        self._merged("sections", sections, self.SECTIONS)

    def upsert_chunks(self, chunks: DataFrame) -> None:
        """Insert or replace chunks; a chunk of an unknown filing or section fails the job.  Nothing is deleted."""
        sections = self.table("sections")
        if sections is None:
            raise ValueError("the store has no sections")
        known = require_known(chunks, sections.select(*self.SECTIONS).distinct(), self.SECTIONS, "section").select(*chunks.columns)
        old = self.table("chunks")
        if old is None:
            self._write("chunks", known.withColumn("embedding", F.lit(None).cast("array<float>")))
        else:
            self._write("chunks", upsert_chunks(old, known, self.CHUNKS))

    def chunks(self, strategy: str | None = None) -> DataFrame:
        rows = self.table("chunks")
        if rows is None:
            raise ValueError("the store has no chunks")
        return rows if strategy is None else rows.where(F.col("strategy") == strategy)

    def unembedded(self, strategy: str | None = None) -> DataFrame:
        return unembedded(self.chunks(strategy))

    def write_embeddings(self, vectors: DataFrame) -> None:
        """Vectors by accession, strategy and chunk_index; each must have a chunk and the store's dimension."""
        keyed = lambda rows: rows.withColumn("_key", F.to_json(F.struct(*self.CHUNKS)))
        self._write("chunks", write_embeddings(keyed(self.chunks()), keyed(vectors), "_key", dim=self.dim or 0).drop("_key"))

    def clear_embeddings(self, where: Column) -> int:
        """Forget vectors; of how many chunks."""
        n = self.chunks().where(where & F.col("embedding").isNotNull()).count()
        self._write("chunks", clear_embeddings(self.chunks(), where))
        return n

    def count(self, *key: str) -> DataFrame:
        return counts(self.chunks(), list(key) or ["strategy"], embedded=F.col("embedding").isNotNull())

    def iter_chunks(self, strategy: str) -> DataFrame:
        filings = self.table("filings")
        own = [c for c in ("ticker", "fiscal_year", "edgar_url") if c in filings.columns]
        return chunk_scan(self.chunks(strategy).drop(*own), filings, columns=tuple(own))

    def search(self, queries: DataFrame, strategy: str, k: int, filters: retrieval.Filters | None = None) -> DataFrame:
        """The k nearest chunks of a strategy for ``queries`` (qid, vector): hits with rank, score and the chunk's columns."""
        if self.dim and not queries.where(F.size("vector") != self.dim).isEmpty():
            raise ValueError(f"query vectors must have {self.dim} dimensions")
        rows = self.iter_chunks(strategy).withColumn("id", F.concat_ws("#", *self.CHUNKS))
        rows = rows if filters is None else rows.where(filters.predicate())
        ranking = retrieval.dense(rows.select("id", F.col("embedding").alias("vector")), queries, k=k)
        return retrieval.hits(ranking, rows.drop("embedding"))

    def index_stats(self) -> DataFrame:
        """Chunks, embedded ones and distinct filings by strategy."""
        return self.chunks().groupBy("strategy").agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded"), F.count_distinct("accession").alias("filings"))

    def vacuum(self) -> None:
        """Delete all states but the last."""
        for name in ("filings", "sections", "chunks"):
            for n in self._numbers(name)[:-1]:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{n}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
