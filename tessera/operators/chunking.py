"""Chunking: spans of a text by token windows, headers or meaning, under a cap.

Spans are computed within a row, by array functions: no shuffle, whatever the corpus' size.  They carry character
offsets (code points) into the text of their row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

SIZE, OVERLAP, CAP = 400, 80, 512
PERCENTILE = 95

def _spans(docs: DataFrame, text: str, *, cap: int | None, size: int, overlap: int, offset: Column | None = None) -> DataFrame:
    """``docs`` with a row for each span of a text: see windows() and capped().

    The tokens are a column of their own, so that they are found once, not once for each window.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("window size must be positive and overlap within it")
    if cap is not None and size > cap:
        raise ValueError("window size must not exceed the cap")
    step, body = size - overlap, F.coalesce(F.col(text), F.lit(""))
    base = F.lit(0) if offset is None else offset
    held = docs.withColumn("_pieces", T.pieces(body)).withColumn("_lead", F.regexp_extract(body, r"(?U)^\s*", 0)).withColumn("_base", base).withColumn("_end", F.length(body))
    base = F.col("_base")

    def spans(parts: Column, n: Column, run: Column) -> Column:
        whole = n <= (size if cap is None else cap)

        def one(i: Column) -> Column:
            first = i * step
            last = F.when(whole, n).otherwise(F.least(first + size, n))
            chunk = F.concat(F.when(i == 0, F.col("_lead")).otherwise(F.lit("")), F.array_join(F.slice(parts, first + 1, last - first), ""))
            chunk = F.when(last == n, chunk).otherwise(F.regexp_replace(chunk, r"(?U)\s+$", ""))
            start = F.when(i == 0, F.lit(0)).otherwise(F.length("_lead") + T.sum_upto(run, first))
            return T.let(chunk, lambda c: F.struct((base + start).cast("int").alias("char_start"), (base + F.when(last == n, F.col("_end")).otherwise(start + F.length(c))).cast("int").alias("char_end"), (last - first).cast("int").alias("token_count"), c.alias("chunk")))

        return F.transform(F.sequence(F.lit(0), F.when(whole, 0).otherwise(F.ceil((n - size) / step)).cast("int")), one)

    # the pieces' lengths are added up once; a window looks its offset up
    found = T.let(F.col("_pieces"), lambda parts: T.let(T.running(F.transform(parts, F.length)), lambda run: spans(parts, F.size(parts), run)))
    out = held.where(F.size("_pieces") > 0).select("*", F.posexplode(found).alias("local_index", "_s"))
    return out.select(*docs.columns, "local_index", "_s.char_start", "_s.char_end", "_s.token_count", "_s.chunk")


def windows(docs: DataFrame, text: str = "text", *, size: int = SIZE, overlap: int = OVERLAP, offset: Column | None = None) -> DataFrame:
    """Token windows: all of a text if it has ``size`` tokens or fewer; none if it has no token.

    The first begins where the text does and the last ends where it does; the next begins ``size - overlap`` tokens on.
    ``docs`` gets local_index, char_start, char_end, token_count and chunk; offsets count from ``offset``.
    """
    return _spans(docs, text, cap=None, size=size, overlap=overlap, offset=offset)


def capped(docs: DataFrame, text: str = "text", *, cap: int = CAP, size: int = SIZE, overlap: int = OVERLAP, offset: Column | None = None) -> DataFrame:
    """One span if a text has ``cap`` tokens or fewer, else its windows; none if it is blank."""
    return _spans(docs, text, cap=cap, size=size, overlap=overlap, offset=offset)


def header_marks(docs: DataFrame, text: str = "text", *, most: int = T.MAX_HEADER_CHARS) -> DataFrame:
    """``docs`` with _heads: for each line its offset, whether it looks like a header, and whether it is kept as one:
    longer prose follows it before any other prose."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line: F.struct(F.length(line).alias("n"), F.length(T.strip(line)).alias("bare"), T.looks_like_header(line, most).alias("head")))
    prose = lambda x: (x["bare"] > 0) & ~x["head"]

    def marks(found: Column, bodies: Column, offsets: Column, seen: Column) -> Column:
        def mark(i: Column) -> Column:
            here = F.get(found, i)
            # a header's prose is the one whose number is the count of those before it
            after = lambda: F.get(bodies, T.sum_upto(seen, i).cast("int"))
            longer = F.when(here["head"], F.coalesce(after() > here["bare"], F.lit(False))).otherwise(F.lit(False))
            return F.struct(T.sum_upto(offsets, i).cast("int").alias("offset"), here["head"].alias("head"), longer.alias("kept"))

        return F.transform(F.sequence(F.lit(0), F.size(found) - 1), mark)

    heads = T.let(
        lines,
        lambda found: T.let(
            F.transform(F.filter(found, prose), lambda x: x["bare"]),
            lambda bodies: T.let(
                T.running(F.transform(found, lambda x: x["n"] + 1)),
                lambda offsets: T.let(T.running(F.transform(found, lambda x: prose(x).cast("int"))), lambda seen: marks(found, bodies, offsets, seen)),
            ),
        ),
    )
    return docs.withColumn("_heads", heads)


def structural_spans(docs: DataFrame, text: str = "text", *, most: int = T.MAX_HEADER_CHARS) -> DataFrame:
    """``docs`` with a row for each stretch from a kept header, or from the text's beginning, to the next: char_start and
    char_end; what stands before the first header counts if it isn't blank; none for a blank text."""
    starts = F.transform(F.filter("_heads", lambda h: h["kept"]), lambda h: h["offset"])
    held = header_marks(docs, text, most=most).withColumn("_starts", starts).drop("_heads")
    first = F.coalesce(F.get("_starts", F.lit(0)), F.lit(0))
    leads = (F.size("_starts") == 0) | ((first > 0) & (T.strip(F.substring(F.col(text), F.lit(1), first)) != ""))
    held = held.withColumn("_starts", F.when(leads, F.concat(F.array(F.lit(0)), F.col("_starts"))).otherwise(F.col("_starts")))
    ends = F.concat(F.slice("_starts", F.lit(2), F.greatest(F.size("_starts") - 1, F.lit(0))), F.array(F.length(text)))
    spans = F.zip_with("_starts", ends, lambda a, b: F.struct(a.alias("char_start"), b.alias("char_end")))
    out = held.where(T.strip(F.coalesce(F.col(text), F.lit(""))) != "").select("*", F.explode(spans).alias("_s"))
    return out.select(*docs.columns, "_s.char_start", "_s.char_end")


def number(chunks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """chunk_index: sequential across the sections of a filing, from 0."""
    return chunks.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("int"))


def fixed(docs: DataFrame, text: str = "text", *, cap: int = CAP, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with a row for each token window.  One of more than ``cap`` tokens (if the size is above the cap) keeps its first
    ``cap``, and ends where they do."""
    spans = windows(docs, text, size=size, overlap=overlap)
    if size <= cap:
        return spans
    kept = F.when(F.col("token_count") > cap, T.truncate_tokens(F.col("chunk"), cap)).otherwise(F.col("chunk"))
    spans = spans.withColumn("chunk", kept).withColumn("char_end", F.col("char_start") + F.length("chunk"))
    return spans.withColumn("token_count", F.least("token_count", F.lit(cap)))


def structural(docs: DataFrame, text: str = "text", *, cap: int = CAP, size: int = SIZE, overlap: int = OVERLAP, most: int = T.MAX_HEADER_CHARS) -> DataFrame:
    """``docs`` with a row for each capped header span."""
    return _capped_parts(docs, structural_spans(docs, text, most=most), text, cap, size, overlap)


def _capped_parts(docs: DataFrame, parts: DataFrame, text: str, cap: int, size: int, overlap: int) -> DataFrame:
    held = parts.select(*docs.columns, F.col("char_start").alias("_from"), F.substring(F.col(text), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("_body"))
    spans = capped(held, "_body", cap=cap, size=size, overlap=overlap, offset=F.col("_from"))
    return spans.drop("_from", "_body")


def sentence_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a row for each sentence: sentence_index, char_start, char_end; cut at the white space that follows
    . ! ? and precedes a capital, quote or parenthesis; blank pieces are dropped."""
    boundary = r"(?<=[.!?])(\s+)(?=[A-Z(\"'])"
    # a piece is its sentence, a mark and the space after it
    cut = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), boundary, "\x01$1\x02"), "\x02")
    piece = lambda p: F.struct(F.length(F.substring_index(p, "\x01", 1)).alias("n"), F.length(F.replace(p, F.lit("\x01"), F.lit(""))).alias("all"), (T.strip(p) != "").alias("some"))
    placed = lambda found, run: F.filter(F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.struct(T.sum_upto(run, i).cast("int").alias("at"), F.get(found, i)["n"].alias("n"), F.get(found, i)["some"].alias("some"))), lambda p: p["some"])
    places = T.let(F.transform(cut, piece), lambda found: T.let(T.running(F.transform(found, lambda p: p["all"])), lambda run: placed(found, run)))
    held = docs.withColumn("_places", places)
    out = held.select("*", F.posexplode("_places").alias("sentence_index", "_s"))
    return out.select(*docs.columns, "sentence_index", F.col("_s.at").alias("char_start"), (F.col("_s.at") + F.col("_s.n")).alias("char_end"))


def change_points(rows: DataFrame, key: list[str], order: list[str], vector: str, *, percentile: float = PERCENTILE) -> DataFrame:
    """``rows`` with distance (cosine, to the row before) and group: a new one where the distance is strictly above the
    percentile of its key's distances."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(vector).over(w)
    with_distance = rows.withColumn("distance", F.when(before.isNotNull(), 1.0 - V.cosine(F.col(vector), before)))
    limits = with_distance.groupBy(*key).agg(F.percentile("distance", F.lit(percentile / 100.0)).alias("_limit"))
    marked = with_distance.join(limits, key)
    opens = F.sum(F.when(F.col("distance") > F.col("_limit"), 1).otherwise(0)).over(w)
    return marked.withColumn("group", opens.cast("int")).drop("_limit")


def semantic(docs: DataFrame, key: str, embed: Callable[[DataFrame], DataFrame], text: str = "text", *, percentile: float = PERCENTILE, cap: int = CAP, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with a row for each capped group of sentences between change points.

    ``embed`` adds a column ``vector`` to sentences (``key``, sentence_index, sentence).
    """
    cut = sentence_spans(docs.select(key, F.col(text).alias("_t")), "_t")
    cut = cut.withColumn("sentence", T.strip(F.substring("_t", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))).drop("_t")
    grouped = change_points(embed(cut), [key], ["sentence_index"], "vector", percentile=percentile)
    parts = grouped.groupBy(key, "group").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    return _capped_parts(docs, docs.join(parts.drop("group"), key), text, cap, size, overlap)
