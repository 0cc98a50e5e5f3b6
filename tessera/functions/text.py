"""Column functions over text: tokens, headers, sentences, HTML cleaning, labels.  All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a title may hold in lower case.
SMALL_WORDS = ["a", "an", "and", "at", "by", "for", "in", "of", "on", "or", "the", "to", "vs", "with"]

# The English stop words of the sparse index.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of",
    "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]

# Limits of the retrieval model.
SNIPPET_LIMIT = 96
MAX_HEADER_CHARS = 120
REFUSAL_PHRASE = "Not in the corpus."
PRICE_IN_PER_MILLION = 0.20
PRICE_OUT_PER_MILLION = 1.20
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

# The titles of the items that are parsed.
ITEM_TITLES = {
    "1A": "Risk Factors",
    "7": "Management's Discussion and Analysis of Financial Condition and Results of Operations",
    "7A": "Quantitative and Qualitative Disclosures About Market Risk",
}

#: The stages whose times add up to a search's; an answer's is served after its generation too.
STAGES_MS = ("encode_ms", "dense_ms", "sparse_ms", "fuse_ms", "rerank_ms")

#: ASCII punctuation, as Python's string.punctuation.
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def pieces(text: Column) -> Column:
    """White-space tokens, each with the white space after it; only leading space is left out."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+\s*"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def leading_space(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"(?U)^\s*", 0))


def clip(text: Column, start: Column, end: Column, most: int, *, offset: Column | int = 0) -> Column:
    """The stretch from ``start`` to ``end``, cut to ``most`` tokens: a struct of text, char_start, char_end and token_count, whose
    offsets count from ``offset``."""
    piece = F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
    held = F.when(token_count(piece) > most, truncate_tokens(piece, most)).otherwise(piece)
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.struct(held.alias("text"), (at + start).cast("int").alias("char_start"), (at + start + F.length(held)).cast("int").alias("char_end"), token_count(held).alias("token_count"))


def truncate_tokens(text: Column, most: int) -> Column:
    """The prefix that ends with token number ``most``; empty for none."""
    if most <= 0:
        return F.lit("")
    lead = F.regexp_extract(text, r"(?U)^\s*", 0)
    cut = F.concat(lead, F.regexp_replace(F.array_join(F.slice(pieces(text), 1, most), ""), r"(?U)\s+$", ""))
    return F.when(F.size(pieces(text)) == 0, F.lit("")).otherwise(cut)


def search_tokens(text: Column) -> Column:
    """Lower-case word runs of two characters or more without stop words: both sides of the sparse index."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(runs, lambda w: ~w.isin(STOP_WORDS))


def is_table_row(line: Column) -> Column:
    return line.contains(" | ") | (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2)


def is_all_caps(line: Column) -> Column:
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & letters.rlike(r"^\p{Lu}+$")


def is_titled(word: Column) -> Column:
    bare = F.btrim(word, F.lit(".,:;()[]\"'"))
    return (bare == "") | F.lower(bare).isin(SMALL_WORDS) | bare.rlike(r"^[\p{Nd}\p{Lu}]")


def is_title_case(line: Column) -> Column:
    return (line != "") & F.forall(F.split(line, r"(?U)\s+"), is_titled) & line.rlike(r"\p{Lu}")


def looks_like_header(line: Column, most: int = MAX_HEADER_CHARS) -> Column:
    """A short line, no table row, in capitals or title case."""
    bare = strip(line)
    return (bare != "") & (F.length(bare) <= most) & ~is_table_row(bare) & (is_all_caps(bare) | is_title_case(bare))


def sentences(text: Column) -> Column:
    """Pieces between the white space that follows . ! ? and precedes a capital, quote or parenthesis; no blank ones."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z(\"'])"), lambda s: strip(s) != "")


def snippet(text: Column, limit: int = SNIPPET_LIMIT) -> Column:
    flat = collapse_space(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def normalized(text: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces: what refusals are compared in."""
    return collapse_space(F.translate(F.lower(text), PUNCTUATION, ""))


def is_refusal(text: Column, phrase: str = REFUSAL_PHRASE) -> Column:
    """The phrase occurs, whatever its case and punctuation; a phrase without letters never does."""
    needle = normalized(F.lit(phrase))
    return (needle != "") & normalized(F.coalesce(text, F.lit(""))).contains(needle)


def strip_hidden(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<ix:hidden\b[^>]*>.*?</ix:hidden>", "")


def unwrap_inline(html: Column) -> Column:
    return F.regexp_replace(html, r"(?i)</?ix:[a-z0-9_.-]+\b[^>]*>", "")


def drop_after_exhibit(html: Column) -> Column:
    """Everything before the first element whose id or name begins with EX and a digit."""
    anchor = r"""(?is)<[a-z][^<>]*\s(id|name)\s*=\s*["']?EX-?\d"""
    at = F.regexp_instr(html, F.lit(anchor))
    return F.when(at > 0, F.substring(html, F.lit(1), at - 1)).otherwise(html)


def flatten_tables(html: Column) -> Column:
    """Each table as its rows on lines, a row's cells joined by " | ".  Blank cells, rows and tables go."""
    bare = lambda cell: collapse_space(F.regexp_replace(F.regexp_replace(F.regexp_replace(cell, r"(?s)<[^>]*>", " "), "&nbsp;|&#160;", " "), "\x02", " "))
    cells = lambda row: F.filter(F.transform(F.slice(F.split(row, r"(?i)<t[dh]\b[^>]*>"), 2, 1 << 30), bare), lambda c: c != "")
    rows = lambda body: F.filter(F.transform(F.split(body, r"(?i)<tr\b[^>]*>"), lambda r: F.array_join(cells(r), " | ")), lambda r: r != "")

    def part(piece: Column) -> Column:
        ends = F.regexp_instr(piece, F.lit(r"(?i)</table\s*>"))
        inside = F.when(ends > 0, F.substring(piece, F.lit(1), ends - 1)).otherwise(piece)
        after = F.when(ends > 0, F.regexp_replace(F.substring(piece, ends, F.length(piece)), r"(?i)^</table\s*>", "")).otherwise(F.lit(""))
        lines = F.array_join(rows(inside), "\n")
        return F.concat(F.when(lines == "", F.lit("")).otherwise(F.concat(F.lit("<p>"), lines, F.lit("</p>"))), after)

    cut = F.split(F.regexp_replace(html, r"(?i)<table\b", "\x02<table"), "\x02")
    return F.concat(F.get(cut, F.lit(0)), F.array_join(F.transform(F.slice(cut, 2, 1 << 30), part), ""))


# Entities that pages use; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = {
    "&nbsp;": "\u00a0", "&#160;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'",
    "&lsquo;": "\u2018", "&#8216;": "\u2018", "&rsquo;": "\u2019", "&#8217;": "\u2019", "&ldquo;": "\u201c", "&#8220;": "\u201c", "&rdquo;": "\u201d", "&#8221;": "\u201d",
    "&ndash;": "\u2013", "&#8211;": "\u2013", "&mdash;": "\u2014", "&#8212;": "\u2014", "&bull;": "\u2022", "&#8226;": "\u2022", "&sect;": "\u00a7", "&#167;": "\u00a7", "&amp;": "&", "&#38;": "&",
}


def clean_html(html: Column) -> Column:
    """Text of a page: hidden blocks, inline tags, scripts, styles, comments and exhibits gone, tables flattened, entities
    decoded.  Texts between tags are trimmed, blank ones go, the others stand on lines of their own; blanks are collapsed."""
    text = unwrap_inline(strip_hidden(html))
    text = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "\x03")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "\x03")
    text = flatten_tables(drop_after_exhibit(text))
    text = F.regexp_replace(text, r"(?s)<[^>]+>", "\x03")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, "[\\s\u00a0]*\x03[\\s\u00a0\x03]*", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.btrim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit(" \t\n\r\f\u00a0"))


def accession_key(accession: Column) -> Column:
    return F.replace(F.trim(accession), F.lit("-"), F.lit(""))


def pad_cik(cik: Column) -> Column:
    bare = F.trim(cik.cast("string"))
    return F.when(F.length(bare) >= 10, bare).otherwise(F.lpad(bare, 10, "0"))


def unpad_cik(cik: Column) -> Column:
    return F.trim(cik.cast("string")).cast("long").cast("string")


def fiscal_year(period: Column) -> Column:
    """The year of the period reported on, from an ISO date; null for what isn't one."""
    return F.year(F.try_to_date(period)) if hasattr(F, "try_to_date") else F.year(F.to_date(period))


def cost_usd(prompt: Column, completion: Column, per_in: float = PRICE_IN_PER_MILLION, per_out: float = PRICE_OUT_PER_MILLION) -> Column:
    return (prompt * per_in + completion * per_out) / 1_000_000


def usage_count(*values: Column) -> Column:
    """The first count that is a number, at least 0."""
    return F.greatest(F.coalesce(*[v.try_cast("long") for v in values], F.lit(0)), F.lit(0))


def citation_tag(ticker: Column, year: Column, item: Column) -> Column:
    return F.format_string("[%s FY%d Item %s]", ticker, year, item)


def config_label(strategy: Column, mode: Column, rerank: Column) -> Column:
    return F.concat_ws("/", strategy, mode, F.when(rerank, "on").otherwise("off"))


def format_bytes(size: Column) -> Column:
    return (
        F.when(size < 1024, F.format_string("%d B", size.cast("long")))
        .when(size < 1024 * 1024, F.format_string("%.1f KiB", F.bround(size / 1024.0, 1)))
        .otherwise(F.format_string("%.1f MiB", F.bround(size / (1024.0 * 1024.0), 1)))
    )


def query_text(query: Column, prefix: str = QUERY_PREFIX) -> Column:
    """What of a query is embedded: the prefix and the query.  Passages and rerankers see no prefix."""
    return F.concat(F.lit(prefix), strip(query))


def total_ms(*stages: Column) -> Column:
    """The sum of a search's stages; one that wasn't measured took no time."""
    parts = stages or tuple(F.col(c) for c in STAGES_MS)
    return sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))


def serving_ms(total: Column, generate: Column) -> Column:
    return F.coalesce(total, F.lit(0.0)) + F.coalesce(generate, F.lit(0.0))


SECTION = "array<struct<accession: string, item_code: string>>"


def encode_sections(sections: Column) -> Column:
    return F.to_json(sections)


def decode_sections(text: Column) -> Column:
    """A JSON list of sections; entries that lack either name, and what is no list, are dropped."""
    found = F.coalesce(F.from_json(text, SECTION), F.array().cast(SECTION))
    return F.filter(found, lambda s: s.isNotNull() & s["accession"].isNotNull() & s["item_code"].isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements whose sum is made in advance, and how many times over.
FAN, DEPTH = 64, 4
_add = lambda a, x: a + x


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), _add)


def running(lengths: Column) -> Column:
    """What ``sum_upto`` needs of an array of lengths: itself, sums over blocks of 64, of 64 * 64 and of 64 ** 3."""
    blocks = lambda level: F.transform(F.sequence(F.lit(0), F.floor(F.size(level) / FAN).cast("int")), lambda b: _total(F.slice(level, b * FAN + 1, F.lit(FAN))))
    first = F.transform(lengths, lambda x: x.cast("long"))
    return let(first, lambda l0: let(blocks(l0), lambda l1: let(blocks(l1), lambda l2: F.array(l0, l1, l2, blocks(l2)))))


def sum_upto(run: Column, i: Column) -> Column:
    """The sum of the first i lengths: some of each level are added up, so that spans of a long text take time in
    proportion to its length, within a row."""
    out = F.lit(0).cast("long")
    for depth in range(DEPTH):
        here = F.floor(i / FAN**depth).cast("int")
        first = (F.floor(here / FAN) * FAN).cast("int") if depth < DEPTH - 1 else F.lit(0)
        out = out + _total(F.slice(F.get(run, F.lit(depth)), first + 1, here - first))
    return out
