"""Command line: ingest, chunk, index, search, generate, eval-retrieval, eval-rag, report, serve.

    python -m tessera.cli search --docs PATH --query TEXT [--mode hybrid] [--rerank] [--k 5]

What needs a model or the network takes it by name, as ``module:function``; without one, counts of buckets stand in for
vectors and shared terms for a reranker.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, evaluation, generation, report, retrieval, runner, store
from .shipping import ship
from .sources import config, filings, tables

SCOPE = {"ticker": "ticker", "year": "fiscal_year", "item": "item_code"}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *required: str, **optional: object) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            flag = f"--{o.replace('_', '-')}"
            if isinstance(default, bool):
                c.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                c.add_argument(flag, action="append", type=default[0])
            else:
                c.add_argument(flag, default=default, type=int if isinstance(default, int) else str)
        return c

    scope = {"ticker": [str], "year": [int], "item": [str]}
    cells = {"mode": [str], "rerank_only": False, "no_rerank": False}
    command("ingest", "fetch filings and parse their items", "corpus", "data", ticker=[str], year=[int], force=False, parse_only=False)
    command("chunk", "chunk the sections of parsed filings", "parsed", "out", strategy=[str], force=False)
    command("index", "build the sparse index of a strategy's chunks", "chunks", "out", "strategy", force=False)
    command("search", "search a table of id and text", "docs", "query", mode="hybrid", rerank=False, k=retrieval.TOP_K, index=None, embedder=None, reranker=None, **scope)
    command("generate", "answer a question over a table of chunks", "docs", "query", "answerer", mode="hybrid", rerank=False, k=retrieval.TOP_K, index=None, **scope)
    command("eval-retrieval", "score searches of golden questions", "golden", "chunks", "output", strategy=[str], k=10, **cells)
    command("eval-rag", "score answers to golden questions", "golden", "chunks", "output", "answerer", judge=None, log=None, strategy=None, k=retrieval.TOP_K, **cells)
    command("report", "write the report of both stages", "log", output=None, rag_log=None, readme=None)
    command("serve", "serve searches over HTTP", "docs", "answerer", host="127.0.0.1", port=8000)
    return p


def named(path: str | None) -> Callable | None:
    """The function that ``module:function`` names."""
    if not path:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def scope_of(a: argparse.Namespace) -> retrieval.Filters | None:
    values = {column: getattr(a, name) for name, column in SCOPE.items() if getattr(a, name, None)}
    return retrieval.Filters(values) if values else None


def _get(agent: str) -> Callable[[str], tuple[int, bytes]]:
    def get(url: str) -> tuple[int, bytes]:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=30) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    return get


def ingest(spark: SparkSession, corpus: config.Corpus, data: str, get: Callable[[str], tuple[int, bytes]] | None, *, tickers: list[str] | None = None, years: list[int] | None = None, force: bool = False, turns=None) -> dict[str, int]:
    """Fetch (unless ``get`` is None), select and parse filings; counts by outcome.  What was parsed before is left alone
    unless ``force``; a filing or item that is missing is counted, and the others go on."""
    wanted, spans = corpus.tickers(tickers), corpus.years(years)
    ciks = {corpus.companies[t][0]: t for t in wanted}
    since, until = f"{min(spans)}-01-01", f"{max(spans) + 1}-12-31"
    fetcher = None if get is None else filings.Fetcher(data, get, turns=turns)
    if fetcher:
        fetcher.submissions(ciks, force=force)
    known = filings.cached_submissions(spark, f"{data}/submissions").withColumn("cik", F.lpad("cik", 10, "0")).where(F.col("cik").isin(list(ciks)))
    if fetcher:
        filings.fetch_pages(fetcher, known, since, until)
    pages = filings.wanted_pages(known, since, until)
    older = None if pages.isEmpty() else f"{data}/pages"
    chosen = store.select_filings(known, spans, corpus.form_types, filings.all_filings(spark, known, older, since, until))
    # a row for each company and year: what a corpus file lists
    rows = chosen.collect()
    found = [r for r in rows if r["accession"]]
    if fetcher:
        for r in found:
            fetcher.document(r["cik"], r["accession"], r["primary_doc"], force=force)
    names = spark.createDataFrame([(r["cik"], ciks[r["cik"]], r["name"], r["accession"], r["form"], r["filing_date"], r["report_date"], r["fiscal_year"], r["primary_doc"], filings.document_url(r["cik"], r["accession"], r["primary_doc"])) for r in found], "cik string, ticker string, company_name string, accession string, form string, filing_date string, period_of_report string, fiscal_year int, primary_doc string, edgar_url string")
    out = f"{data}/parsed"
    try:
        done = tables.read_parsed(spark, out)
        todo = names if force else tables.pending(names, done, ["accession"])
    except FileNotFoundError:
        todo = names
    html = filings.cached_pages(spark, f"{data}/raw")
    held = todo.join(html, T.accession_key(F.col("accession")) == F.col("accession_key")).drop("accession_key")
    sections = store.parse_filings(held, corpus.items).cache()
    whole = sections.groupBy("accession").agg(F.bool_and(F.col("status") == "ok").alias("_ok")).where("_ok").select("accession")
    good = sections.join(whole, "accession", "left_semi")
    columns = [c.split()[0] for c in tables.PARSED.split(", sections")[0].split(",")]
    parsed = store.parsed(good, ["accession"]).select(*columns, "sections").cache()
    n = parsed.count()
    if n:
        tables.write_parsed(parsed, out)
    errors = store.errors(sections).count()
    return {"fetched": len(found), "absent": len(rows) - len(found), "skipped": len(found) - todo.count(), "parsed": n, "errors": errors}


def hashed_vectors(rows: DataFrame) -> DataFrame:
    """``rows`` (sentence) with a vector: counts of its tokens' buckets."""
    held = T.let(retrieval.buckets(F.col("sentence")), lambda b: F.transform(F.sequence(F.lit(0), F.lit(retrieval.DIM - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))
    return rows.withColumn("vector", held)


def chunked(sections: DataFrame, strategy: str, settings: config.Chunking | None = None) -> DataFrame:
    """The chunks of sections (accession, section_pos, ..., text) by one strategy, numbered within their filing."""
    s = settings or config.Chunking()
    size = {"cap": s.max_tokens, "size": s.size, "overlap": s.overlap}
    rows = sections.drop("char_start", "char_end")
    if strategy == "fixed":
        spans = chunking.fixed(rows, **size)
    elif strategy == "structural":
        spans = chunking.structural(rows, **size, most=s.max_header_chars)
    else:
        keyed = rows.withColumn("_key", F.concat_ws("#", "accession", "section_pos"))
        spans = chunking.semantic(keyed, "_key", hashed_vectors, percentile=s.breakpoint_percentile, **size).drop("_key")
    spans = spans.withColumn("strategy", F.lit(strategy))
    numbered = chunking.number(spans, ["accession"], ["section_pos", "char_start"])
    return numbered.select(*[F.col("chunk").alias("text") if c == "text" else c for c in tables.CHUNK_COLUMNS])


def chunk(spark: SparkSession, parsed: str, out: str, strategies: list[str] | None, force: bool) -> int:
    """Chunk what wasn't chunked before; the number of sections done."""
    sections = tables.sections(tables.read_parsed(spark, parsed))
    done = 0
    for name in config.resolve(strategies, config.STRATEGIES, "strategies"):
        todo = sections
        if not force:
            try:
                todo = tables.pending(sections, tables.read_chunks(spark, out, name), ["accession"])
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        done += todo.count()
        tables.write_chunks(chunked(todo, name), out)
    return done


def chunk_table(spark: SparkSession, folder: str, strategy: str) -> DataFrame:
    """A strategy's chunks with an id."""
    return tables.read_chunks(spark, folder, strategy).withColumn("id", F.concat_ws("#", "accession", F.lpad(F.col("chunk_index").cast("string"), 6, "0")))


def _asked(spark: SparkSession, query: str) -> DataFrame:
    if not query.strip():
        raise ValueError("query must be non-empty")
    return spark.createDataFrame([(0, query)], "qid long, text string")


def _search(spark: SparkSession, a: argparse.Namespace, docs: DataFrame, asked: DataFrame) -> DataFrame:
    sparse = retrieval.load_index(spark, a.index) if a.index else None
    return retrieval.search(docs, asked, mode=a.mode, rerank=a.rerank, k=a.k, filters=scope_of(a), sparse=sparse, embed=named(getattr(a, "embedder", None)), score=named(getattr(a, "reranker", None)))


def grid_of(a: argparse.Namespace, strategies: list[str]) -> runner.Grid:
    if a.rerank_only and a.no_rerank:
        raise ValueError("rerank-only and no-rerank exclude each other")
    rerank = (True,) if a.rerank_only else (False,) if a.no_rerank else (False, True)
    return runner.Grid(tuple(strategies), tuple(config.resolve(a.mode, retrieval.MODES, "modes")), rerank)


def _golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    questions = config.load_golden(path)
    if not questions:
        raise ValueError("the golden set is empty")
    frame = config.question_frame(spark, questions)
    gold = config.citations(spark, questions).join(frame.select("qid", "question_id"), "question_id").select("qid", "accession", "item_code")
    return frame, gold


def eval_retrieval(spark: SparkSession, a: argparse.Namespace) -> str:
    """Write the first stage's log and say how the cells did."""
    questions, gold = _golden(spark, a.golden)
    names = config.resolve(a.strategy, config.STRATEGIES, "strategies")
    chunks = {s: chunk_table(spark, a.chunks, s) for s in names}
    rows = runner.evaluate(chunks, questions, gold, grid_of(a, names), k=a.k).drop("answerable")
    log = rows.join(questions.select("qid", "question_id", "type", F.col("text").alias("query"), "answerable"), "qid")
    listed = gold.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("accession", "item_code"))).alias("gold_sections"))
    tables.write_log(log.join(listed, "qid", "left").drop("qid", "position"), a.output)
    cells = evaluation.report(tables.read_log(spark, a.output)).orderBy(*evaluation.CELL)
    return report.text_table([r.asDict() for r in cells.collect()], ["strategy", "mode", "rerank", "recall_at_1", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10", "p50_ms", "p95_ms"])


def eval_rag(spark: SparkSession, a: argparse.Namespace) -> str:
    """Write the second stage's log, of the strategy asked for or of the first stage's winner, and say how the cells did."""
    questions, _ = _golden(spark, a.golden)
    if not a.strategy and not a.log:
        raise ValueError("a strategy or the log of the first stage is needed")
    name = a.strategy or runner.pick_strategy(tables.read_log(spark, a.log))
    docs = chunk_table(spark, a.chunks, *config.resolve([name], config.STRATEGIES, "strategies"))
    grid = grid_of(a, [name])
    ranked = runner.rankings({name: docs}, questions, grid, runner.scratch(spark, "answers"), k=a.k)
    rows = runner.evaluate_answers(ranked, docs, questions, named(a.answerer), named(a.judge), grid, k=a.k)
    log = rows.join(questions.select("qid", "question_id", "type"), "qid").drop("qid", "contexts", "reference")
    tables.write_log(log, a.output)
    cells = evaluation.rag_report(tables.read_log(spark, a.output, tables.RAG_LOG)).orderBy(*evaluation.CELL)
    return report.text_table([r.asDict() for r in cells.collect()], ["strategy", "mode", "rerank", *evaluation.JUDGED, "refusal_rate", "p50_ms", "p95_ms", "usd"])


def write_report(spark: SparkSession, log: str, rag_log: str | None, output: str | None, readme: str | None) -> str:
    rows = tables.read_log(spark, log)
    place = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(i)) for i, s in enumerate(config.STRATEGIES)])
    placed = rows.withColumn("position", place)
    answers = evaluation.rag_report(tables.read_log(spark, rag_log, tables.RAG_LOG)) if rag_log else None
    body = report.render(evaluation.winner(placed), evaluation.report(rows), answers, evaluation.leads(placed))
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(body)
    if readme:
        report.inject(readme, body)
    return body


def asker(spark: SparkSession, docs: DataFrame, stream: Callable[[str, str], object]) -> Callable[[dict], object]:
    """What the HTTP application calls: a request's search, its prompt, and the events of ``stream`` (system, user)."""

    def ask(request: dict):
        asked = _asked(spark, request["query"])
        own = docs.where(F.col("strategy") == request["strategy"]) if "strategy" in docs.columns else docs
        scope = retrieval.Filters(request["filters"]) if request["filters"] else None
        ranking = retrieval.search(own, asked, mode=request["mode"], rerank=request["rerank"], k=request["k"] or retrieval.TOP_K, filters=scope)
        hits = retrieval.hits(ranking, own).cache()
        prompt = generation.prompts(asked, hits).first()
        return generation.answer_events(hits, stream(prompt["system"], prompt["user"]))

    return ask


def serve(spark: SparkSession, a: argparse.Namespace) -> None:
    from wsgiref.simple_server import make_server

    from .api import application

    docs = spark.read.parquet(a.docs)
    make_server(a.host, a.port, application(asker(spark, docs, named(a.answerer)), lambda: docs.limit(1).count())).serve_forever()


def run(spark: SparkSession, a: argparse.Namespace) -> str:
    if a.command == "ingest":
        corpus = config.load_corpus(a.corpus)
        get = None if a.parse_only else _get(config.Settings.load().require("user_agent"))
        return " ".join(f"{k}={v}" for k, v in ingest(spark, corpus, a.data, get, tickers=a.ticker, years=a.year, force=a.force).items())
    if a.command == "chunk":
        return f"sections={chunk(spark, a.parsed, a.out, a.strategy, a.force)}"
    if a.command == "index":
        docs = chunk_table(spark, a.chunks, *config.resolve([a.strategy], config.STRATEGIES, "strategies"))
        index = retrieval.load_or_build(docs, a.out, force=a.force, payload=[c for c in tables.CHUNK_COLUMNS if c != "text"])
        return f"chunks={index.read('rows').count()} k1={index.k1} b={index.b}"
    if a.command in ("search", "generate"):
        docs, asked = spark.read.parquet(a.docs), _asked(spark, a.query)
        ranking = _search(spark, a, docs, asked)
        if a.command == "search":
            shown = ranking.join(docs.select("id", T.snippet(F.col("text")).alias("snippet")), "id").orderBy("rank").collect()
            return "\n".join(f"{r['rank']:>3}  {r['score']:.4f}  {r['id']}  {r['snippet']}" for r in shown)
        hits = retrieval.hits(ranking, docs)
        row = generation.answers(generation.prompts(asked, hits), named(a.answerer)).first()
        if row["error"]:
            raise ValueError(row["error"])
        cited = "\n".join(json.dumps(r.asDict()) for r in generation.citations(hits).collect())
        return f"{row['response']}\n\n{cited}\n\ntokens={row['prompt_tokens']}+{row['completion_tokens']} usd={row['usd']:.6f} ms={row['generate_ms']:.0f}"
    if a.command == "eval-retrieval":
        return eval_retrieval(spark, a)
    if a.command == "eval-rag":
        return eval_rag(spark, a)
    if a.command == "report":
        return write_report(spark, a.log, a.rag_log, a.output, a.readme)
    serve(spark, a)
    return ""


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = ship(SparkSession.builder.appName("tessera").getOrCreate())
    try:
        print(run(spark, a))
    except (ValueError, KeyError, FileNotFoundError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
