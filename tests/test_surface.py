"""Command line, HTTP and report."""

import io
import itertools
import json

import pytest

from tessera import api, cli
from tessera.operators import report
from tessera.operators.generation import Event
from tessera.sources import config, tables


def call(app, method, path, body=b""):
    seen = {}
    out = b"".join(app({"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}, lambda s, h: seen.update(status=s, headers=dict(h))))
    return seen["status"][:3], out


def test_api():
    app = api.application(lambda r: iter([Event("citations", {"q": r["query"]}), Event("done", {})]))
    assert call(app, "GET", "/healthz")[0] == "200" and call(app, "GET", "/nothing")[0] == "404"
    assert json.loads(call(app, "GET", "/configs")[1])["modes"] == ["dense", "sparse", "hybrid"]
    assert call(app, "POST", "/query", b'{"query": " x ", "tickers": []}') == ("200", b'event: citations\ndata: {"q": "x"}\n\nevent: done\ndata: {}\n\n')
    for bad in (b"", b"{", b'{"query": "x", "mode": "no"}', b'{"query": "x", "k": 0}'):
        assert call(app, "POST", "/query", bad)[0] == "400"

    def broken(_):
        raise RuntimeError("away")
        yield

    assert call(api.application(broken), "POST", "/query", b'{"query": "x"}')[0] == "503"

    def breaks(_):
        yield Event("citations", {})
        raise RuntimeError("late")

    assert b"event: error" in call(api.application(breaks), "POST", "/query", b'{"query": "x"}')[1]


def test_cli(spark, tmp_path, capsys):
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(1, "market risk", "A"), (2, "plain words", "B")], "id int, text string, ticker string").write.parquet(docs)
    assert cli.main(["search", "--docs", docs, "--query", "market", "--mode", "sparse", "--k", "1"]) == 0
    assert "market risk" in capsys.readouterr().out
    assert cli.main(["search", "--docs", docs, "--query", " "]) == 1 and cli.main(["search", "--docs", docs, "--query", "x", "--mode", "no"]) == 1


def test_cli_chunk(spark, tmp_path):
    filing = {"ticker": "T", "cik": "1", "accession": "a-1", "fiscal_year": 2024, "sections": [{"item_code": "1A", "item_title": "t", "text": "one two three", "char_start": 0, "char_end": 13}, {"item_code": "7", "item_title": "t", "text": "four", "char_start": 13, "char_end": 17}]}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps(filing))
    out = str(tmp_path / "c")
    assert cli.chunk(spark, str(tmp_path / "p"), out, ["fixed"], False) == 2
    assert cli.chunk(spark, str(tmp_path / "p"), out, ["fixed"], False) == 0
    assert [(r["chunk_index"], r["text"]) for r in tables.read_chunks(spark, out, "fixed").orderBy("chunk_index").collect()] == [(0, "one two three"), (1, "four")]


def test_report(spark, tmp_path):
    cells = [("fixed", m, r, 0.5 + 0.1 * r + 0.01 * len(m), 0.4, 0.3, 10.0, 20.0) for m in ("dense", "sparse", "hybrid") for r in (False, True)]
    retrieval = spark.createDataFrame(cells, "strategy string, mode string, rerank boolean, recall_at_5 double, mrr double, ndcg_at_10 double, p50_ms double, p95_ms double")
    winner = spark.createDataFrame([("fixed", 0.6, 0.039)], "strategy string, recall_at_5 double, lead double")
    text = report.render(winner, retrieval)
    assert "Best chunking: fixed, recall@5 0.600, +0.039 to the next." in text and "| fixed | dense+rerank |" in text and "reranking dense: +0.100" in text
    assert "Best search: sparse+rerank, recall@5 0.660" in text or "Best search: hybrid+rerank, recall@5 0.660" in text
    path = tmp_path / "R.md"
    path.write_text(f"a\n{report.START}\nold\n{report.END}\nb")
    report.inject(path, text)
    assert "old" not in path.read_text() and path.read_text().endswith("\nb")
    path.write_text("no markers")
    with pytest.raises(ValueError):
        report.inject(path, text)
    with pytest.raises(ValueError):
        report.render(winner.where("false"), retrieval)


def test_report_clauses():
    cells = {("dense", False): 0.5, ("dense", True): 0.7, ("hybrid", False): 0.6, ("hybrid", True): 0.65}
    assert [n for n, _, _ in report.steps(cells)] == ["reranking dense", "fusing", "reranking the fusion"]
    assert "twice as much" in report.fusion_verdict(report.steps(cells)) and report.fusion_verdict([]) == ""
    assert report.steps({**cells, ("hybrid", True): None}) == []
    assert report.median_clause(100, 260).startswith("nearly triples") and report.median_clause(100, 240).startswith("raises")
    assert "weak spot" in report.precision_clause([0.3, 0.4]) and "ranges" in report.precision_clause([0.3, 0.41])
    assert "flat" in report.cost_clause([1.0, 1.05]) and "ranges" in report.cost_clause([1.0, 1.2])
    assert report.refusal_clause([1.0, 1.0], 1) == "Refusals are 1.000 on all 1 unanswerable question."
    assert report.text_table([{"a": 0.5, "b": None}], ["a", "b"]) == "a      b\n0.500  n/a"


PAGE = "<p>Item 1A. Risk Factors</p><p>{} currency risk is high. Rates move. Weather too.</p><p>Item 7. Analysis</p><p>{} revenue grew in cloud.</p><p>Item 7A. Market Risk</p><p>{} hedges rates.</p>"


def answer(system, user):
    return ("Not in the corpus." if "moon" in user else "Fine [A FY2023 Item 1A]."), 10, 5


def judge(query, response, contexts, reference):
    return 0.9, 0.4, 0.5, 0.6


def test_the_whole_way(spark, tmp_path, capsys):
    """Ingest, chunk by all strategies, index, search, generate, both stages of the evaluation and the report."""
    (tmp_path / "corpus.yaml").write_text("form_types: [10-K]\nfiscal_years: [2023]\nitems: [1A, 7, 7A]\ncompanies:\n- {ticker: A, cik: 1}\n- {ticker: B, cik: 2}\n- {ticker: C, cik: 3}\n")
    raw = lambda cik, n: json.dumps({"cik": str(cik), "name": "N", "filings": {"recent": {"accessionNumber": [f"{cik}-0"] * n, "filingDate": ["2024-02-01"] * n, "reportDate": ["2023-12-31"] * n, "form": ["10-K"] * n, "primaryDocument": ["p.htm"] * n}, "files": []}}).encode()

    def get(url):
        if "CIK" in url:
            cik = int(url[-15:-5])
            return 200, raw(cik, cik != 3)
        return 200, PAGE.format("Alpha", "Alpha", "Alpha").encode() if "/1/" in url else b"<p>Item 7. nothing else</p>"

    corpus, data = config.load_corpus(tmp_path / "corpus.yaml"), str(tmp_path / "data")
    counts = cli.ingest(spark, corpus, data, get, turns=itertools.repeat(None))
    assert counts == {"fetched": 2, "absent": 1, "skipped": 0, "parsed": 1, "errors": 2}
    assert cli.ingest(spark, corpus, data, None)["skipped"] == 1
    out = str(tmp_path / "chunks")
    assert cli.main(["chunk", "--parsed", f"{data}/parsed", "--out", out]) == 0 and "sections=9" in capsys.readouterr().out
    for s in ("fixed", "structural", "semantic"):
        assert cli.chunk_table(spark, out, s).where("text LIKE '%currency risk%'").count() == 1
    assert cli.main(["index", "--chunks", out, "--out", str(tmp_path / "index"), "--strategy", "fixed"]) == 0
    docs = str(tmp_path / "docs")
    cli.chunk_table(spark, out, "fixed").write.parquet(docs)
    assert cli.main(["search", "--docs", docs, "--query", "cloud revenue", "--mode", "sparse", "--index", str(tmp_path / "index"), "--k", "1"]) == 0
    assert "revenue grew" in capsys.readouterr().out
    assert cli.main(["generate", "--docs", docs, "--query", "currency?", "--answerer", "tests.test_surface:answer", "--k", "2"]) == 0
    assert "Fine [A FY2023" in capsys.readouterr().out
    (tmp_path / "golden.yaml").write_text("questions:\n- {id: q1, type: single_hop, query: currency risk, citations: [{accession: 1-0, item_code: 1A, quote: currency risk}]}\n- {id: q2, type: unanswerable, query: the moon, answerable: false}\n")
    log, rag = str(tmp_path / "log"), str(tmp_path / "rag")
    assert cli.main(["eval-retrieval", "--golden", str(tmp_path / "golden.yaml"), "--chunks", out, "--output", log]) == 0
    rows = tables.read_log(spark, log).collect()
    assert len(rows) == 36 and {r["recall_at_5"] for r in rows if r["answerable"]} == {1.0} and {r["recall_at_5"] for r in rows if not r["answerable"]} == {None}
    assert all(r["gold_sections"][0]["item_code"] == "1A" for r in rows if r["answerable"])
    assert cli.main(["eval-rag", "--golden", str(tmp_path / "golden.yaml"), "--chunks", out, "--output", rag, "--log", log, "--answerer", "tests.test_surface:answer", "--judge", "tests.test_surface:judge", "--mode", "sparse"]) == 0
    answers = tables.read_log(spark, rag, tables.RAG_LOG).collect()
    assert len(answers) == 4 and {r["refused"] for r in answers if not r["answerable"]} == {True} and {r["faithfulness"] for r in answers if r["answerable"]} == {0.9}
    readme = tmp_path / "R.md"
    readme.write_text(f"{report.START}\n{report.END}\n")
    assert cli.main(["report", "--log", log, "--rag-log", rag, "--readme", str(readme), "--output", str(tmp_path / "a.md")]) == 0
    assert "Best chunking: fixed" in readme.read_text() and "Refusals are 1.000 on all 1 unanswerable question." in readme.read_text()
    ask = cli.asker(spark, spark.read.parquet(docs), lambda system, user: [{"delta": "ok"}, {"type": "completed"}])
    events = list(ask({"query": "currency", "strategy": "fixed", "mode": "sparse", "rerank": False, "k": 1, "filters": {"ticker": ["A"]}}))
    assert [e.kind for e in events] == ["citations", "token", "done"] and len(events[0].data["citations"]) == 1
