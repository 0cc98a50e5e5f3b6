"""Upserts, filings, sources, streams and answers."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import generation as G
from tessera.operators import store as S
from tessera.sources import config as cfg
from tessera.sources import filings, tables
from tessera.streaming import incremental


def test_upsert_keeps_vectors(spark):
    old = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0]), (3, None, [3.0])], "id int, text string, embedding array<double>")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, None), (4, "d")], "id int, text string")
    out = {r["id"]: (r["text"], r["embedding"]) for r in S.upsert_chunks(old, new, ["id"]).collect()}
    assert out == {1: ("a", [1.0]), 2: ("B", None), 3: (None, [3.0]), 4: ("d", None)}
    more = S.upsert_chunks(old.withColumn("char_start", F.col("id") * 10), new.withColumn("token_count", F.lit(7)), ["id"])
    assert more.columns == ["id", "text", "embedding", "char_start", "token_count"]
    assert {r["id"]: (r["char_start"], r["token_count"]) for r in more.collect()} == {1: (10, 7), 2: (20, 7), 3: (30, 7), 4: (None, 7)}


def test_write_embeddings(spark):
    chunks = spark.createDataFrame([(1, None), (2, [5.0, 5.0])], "id int, embedding array<double>")
    good = spark.createDataFrame([(1, [1.0, 2.0])], "id int, embedding array<double>")
    assert {r["id"]: r["embedding"] for r in S.write_embeddings(chunks, good, "id", dim=2).collect()} == {1: [1.0, 2.0], 2: [5.0, 5.0]}
    with pytest.raises(Exception, match="another length"):
        S.write_embeddings(chunks, good, "id", dim=3).collect()


SUBMISSIONS = {"cik": "1", "name": "Co", "filings": {"recent": {
    "accessionNumber": ["a", "b", "c", "d"], "filingDate": ["2023-02-01", "2024-02-01", "2024-03-01", "2024-01-01"],
    "reportDate": ["2022-12-31", "2023-12-31", "2023-12-31", ""], "form": ["10-K", "10-K", "10-K", "10-K"], "primaryDocument": ["p", "p", "p", "p"]}, "files": []}}


def test_select_filings(spark, tmp_path):
    (tmp_path / "CIK1.json").write_text(json.dumps(SUBMISSIONS))
    out = S.select_filings(filings.cached_submissions(spark, str(tmp_path)), [2023, 2022, 2021], ["10-K"]).collect()
    assert [(r["fiscal_year"], r["accession"]) for r in out] == [(2023, "c"), (2022, "a"), (2021, None)]


def test_item_spans(spark):
    text = "Item 1A. x\nItem 7. y\n\nItem 1A. Risk\n" + "long " * 20 + "\nItem 7. MD\n" + "more " * 9
    spans = spark.range(1).select(S.item_spans(F.lit(text)).alias("s")).first()["s"]
    assert {s["code"]: text[s["char_start"] :].split("\n")[0] for s in spans} == {"1A": "Item 1A. Risk", "7": "Item 7. MD"}


def test_gaps_and_quotes(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    assert [r["k"] for r in S.gaps(a, a.where("n = 1"), ["k"]).collect()] == ["y"]
    cites = spark.createDataFrame([("x", "q"), ("y", "q"), ("z", "q")], "k string, quote string")
    sections = spark.createDataFrame([("x", "a q b"), ("y", "none")], "k string, text string")
    assert sorted(r["k"] for r in S.quote_misses(cites, sections, ["k"]).collect()) == ["y", "z"]


def test_fetcher_pages_and_retries(spark, tmp_path):
    files = [{"name": "old.json", "filingFrom": "2019-01-01", "filingTo": "2020-01-01"}, {"name": "older.json", "filingFrom": "2001-01-01", "filingTo": "2002-01-01"}, {"name": "open.json", "filingFrom": "2003-01-01"}]
    reply = {**SUBMISSIONS, "filings": {**SUBMISSIONS["filings"], "files": files}}
    page = {"accessionNumber": ["z"], "filingDate": ["2019-03-01"], "reportDate": [" 2018-12-31 "], "form": ["10-K"]}
    waits, asked = [], []
    replies = iter([(429, b""), (403, b""), (200, json.dumps(reply).encode()), (200, json.dumps(page).encode()), (200, b"[1]")])

    def get(url):
        asked.append(url)
        return next(replies)

    fetcher = filings.Fetcher(tmp_path, get, sleep=waits.append)
    fetcher.submissions([1])
    known = filings.cached_submissions(spark, f"{tmp_path}/submissions")
    assert waits == [10.0, 20.0] and filings.wanted_pages(known).isEmpty()
    assert sorted(r["page"] for r in filings.wanted_pages(known, until="2019-06-01").collect()) == ["old.json", "older.json", "open.json"]
    assert filings.fetch_pages(fetcher, known, "2019-06-01", None) == 1 and not any("older" in u for u in asked)
    every = filings.all_filings(spark, known, f"{tmp_path}/pages", "2019-06-01")
    assert [r["accession"] for r in every.orderBy("page", "position").collect()] == ["a", "b", "c", "d", "z"]
    out = S.select_filings(known, [2018, 2023], ["10-K"], every).collect()
    assert [(r["fiscal_year"], r["accession"], r["primary_doc"]) for r in out] == [(2018, "z", None), (2023, "c", "p")]
    fetcher.submissions([1])
    assert len(asked) == 4  # what is stored isn't asked for again
    with pytest.raises(ValueError, match="JSON object"):
        fetcher.submissions([2])
    with pytest.raises(filings.HttpError):
        filings.Fetcher(tmp_path, lambda u: (500, b"no")).document(1, "a-1", "x")
    path = filings.Fetcher(tmp_path, lambda u: (200, b"<p>x\xff</p>")).document("0001", "a-1", "x.htm")
    assert json.loads(path.with_suffix(".meta.json").read_text())["url"].endswith("/1/a1/x.htm")
    assert tuple(filings.cached_pages(spark, str(tmp_path / "raw")).first()) == ("a1", "<p>x\ufffd</p>")


def test_pace():
    now = [0.0]
    turns = filings.paced(2.0, 1.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        next(turns)
    assert now[0] == pytest.approx(1.0)
    burst, then = filings.paced(2.0, 4.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s)), now[0]
    for _ in range(4):
        next(burst)
    assert now[0] == then
    next(burst)
    assert now[0] == pytest.approx(then + 0.5)
    with pytest.raises(ValueError):
        filings.paced(0)


def test_parsed_tables(spark, tmp_path):
    page = "<p>Item 1A. Risk</p><p>body one</p><p>Item 7. MD</p><p>body</p>"
    rows = spark.createDataFrame([("T", "a-1", 2024, page), ("T", "a-2", 2023, page.replace("one", "two")), ("T", "a-3", 2022, "<p>Item 1A. x</p>")], "ticker string, accession string, fiscal_year int, html string")
    sections = S.parse_filings(rows, ["1A", "7"])
    assert {(r["accession"], r["message"]) for r in S.errors(sections).collect()} == {("a-3", "missing Item 7")}
    with pytest.raises(Exception, match="a-3 lacks Item 7"):
        S.parsed(sections, ["accession"]).collect()
    good = S.parsed(sections.where("accession <> 'a-3'"), ["accession"])
    folder = str(tmp_path / "parsed")
    tables.write_parsed(good, folder)
    tables.write_parsed(good.where("accession = 'a-2'").withColumn("fiscal_year", F.lit(1999)), folder)
    assert [(r["accession"], r["fiscal_year"], len(r["sections"])) for r in tables.read_parsed(spark, folder).collect()] == [("a-1", 2024, 2), ("a-2", 1999, 2)]
    one = tables.load_parsed(spark, folder, "a-2").first()
    assert one["sections"][0]["text"] == "Item 1A. Risk\nbody two" and one["sections"][0]["item_title"] == "Risk Factors"
    with pytest.raises(KeyError):
        tables.load_parsed(spark, folder, "a-9")
    with pytest.raises(FileNotFoundError):
        tables.read_parsed(spark, str(tmp_path / "none"))


def test_chunk_store(spark, tmp_path):
    store = S.ChunkStore(spark, f"file://{tmp_path}/store", dim=2)
    filing = spark.createDataFrame([("a1", "T", 2024, "u"), ("a2", "S", 2023, "v")], "accession string, ticker string, fiscal_year int, edgar_url string")
    section = spark.createDataFrame([("a1", "1A", "s"), ("a2", "1A", "s")], "accession string, item_code string, text string")
    chunk = spark.createDataFrame([("a1", "1A", "fixed", 0, "x"), ("a1", "1A", "fixed", 1, "y"), ("a2", "1A", "fixed", 0, "z")], "accession string, item_code string, strategy string, chunk_index int, text string")
    with pytest.raises(ValueError):
        store.upsert_chunks(chunk)
    store.upsert_filings(filing, section)
    store.upsert_filings(filing.where("accession = 'a1'").withColumn("fiscal_year", F.lit(2025)), section.limit(0))
    with pytest.raises(Exception, match="unknown section"):
        store.upsert_chunks(chunk.withColumn("item_code", F.lit("9")))
    store.upsert_chunks(chunk)
    vectors = spark.createDataFrame([("a1", "fixed", 0, [1.0, 0.0]), ("a2", "fixed", 0, [0.0, 1.0])], "accession string, strategy string, chunk_index int, embedding array<float>")
    store.write_embeddings(vectors)
    assert store.unembedded("fixed").count() == 1
    q = spark.createDataFrame([(0, [0.6, 0.8])], "qid int, vector array<double>")
    hits = store.search(q, "fixed", 5).orderBy("rank").collect()
    assert [(r["ticker"], r["fiscal_year"], r["score"]) for r in hits] == [("S", 2023, 0.8), ("T", 2025, 0.6)]
    from tessera.operators.retrieval import Filters

    assert [r["ticker"] for r in store.search(q, "fixed", 1, Filters({"ticker": ["T"]})).collect()] == ["T"]
    assert store.search(q, "fixed", 1, Filters({"ticker": []})).count() == 0
    with pytest.raises(ValueError, match="2 dimensions"):
        store.search(spark.createDataFrame([(0, [1.0])], "qid int, vector array<double>"), "fixed", 1)
    store.upsert_chunks(chunk.withColumn("text", F.when(F.col("accession") == "a1", F.lit("new")).otherwise(F.col("text"))))
    assert {r["accession"] for r in store.chunks().where("embedding IS NOT NULL").collect()} == {"a2"}
    assert store.clear_embeddings(F.col("accession") == "a2") == 1
    store.vacuum()
    assert store.index_stats().first().asDict() == {"strategy": "fixed", "chunks": 3, "embedded": 0, "filings": 2}
    assert [r["text"] for r in store.iter_chunks("fixed").collect()] == ["new", "new", "z"]


def test_schema_is_created_once(spark):
    names = tables.ensure_schema(spark, "kept")
    assert tables.ensure_schema(spark, "kept") == names and "embedding" in spark.table("kept.chunks").columns
    spark.sql("DROP DATABASE kept CASCADE")


def test_chunk_tables(spark, tmp_path):
    rows = spark.createDataFrame([("T", "1", "a1", 2024, "u", "1A", "t", "fixed", 0, 0, 1, 1, "x"), ("T", "1", "a2", 2024, "u", "1A", "t", "fixed", 0, 0, 1, 1, "y")], tables.CHUNK)
    tables.write_chunks(rows, str(tmp_path / "c"))
    tables.write_chunks(rows.where("accession = 'a2'").withColumn("text", F.lit("z")), str(tmp_path / "c"))
    assert {r["accession"]: r["text"] for r in tables.read_chunks(spark, str(tmp_path / "c"), "fixed").collect()} == {"a1": "x", "a2": "z"}


def test_lenient_log(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"strategy": "fixed", "mrr": "x", "rerank": true}\n\n{"mode": "dense", "encode_ms": 3}\n')
    rows = tables.read_log(spark, str(tmp_path / "l.jsonl")).orderBy("encode_ms").collect()
    assert len(rows) == 2 and rows[0]["mrr"] is None and rows[0]["query"] == "" and rows[1]["encode_ms"] == 3.0


def test_incremental(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for n in (1, 2):
        spark.createDataFrame([(n, "a b c")], "id int, text string").write.mode("append").parquet(src)
        incremental.chunk_new(spark, src, "id int, text string", out, mark).awaitTermination()
        assert sorted(r["id"] for r in incremental.read_processed(spark, out).collect()) == list(range(1, n + 1))


HIT = [(0, 1, 2.0, "MSFT", 2024, "1A", "acc", "u", "body  text")]
HIT_SCHEMA = "qid long, rank int, score double, ticker string, fiscal_year int, item_code string, accession string, edgar_url string, text string"


def test_prompts_and_answers(spark):
    q = spark.createDataFrame([(0, " why? "), (1, "what?")], "qid long, text string")
    rows = {r["qid"]: r["user"] for r in G.prompts(q, spark.createDataFrame(HIT, HIT_SCHEMA)).collect()}
    assert rows[0] == "Question:\nwhy?\n\nContexts:\n[1] MSFT FY2024 Item 1A accession=acc url=u\nbody  text"
    assert rows[1].endswith("(none)")

    def model(system, user):
        if "(none)" in user:
            raise RuntimeError("down")
        return "Not in the corpus.", 1000, 10

    out = {r["qid"]: r for r in G.answers(G.prompts(q, spark.createDataFrame(HIT, HIT_SCHEMA)), model).collect()}
    assert out[0]["refused"] and out[0]["usd"] == pytest.approx((1000 * 0.2 + 10 * 1.2) / 1e6) and out[1]["error"] == "down"


def test_judged(spark):
    rows = spark.createDataFrame([("q", "a", "c", "r", True), ("bad", "a", "c", "r", True), ("q", "a", "c", "r", False)], "query string, response string, contexts string, reference string, answerable boolean")

    def judge(query, response, contexts, reference):
        if query == "bad":
            raise RuntimeError("away")
        return 1.0, 0.5, 0.25, 0.0

    out = [(r["faithfulness"], r["judge_error"]) for r in G.judged(rows, judge).collect()]
    assert out == [(1.0, None), (None, "away"), (None, None)]


def test_provider_events():
    assert G.error_text({"response": {"error": {"message": "m"}}}) == "m" and G.error_text({}) == "generation failed"
    assert G.error_text({"response": {"status": "incomplete", "incomplete_details": {"reason": "length"}}}) == "generation incomplete (length)"
    assert list(G.deltas([{"type": "response.output_text.delta", "delta": "x"}, {"type": "response.completed", "response": {"usage": {"input_tokens": 3}}}])) == [{"type": "delta", "delta": "x"}, {"type": "completed", "input_tokens": 3}]
    with pytest.raises(RuntimeError, match="no"):
        list(G.deltas([{"type": "response.failed", "response": {"error": {"message": "no"}}}]))
    assert G.chat_arguments("m", "s", "u", effort="low") == {"model": "m", "instructions": "s", "input": [{"role": "user", "content": "u"}], "reasoning": {"effort": "low"}}


def test_events(spark):
    events = list(G.answer_events(spark.createDataFrame(HIT, HIT_SCHEMA), [{"delta": "a"}, {"delta": ""}, {"type": "completed", "input_tokens": 5, "completion_tokens": True}]))
    assert [e.kind for e in events] == ["citations", "token", "done"]
    assert "text" not in events[0].data["citations"][0] and events[0].data["citations"][0]["snippet"] == "body text"
    assert events[-1].data["prompt_tokens"] == 5 and events[-1].data["completion_tokens"] == 0
    assert events[1].sse() == 'event: token\ndata: {"delta": "a"}\n\n'


def test_config(tmp_path):
    (tmp_path / "g.yaml").write_text("questions:\n- {id: a, type: temporal, query: q, citations: [{accession: x, item_code: 1a, quote: z}]}\n")
    assert cfg.load_golden(tmp_path / "g.yaml")[0].id == "a"
    assert cfg.load_golden(tmp_path / "g.yaml", texts={("x", "1A"): "a z b"})
    with pytest.raises(ValueError, match="quote"):
        cfg.load_golden(tmp_path / "g.yaml", texts={("x", "1A"): "a b"})
    with pytest.raises(ValueError, match="unknown item"):
        cfg.load_golden(tmp_path / "g.yaml", items=["7"])
    (tmp_path / "c.yaml").write_text("form_types: [10-K]\nfiscal_years: [2023, 2024]\nitems: [1a]\ncompanies:\n- {ticker: ' abc ', cik: 12, sector: s}\n- {ticker: x, cik: '34'}\n")
    corpus = cfg.load_corpus(tmp_path / "c.yaml")
    assert corpus.companies == {"ABC": ("0000000012", "s"), "X": ("0000000034", "")} and corpus.tickers([" x"]) == ["X"] and corpus.tickers() == ["ABC", "X"]
    with pytest.raises(KeyError):
        corpus.tickers(["no"])
    with pytest.raises(ValueError):
        corpus.years([1999])
    (tmp_path / ".env").write_text("# c\nTESSERA_DATA_DIR='d'\nexport TESSERA_API_KEY=k\n")
    settings = cfg.Settings.load(tmp_path / ".env")
    assert settings.raw == "d/raw" and settings.require("api_key") == "k"
    with pytest.raises(RuntimeError):
        settings.require("user_agent")
    with pytest.raises(ValueError):
        cfg.Question("a", "temporal", "q")
    with pytest.raises(ValueError):
        cfg.Chunking(size=10, overlap=10)
    assert cfg.resolve([" Dense", "dense"], ("dense", "sparse"), "mode") == ["dense"]
    with pytest.raises(ValueError):
        cfg.resolve(["x"], ("dense",), "mode")
