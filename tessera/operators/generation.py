"""Answers: prompts made of hits, an injected model, costs, refusals and judges, batched or as a stream of events."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CITATION_FORMAT = "[TICKER FYyear Item CODE]"


def system_prompt(phrase: str = T.REFUSAL_PHRASE) -> str:
    """The rules of an answer."""
    # The wording is part of what answers depend on.
    return (
        "You answer questions about SEC 10-K filings using only the numbered contexts.\n"
        "\n"
        "Rules:\n"
        "- Use only information in the contexts. Do not use outside knowledge.\n"
        f"- Cite every claim as {CITATION_FORMAT}, for example [MSFT FY2024 Item 1A].\n"
        f"- If the contexts do not contain enough information to answer, reply with exactly: {phrase.strip()}"
    )


def block_header(number: Column) -> Column:
    tag = F.format_string("%s FY%d Item %s", F.col("ticker"), F.col("fiscal_year"), F.col("item_code"))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), tag, F.lit(" accession="), F.col("accession"), F.lit(" url="), F.col("edgar_url"))


def prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, system, user): contexts are numbered by their order, whatever their ranks; "(none)" without hits.

    A query has k hits at most, so that its contexts fit a row.  Blank queries fail.
    """
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "ticker", "fiscal_year", "item_code", "accession", "edgar_url", "text"))).alias("h"))
    numbered = listed.select("qid", F.posexplode("h").alias("i", "x")).select("qid", "i", "x.*")
    blocks = numbered.select("qid", "i", F.concat(block_header(F.col("i") + 1), F.lit("\n"), F.col("text")).alias("b"))
    contexts = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("bs")).select("qid", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("contexts"))
    asked = queries.select("qid", T.strip(F.col("text")).alias("q"))
    q = F.when(F.assert_true(F.col("q") != "", F.lit("query must be non-empty")).isNull(), F.col("q"))
    return asked.join(contexts, "qid", "left").select("qid", F.lit(system_prompt()).alias("system"), F.concat(F.lit("Question:\n"), q, F.lit("\n\nContexts:\n"), F.coalesce("contexts", F.lit("(none)"))).alias("user"))


Answerer = Callable[[str, str], tuple[str, int, int]]


def answers(prompted: DataFrame, answerer: Answerer) -> DataFrame:
    """(qid, response, prompt_tokens, completion_tokens, usd, generate_ms, refused, error) of an injected model.

    ``answerer`` (system, user) returns text and token counts; what it raises is a row's error, not the job's.
    """

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                began = time.perf_counter()
                try:
                    text, p, c, error = *answerer(r.system, r.user), None
                except Exception as e:  # noqa: BLE001  a model's failure is data
                    text, p, c, error = None, 0, 0, str(e)
                out.append((r.qid, text, max(0, int(p)), max(0, int(c)), (time.perf_counter() - began) * 1000, error))
            yield type(pdf)(out, columns=["qid", "response", "prompt_tokens", "completion_tokens", "generate_ms", "error"])

    rows = prompted.mapInPandas(run, "qid long, response string, prompt_tokens long, completion_tokens long, generate_ms double, error string")
    return rows.withColumn("usd", T.cost_usd(F.col("prompt_tokens"), F.col("completion_tokens"))).withColumn("refused", T.is_refusal(F.col("response")))


JUDGED = ("faithfulness", "context_precision", "context_recall", "relevancy")


def judged(rows: DataFrame, judge: Callable[[str, str, str, str], tuple[float, float, float, float]], usd: float = 0.0) -> DataFrame:
    """Faithfulness, context precision, context recall and relevancy of (query, response, contexts, reference) with judge_ms,
    judge_usd and judge_error, for answerable rows only.

    What the judge raises, or a metric that is missing, is a row's error, not the job's; its metrics are null.
    """

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                began, scores, error = time.perf_counter(), (None,) * len(JUDGED), None
                if r.answerable:
                    try:
                        scores = tuple(float(x) for x in judge(r.query, r.response, r.contexts, r.reference))
                        if len(scores) != len(JUDGED) or any(x != x for x in scores):
                            raise ValueError("a metric is missing")
                    except Exception as e:  # noqa: BLE001  a judge's failure is data
                        scores, error = (None,) * len(JUDGED), str(e)
                out.append((*scores, (time.perf_counter() - began) * 1000 if r.answerable else 0.0, usd if r.answerable else 0.0, error))
            for i, name in enumerate((*JUDGED, "judge_ms", "judge_usd", "judge_error")):
                pdf[name] = [o[i] for o in out]
            yield pdf

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, {', '.join(f'{j} double' for j in JUDGED)}, judge_ms double, judge_usd double, judge_error string")


def split_instructions(messages: DataFrame, key: str, *, order: str = "turn") -> DataFrame:
    """(key, instructions, turns) of conversations (key, ``order``, role, text): the first system message, and how many others
    there are; a conversation of system messages alone is left out."""
    system = F.col("role") == "system"
    rows = messages.groupBy(key).agg(F.min_by(F.when(system, F.col("text")), F.when(system, F.col(order))).alias("instructions"), F.sum((~system).cast("long")).alias("turns"))
    return rows.where("turns > 0")


def join_stream(deltas: DataFrame, key: str, *, order: str, text: str, usage: str) -> DataFrame:
    """(key, answer, usage): a stream's texts in order, and the last usage that it gave."""
    rows = deltas.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_p"), F.max_by(usage, F.when(F.col(usage).isNotNull(), F.col(order))).alias(usage))
    return rows.select(key, F.array_join(F.transform("_p", lambda x: x[text]), "").alias("answer"), usage)


def chat_arguments(model: str, system: str, user: str, *, temperature: float | None = None, max_tokens: int | None = None, effort: str | None = None, stream: bool = False) -> dict:
    """What an OpenAI-style provider is sent; arguments that aren't set are left out."""
    given = {"temperature": temperature, "max_output_tokens": max_tokens, "reasoning": {"effort": effort} if effort else None, "stream": True if stream else None}
    return {"model": model, "instructions": system, "input": [{"role": "user", "content": user}]} | {k: v for k, v in given.items() if v is not None}


def error_text(event: dict) -> str:
    """What went wrong, as a provider's event says it: its message, that of its error or response, or its status."""
    response = event.get("response") if isinstance(event.get("response"), dict) else {}
    nested = [x.get("error") for x in (event, response)]
    texts = [event.get("message"), *(e.get("message") if isinstance(e, dict) else e for e in nested)]
    status = response.get("status") or event.get("status")
    reason = (response.get("incomplete_details") or {}).get("reason")
    texts.append(" ".join(filter(None, [f"generation {status}" if status else "", f"({reason})" if reason else ""])))
    return next((t for t in texts if isinstance(t, str) and t.strip()), "generation failed")


FAILED = ("failed", "error", "incomplete", "response.failed", "response.incomplete")


def deltas(events: Iterable[dict]) -> Iterator[dict]:
    """A provider's events as the three kinds that an answer is made of; one that fails raises."""
    for e in events:
        kind = str(e.get("type") or "delta")
        if kind in FAILED:
            raise RuntimeError(error_text(e))
        if kind.endswith("completed"):
            usage = e.get("usage") or (e.get("response") or {}).get("usage") or e
            yield {"type": "completed", **usage}
        elif e.get("delta"):
            yield {"type": "delta", "delta": e["delta"]}


@dataclass(frozen=True)
class Event:
    """One of a stream: citations first, then tokens, then done."""

    kind: str
    data: dict

    def sse(self) -> str:
        return f"event: {self.kind}\ndata: {json.dumps(self.data)}\n\n"


def citations(hits: DataFrame) -> DataFrame:
    """What a reader sees of hits, in order: where they are from and a snippet, never the whole text."""
    return hits.orderBy("rank").select("rank", "score", "ticker", "fiscal_year", "item_code", "accession", "edgar_url", T.snippet(F.col("text")).alias("snippet"))


def answer_events(hits: DataFrame, stream: Iterable[dict]) -> Iterator[Event]:
    """Events of one answer: a provider's events have a type (delta, completed, failed); empty deltas are dropped.

    Hits are a query's top k; snippets are cut by the cluster, so that full texts never reach the driver.
    """
    yield Event("citations", {"citations": [r.asDict() for r in citations(hits).toLocalIterator()]})
    usage: dict = {}
    for d in deltas(stream):
        if d["type"] == "completed":
            usage = d
        else:
            yield Event("token", {"delta": d["delta"]})
    spent = {k: _count(usage, k, other) for k, other in (("prompt_tokens", "input_tokens"), ("completion_tokens", "output_tokens"))}
    usd = (spent["prompt_tokens"] * T.PRICE_IN_PER_MILLION + spent["completion_tokens"] * T.PRICE_OUT_PER_MILLION) / 1_000_000
    yield Event("done", {**spent, "usd": usd})


def _count(data: dict, *names: str) -> int:
    """The first of the names that holds a whole number, at least 0; a truth value is no number."""
    for n in names:
        if isinstance(data.get(n), int) and not isinstance(data[n], bool):
            return max(0, data[n])
    return 0
