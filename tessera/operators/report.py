"""The evaluation's report as markdown: small collected tables and driver strings."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

START, END = "<!-- ablation:start -->", "<!-- ablation:end -->"


def cell(value: float | None, digits: int = 3) -> str:
    return "n/a" if value is None else f"{value:.{digits}f}"


def label(mode: str, rerank: bool) -> str:
    return f"{mode}+rerank" if rerank else mode


def retrieval_table(report: DataFrame) -> str:
    """A row for each cell: 18 at most."""
    head = "| strategy | mode | recall@5 | MRR | nDCG@10 | p50 ms | p95 ms |\n| --- | --- | --- | --- | --- | --- | --- |"
    rows = report.orderBy("strategy", "mode", "rerank").collect()
    return "\n".join([head, *(f"| {r['strategy']} | {label(r['mode'], r['rerank'])} | {cell(r['recall_at_5'])} | {cell(r['mrr'])} | {cell(r['ndcg_at_10'])} | {cell(r['p50_ms'], 0)} | {cell(r['p95_ms'], 0)} |" for r in rows)])


def generation_table(report: DataFrame) -> str:
    head = "| mode | faithfulness | ctx precision | ctx recall | relevancy | p50 ms | p95 ms | USD |\n| --- | --- | --- | --- | --- | --- | --- | --- |"
    rows = report.orderBy("mode", "rerank").collect()
    return "\n".join([head, *(f"| {label(r['mode'], r['rerank'])} | {cell(r['faithfulness'])} | {cell(r['context_precision'])} | {cell(r['context_recall'])} | {cell(r['relevancy'])} | {cell(r['p50_ms'], 0)} | {cell(r['p95_ms'], 0)} | {cell(r['usd'], 6)} |" for r in rows)])


def _cells(report: DataFrame, *columns: str) -> dict[tuple[str, bool], tuple]:
    """Figures by mode and reranking: six cells at most."""
    return {(r["mode"], r["rerank"]): tuple(r[c] for c in columns) for r in report.select("mode", "rerank", *columns).collect()}


#: A report calls a median that grows by this factor a near tripling, contexts of this precision or less a weak spot, one gain
#: that is this many times another the better one, and costs within this share of the least one flat.
TRIPLES, WEAK, TWICE, FLAT = 2.5, 0.40, 2.0, 0.10


def median_clause(off: float, on: float) -> str:
    word = "nearly triples" if off > 0 and on / off >= TRIPLES else "raises"
    return f"{word} the median from {off:.0f} ms to {on:.0f} ms"


def flat(low: float, high: float) -> bool:
    return low > 0 and (high - low) / low <= FLAT


def steps(recall: dict[tuple[str, bool], float | None]) -> list[tuple[str, float, float]]:
    """What reranking, fusing and both add, of recalls of three digits; nothing unless all four cells have one."""
    at = {c: None if recall.get(c) is None else round(recall[c], 3) for c in (("dense", False), ("dense", True), ("hybrid", False), ("hybrid", True))}
    if None in at.values():
        return []
    return [("reranking dense", at["dense", False], at["dense", True]), ("fusing", at["dense", False], at["hybrid", False]), ("reranking the fusion", at["hybrid", False], at["hybrid", True])]


def fusion_verdict(changes: list[tuple[str, float, float]]) -> str:
    """Whether fusion paid for itself once reranking is on."""
    if not changes:
        return ""
    (_, dense, reranked), (_, _, fused), (_, _, both) = changes
    if reranked <= both:
        return ""
    twice = " Reranking alone gains twice as much as fusing alone, or more." if fused > dense and reranked - dense >= TWICE * (fused - dense) else ""
    return f"Fusing and reranking find mostly the same chunks.{twice} The fusion did not pay for itself."


def refusal_clause(rates: list[float], unanswerable: int) -> str:
    noun = "question" if unanswerable == 1 else "questions"
    if not rates:
        return ""
    low, high = min(rates), max(rates)
    return f"Refusals are {low:.3f} on all {unanswerable} unanswerable {noun}." if high - low < 1e-9 else f"Refusals range from {low:.3f} to {high:.3f} on {unanswerable} unanswerable {noun}."


def precision_clause(values: list[float]) -> str:
    if not values:
        return ""
    low, high = min(values), max(values)
    return f"Context precision is the weak spot ({low:.2f} to {high:.2f}): most of what is retrieved supports no answer." if high <= WEAK else f"Context precision ranges from {low:.2f} to {high:.2f}."


def cost_clause(values: list[float]) -> str:
    if not values:
        return ""
    low, high = min(values), max(values)
    return f"Cost is flat (${low:.6f} to ${high:.6f} a query): it follows k and the size of chunks." if flat(low, high) else f"Cost ranges from ${low:.6f} to ${high:.6f} a query."


def headlines(winner: DataFrame, retrieval: DataFrame, generation: DataFrame | None, leads: DataFrame | None = None) -> list[str]:
    """The best chunker with its leads, the best search and what its parts add, the best answers, and the refusals with costs."""
    best = winner.first()
    if best is None:
        raise ValueError("a report needs a winning strategy")
    others = [] if leads is None else [f"{r['lead']:+.3f} against {r['other']}" for r in leads.orderBy("other").collect()]
    lead = f", {' and '.join(others)}" if others else "" if best["lead"] is None else f", {best['lead']:+.3f} to the next"
    lines = [f"Best chunking: {best['strategy']}, recall@5 {cell(best['recall_at_5'])}{lead}."]

    recall = {c: v[0] for c, v in _cells(retrieval.where(retrieval["strategy"] == best["strategy"]), "recall_at_5").items()}
    scored = {c: v for c, v in recall.items() if v is not None}
    gains = "; ".join(f"{name}: {after - before:+.3f}" for name, before, after in steps(recall)) or "steps: n/a"
    if scored:
        top = max(scored, key=lambda c: (scored[c], c))
        both = scored.get(("hybrid", True))
        gap = "" if both is None or top == ("hybrid", True) else f", {round(scored[top], 3) - round(both, 3):+.3f} to hybrid+rerank"
        lines.append(f"Best search: {label(*top)}, recall@5 {cell(scored[top])}{gap}; {gains}.")
    else:
        lines.append(f"Best search: n/a; {gains}.")
    if generation is not None:
        lines += _answer_lines(generation)
    return lines


def _answer_lines(generation: DataFrame) -> list[str]:
    cells = _cells(generation, "faithfulness", "context_precision", "refusal_rate", "usd", "p50_ms")
    faithful = {c: v[0] for c, v in cells.items() if v[0] is not None}
    if not faithful:
        answer = "Best answers: n/a."
    else:
        top = max(faithful, key=lambda c: (faithful[c], c))
        answer = f"Best answers: {label(*top)}, faithfulness {cell(faithful[top])}"
        on = (top[0], True)
        if not top[1] and on in faithful:
            answer += f"; reranking makes it {cell(faithful[on])} and {median_clause(cells[top][4] or 0, cells[on][4] or 0)}"
        pairs = [(cells[m, False][1], cells[m, True][1]) for m in ("dense", "sparse", "hybrid") if (m, False) in cells and (m, True) in cells]
        pairs = [(off, on) for off, on in pairs if off is not None and on is not None]
        answer += "; context precision falls wherever reranking is on." if pairs and all(on < off for off, on in pairs) else "."
    some = lambda i: [v[i] for v in cells.values() if v[i] is not None]
    n = max([r["n_unanswerable"] or 0 for r in generation.select("n_unanswerable").collect()], default=0) if "n_unanswerable" in generation.columns else 0
    rest = " ".join(filter(None, [refusal_clause(some(2), n), precision_clause(some(1)), cost_clause(some(3))]))
    return [answer, rest or "Refusals, context precision and cost: n/a."]


def narrative(winner: DataFrame, retrieval: DataFrame) -> str:
    """The steps from dense search to both, a line each, and whether fusion paid; nothing without the four cells."""
    best = winner.first()
    recall = {c: v[0] for c, v in _cells(retrieval.where(retrieval["strategy"] == best["strategy"]), "recall_at_5").items()}
    changes = steps(recall)
    lines = [f"- {name}: {before:.3f} to {after:.3f} ({after - before:+.3f})" for name, before, after in changes]
    return "\n".join(filter(None, ["\n".join(lines), fusion_verdict(changes)]))


def render(winner: DataFrame, retrieval: DataFrame, generation: DataFrame | None = None, leads: DataFrame | None = None) -> str:
    parts = ["## Ablation", "\n".join(f"- {x}" for x in headlines(winner, retrieval, generation, leads)), retrieval_table(retrieval)]
    if generation is not None:
        parts.append(generation_table(generation))
    parts.append(narrative(winner, retrieval))
    return "\n\n".join(filter(None, parts)) + "\n"


def text_table(rows: list[dict], columns: list[str]) -> str:
    """Rows of fixed width for a terminal: figures of three digits, n/a for what is missing."""
    shown = [[cell(r.get(c)) if isinstance(r.get(c), float) or r.get(c) is None else str(r[c]) for c in columns] for r in rows]
    wide = [max(len(x) for x in column) for column in zip(columns, *shown, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, wide, strict=True)).rstrip() for row in (columns, *shown))


def inject(path: str | Path, body: str) -> None:
    """Replace what stands between the two markers of a file; a file without them is an error."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if START not in text or END not in text:
        raise ValueError(f"{path} has no report markers")
    before, rest = text.split(START, 1)
    path.write_text(f"{before}{START}\n{body}{END}{rest.split(END, 1)[1]}", encoding="utf-8")
