"""Mixing sources to target weights, in DataFrame operations only.

1. A naive Bayes classifier over hashed words is counted on a bounded sample of a labelled table (doc_id, domain).
2. Every document gets a posterior over the domains: log prior plus log likelihood over the root of the number of
   words (a tempered, soft membership).
3. Documents are gathered in cells of like posteriors, a grid over the simplex, whose size the grid bounds.  Documents
   of a cell share a rate; a cell's expected tokens by domain are summed exactly.
4. Projected gradient steps fit the rates: least squares between the expected tokens by domain, relative to the
   targets, with a small pull towards a rate of 1, and every step cut off at ``floor`` (0: rates are nonnegative).
   Each cell has a step of its own, so that scarce domains move as fast as common ones, and steps gather momentum
   until they no longer move any domain.  A step is an aggregation over the cells that returns a few numbers for each domain.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import materialize, sized

#: Labelled documents that the classifier counts at most.
SAMPLE = 6_000
#: Hashed words.
BUCKETS = 2_048
#: Steps of the grid from 0 to 1: at most C(GRID + D - 1, D - 1) cells, some 23,000 for four domains.
GRID = 50
#: Steps end when one moves no domain by more than this share of its target, or are reported after ``STEPS``.
SETTLED = 1e-4
STEPS = 400
#: Misses of a target that are reported.
MISSED = 0.01
PULL = 1e-3


def words_of(text: Column) -> Column:
    """Runs of characters other than space, tab and line ends; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _constant(values: list[float]) -> Column:
    """An array literal; Catalyst folds the cast once."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast("array<double>")


def _summed(buckets: str, values: list[float]) -> Column:
    """The sum of the buckets' values."""
    table = _constant(values)
    return F.aggregate(buckets, F.lit(0.0), lambda a, i: a + F.get(table, i))


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], *, sample: int = SAMPLE) -> tuple[list[float], list[list[float]]]:
    """Log priors and, by domain, log probabilities of the buckets, with add-one smoothing.

    ``labelled`` (doc_id, domain) rows with a null id, or of no such domain, are passed over; of repeated ids the
    smallest domain counts.  At most ``sample`` ids, in hash order, are counted.
    """
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    words = texts.select("domain", F.explode(words_of(F.col("text"))).alias("w")).groupBy("domain", _bucket(F.col("w")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    per_domain = {r["domain"]: r["n"] for r in picked.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {d: [1.0] * BUCKETS for d in domains}
    for r in words:
        counts[r["domain"]][r["b"]] += r["n"]
    total = sum(per_domain.values()) + len(domains)
    priors = [math.log((per_domain.get(d, 0) + 1) / total) for d in domains]
    return priors, [[math.log(n / sum(counts[d])) for n in counts[d]] for d in domains]


def scored(docs: DataFrame, priors: list[float], likelihoods: list[list[float]]) -> DataFrame:
    """``docs`` with _mix_tokens and _mix_posterior (an array in the order of the domains)."""
    words = docs.withColumn("_mix_words", F.transform(words_of(F.col("text")), _bucket)).withColumn("_mix_tokens", F.size("_mix_words").cast("long"))
    base = likelihoods[0]
    # one pass for each domain but the first: sums of log likelihood ratios to the first
    sums = [F.lit(0.0)] + [_summed("_mix_words", [x - y for x, y in zip(likelihood, base, strict=True)]) for likelihood in likelihoods[1:]]
    logs = F.array(*[F.lit(p) + s / F.sqrt(F.greatest(F.col("_mix_tokens"), F.lit(1))) for p, s in zip(priors, sums, strict=True)])
    weights = words.withColumn("_mix_logs", logs).withColumn("_mix_weights", F.transform("_mix_logs", lambda x: F.exp(x - F.array_max("_mix_logs"))))
    total = F.aggregate("_mix_weights", F.lit(0.0), lambda a, x: a + x)
    return weights.withColumn("_mix_posterior", F.transform("_mix_weights", lambda x: x / total)).drop("_mix_words", "_mix_logs", "_mix_weights")


def fit_rates(cells: DataFrame, shares: list[float], *, budget: float | None, floor: float, steps: int = STEPS, pull: float = PULL) -> DataFrame:
    """``cells`` (tokens, mass: expected tokens by domain) with a column rate.

    Minimises 1/2 sum_d (sum_c rate_c mass_cd / target_d - 1)^2 + pull/2 sum_c tokens_c / total (rate_c - 1)^2 over
    rate >= floor, where target_d = share_d * budget; by default the budget is the total of tokens.  Domains that no document
    may belong to, and cells without tokens, leave rates at 1.  Warns if the steps do not settle, and of targets that the
    fitted rates miss by more than ``MISSED`` (the floor, mixed cells or the pull forbid them).
    """
    n = len(shares)
    sums = cells.agg(F.sum("tokens").alias("total"), *[F.sum(F.col("mass")[d]).alias(f"m{d}") for d in range(n)]).first()
    total, mass = float(sums["total"] or 0), [float(sums[f"m{d}"] or 0) for d in range(n)]
    if total <= 0:
        return cells.withColumn("rate", F.greatest(F.lit(1.0), F.lit(float(floor))))
    live = [d for d in range(n) if mass[d] > 0 and shares[d] > 0]
    norm = sum(shares[d] for d in live)
    # a floor above 0 must leave room for the targets
    goal = budget if budget is not None else total if floor == 0 else max(mass[d] * floor * norm / shares[d] for d in live)
    target = {d: shares[d] / norm * goal for d in live}
    # a gradient by the cell's share of tokens: the pull of each domain on a cell
    lever = {d: F.when(F.col("tokens") > 0, F.col("mass")[d] / F.col("tokens")).otherwise(0.0) * (total / target[d]) for d in live}
    share = F.col("tokens") / total
    # the sum of a cell's row of the nonnegative Hessian bounds its curvature: no step can overshoot
    size = F.lit(1.0) / (reduce(lambda a, b: a + b, [lever[d] * (mass[d] / target[d]) for d in live]) + pull)
    start = F.greatest(F.lit(1.0), F.lit(float(floor)))
    now = cells.withColumn("rate", start).withColumn("_ahead", start)
    got = {d: mass[d] * max(1.0, float(floor)) for d in live}
    ahead, speed, moved = got, 1.0, math.inf
    for turn in range(1, steps + 1):
        slope = reduce(lambda a, b: a + b, [lever[d] * (ahead[d] / target[d] - 1) for d in live]) + (F.col("_ahead") - 1) * pull
        now = now.withColumn("_next", F.greatest(F.lit(float(floor)), F.col("_ahead") - slope * size))
        move = F.col("_next") - F.col("_ahead")
        sums = now.agg(
            *[F.sum(F.col("_next") * F.col("mass")[d]).alias(f"m{d}") for d in live], *[F.sum(share * lever[d] * F.abs(move)).alias(f"v{d}") for d in live],
            F.sum(share / size * move * (F.col("rate") - F.col("_next"))).alias("back"),
        ).first()
        # momentum starts anew when it points uphill
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        push, speed = (0.0, 1.0) if sums["back"] > 0 else ((speed - 1) / faster, faster)
        last, got = got, {d: sums[f"m{d}"] for d in live}
        ahead = {d: got[d] + push * (got[d] - last[d]) for d in live}
        now = now.withColumn("_ahead", F.col("_next") + (F.col("_next") - F.col("rate")) * push).withColumn("rate", F.col("_next")).drop("_next")
        # a plan of several steps would repeat each step's expressions in the next
        now = materialize(now, "rates")
        moved = max(sums[f"v{d}"] for d in live)
        if moved < SETTLED:
            break
    missed = {d: round(got[d] / target[d] - 1, 4) for d in live if abs(got[d] / target[d] - 1) > MISSED}
    if moved >= SETTLED:
        warnings.warn(f"mixing rates have not settled after {steps} steps: the last moved a domain by {moved:.2g} of its target", RuntimeWarning, stacklevel=2)
    if missed:
        warnings.warn(f"mixing rates miss targets, by the domain's place: {missed}", RuntimeWarning, stacklevel=2)
    return now.drop("_ahead")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, keep: list[str] | None = None, floor: float = 0.0, budget: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """A rate for every row of ``docs`` (doc_id, text): how often it is taken, so that domains get their target shares.

    Returns the columns ``keep`` (all by default) and a struct ``_mix`` of tokens, posterior (by the sorted names of the
    targets) and rate.  A null or blank text has no tokens, the prior as posterior, and the rate of its cell.  Repeated
    rows are answered alike; no rows give no rows.
    """
    domains = sorted(targets)
    keep = docs.columns if keep is None else keep
    model = classifier(docs, labelled, domains, sample=sample)
    rows = scored(docs, *model).withColumn("_mix_cell", F.concat_ws(",", F.transform("_mix_posterior", lambda p: F.round(p * GRID).cast("int").cast("string"))))
    rows = materialize(rows.select(*keep, "_mix_tokens", "_mix_posterior", "_mix_cell"), "scored")
    cells = rows.groupBy("_mix_cell").agg(F.sum("_mix_tokens").alias("tokens"), F.array(*[F.sum(F.col("_mix_tokens") * F.col("_mix_posterior")[d]) for d in range(len(domains))]).alias("mass"))
    rates = fit_rates(materialize(cells, "cells"), [targets[d] for d in domains], budget=budget, floor=floor)
    rates = materialize(rates.select("_mix_cell", F.col("rate").alias("_mix_rate")), "cell_rates")
    mixed = F.struct(F.col("_mix_tokens").alias("tokens"), F.col("_mix_posterior").alias("posterior"), F.col("_mix_rate").alias("rate"))
    return rows.join(sized(rates), "_mix_cell").select(*keep, mixed.alias("_mix"))


def copies(rate: Column, *row: Column) -> Column:
    """A rate as a whole number of copies, 0 included: its fraction is decided by a hash of what tells a row apart."""
    chance = F.pmod(F.xxhash64(*row, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def taken(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, floor: float = 0.0, budget: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any other columns), each as often as its rate says, with the columns they had.

    Rows are drawn by their id and text, so that null ids are drawn apart; rows that repeat both are drawn alike.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    mixed = mix(rows, labelled, targets, keep=["row"], floor=floor, budget=budget, sample=sample)
    times = copies(F.col("_mix.rate"), F.col("row.doc_id"), F.xxhash64("row.text"))
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
