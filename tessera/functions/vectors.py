"""Column functions over vectors (arrays of numbers), in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def embedder(make: Callable[[], Callable[[list[str]], list]], *, batch: int = 32) -> Callable[[Column], Column]:
    """A column function of an injected model: unit vectors of texts, ``batch`` at a time; null for null.

    ``make`` loads the model, once in a worker and only when there is a text; it takes a list of texts.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for texts in batches:
            out: list[list[float] | None] = [None] * len(texts)
            some = [i for i, t in enumerate(texts) if t is not None]
            for lo in range(0, len(some), batch):
                model = model or make()
                part = some[lo : lo + batch]
                for i, v in zip(part, model([texts.iloc[j] for j in part]), strict=True):
                    held = np.asarray(v, float)
                    size = float(np.sqrt(held @ held))
                    out[i] = (held / size if size else held).tolist()
            yield pd.Series(out)

    return run


def scorer(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A column function of an injected reranker: a score of (query, text), without any prefix.  Loaded when first needed."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = None
        for queries, texts in batches:
            if len(queries):
                model = model or make()
            yield pd.Series([float(x) for x in model(list(zip(queries, texts, strict=True)))] if len(queries) else [], dtype="float64")

    return run
