"""Subword token offsets by a tokenizer file: an Arrow-batched column function, loaded once for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def offsets(path: str) -> Callable[[Column], Column]:
    """A function of a text column: array<struct<start, end>> of its tokens in code points, without special tokens and
    without tokens of no width; none for null."""

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for texts in batches:
            found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            yield pd.Series([[{"start": a, "end": b} for a, b in e.offsets if b > a] for e in found])

    return run
