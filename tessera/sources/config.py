"""Settings: corpus, chunking, retrieval, generation and the golden set, validated on the driver."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T

STRATEGIES = ("fixed", "structural", "semantic")
#: Items that are parsed and may be cited.
ITEMS = ("1A", "7", "7A")
QUESTION_TYPES = ("single_hop", "temporal", "within_sector", "cross_sector", "unanswerable")


def _yaml(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def ticker_key(name: object) -> str:
    return str(name).strip().upper()


@dataclass(frozen=True)
class Corpus:
    """What a run is about.  ``companies``: by ticker, in the order of the file, (cik of ten digits, sector)."""

    form_types: list[str]
    fiscal_years: list[int]
    items: list[str]
    companies: dict[str, tuple[str, str]]

    def tickers(self, wanted: Iterable[str] | None = None) -> list[str]:
        """The tickers asked for, or all; one that isn't in the corpus is a KeyError."""
        keys = [ticker_key(w) for w in wanted or ()] or list(self.companies)
        unknown = sorted(set(keys) - self.companies.keys())
        if unknown:
            raise KeyError(f"not in the corpus: {', '.join(unknown)}")
        return keys

    def years(self, wanted: list[int] | None = None) -> list[int]:
        unknown = [y for y in wanted or () if y not in self.fiscal_years]
        if unknown:
            raise ValueError(f"years not in the corpus: {unknown}")
        return list(wanted) if wanted else list(self.fiscal_years)

    def frame(self, spark: SparkSession) -> DataFrame:
        """What should be found: a row for each company and year."""
        rows = [(t, cik, sector, y) for t, (cik, sector) in self.companies.items() for y in self.fiscal_years]
        return spark.createDataFrame(rows, "ticker string, cik string, sector string, fiscal_year int")


def load_corpus(path: str | Path) -> Corpus:
    raw = _yaml(path)
    companies = {ticker_key(c["ticker"]): (f"{str(c['cik']).strip():0>10}", c.get("sector") or "") for c in raw["companies"]}
    if not companies:
        raise ValueError("a corpus needs a company")
    return Corpus(list(raw["form_types"]), [int(y) for y in raw["fiscal_years"]], [ticker_key(i) for i in raw["items"]], companies)


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    size: int = 400
    overlap: int = 80
    max_header_chars: int = T.MAX_HEADER_CHARS
    breakpoint_percentile: int = 95

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and below the window size")
        if self.size > self.max_tokens:
            raise ValueError("window size must not exceed max_tokens")
        if not 0 <= self.breakpoint_percentile <= 100:
            raise ValueError("percentile must be in 0..100")


def load_chunking(path: str | Path) -> Chunking:
    raw = _yaml(path)
    fixed, structural, semantic = raw.get("fixed") or {}, raw.get("structural") or {}, raw.get("semantic") or {}
    given = {"max_tokens": raw.get("max_tokens"), "size": fixed.get("size"), "overlap": fixed.get("overlap"), "max_header_chars": structural.get("max_header_chars"), "breakpoint_percentile": semantic.get("breakpoint_percentile")}
    return Chunking(**{k: int(v) for k, v in given.items() if v is not None})


@dataclass(frozen=True)
class Retrieval:
    k: int = 5
    candidate_k: int = 50
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    query_prefix: str = T.QUERY_PREFIX

    def __post_init__(self) -> None:
        if self.k < 1 or self.candidate_k < self.k or self.rrf_k < 1:
            raise ValueError("k must be at least 1 and candidate_k at least k")
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must be at least 0 and b in 0..1")


def load_retrieval(path: str | Path) -> Retrieval:
    raw = _yaml(path)
    bm25 = raw.pop("bm25", None) or {}
    known = {k: raw[k] for k in ("k", "candidate_k", "rrf_k", "query_prefix") if k in raw}
    return Retrieval(**known, **{k: float(bm25[k]) for k in ("k1", "b") if k in bm25})


@dataclass(frozen=True)
class Question:
    id: str
    type: str
    query: str
    answerable: bool = True
    answer: str = ""
    citations: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.type not in QUESTION_TYPES:
            raise ValueError(f"{self.id}: unknown type {self.type!r}")
        if self.answerable != bool(self.citations):
            raise ValueError(f"{self.id}: answerable questions have citations, others none")


def load_golden(path: str | Path, *, items: Iterable[str] = ITEMS, texts: Mapping[tuple[str, str], str] | None = None) -> list[Question]:
    """The questions of a YAML file, none for an empty one: ids occur once, cited items are known and, with ``texts`` (by accession
    and item), quotes stand in their section."""
    questions = [Question(**q) for q in _yaml(path).get("questions") or []]
    twice = sorted(i for i, n in Counter(q.id for q in questions).items() if n > 1)
    if twice:
        raise ValueError(f"question ids are not unique: {twice}")
    known = {ticker_key(i) for i in items}
    for q in questions:
        for c in q.citations:
            place = c["accession"], ticker_key(c["item_code"])
            if place[1] not in known:
                raise ValueError(f"{q.id}: unknown item {place[1]!r}")
            if texts is not None and c["quote"] not in texts.get(place, ""):
                raise ValueError(f"{q.id}: quote is not in {place[0]} item {place[1]}")
    return questions


def citations(spark: SparkSession, questions: list[Question]) -> DataFrame:
    rows = [(q.id, c["accession"], ticker_key(c["item_code"]), c["quote"]) for q in questions for c in q.citations]
    return spark.createDataFrame(rows, "question_id string, accession string, item_code string, quote string")


def question_frame(spark: SparkSession, questions: list[Question]) -> DataFrame:
    """(qid, position, question_id, type, text, answerable, answer) in the order of the file."""
    rows = [(i, i, q.id, q.type, q.query, q.answerable, q.answer) for i, q in enumerate(questions)]
    return spark.createDataFrame(rows, "qid long, position int, question_id string, type string, text string, answerable boolean, answer string")


def resolve(names: list[str] | None, known: tuple[str, ...], what: str) -> list[str]:
    """Trimmed, lower-cased names without repetition, in order; all known ones if none is given; unknown ones raise."""
    out = list(dict.fromkeys(n.strip().lower() for n in names or known))
    unknown = [n for n in out if n not in known]
    if unknown:
        raise ValueError(f"unknown {what}: {', '.join(unknown)}. Known: {', '.join(known)}")
    return out


def read_env(path: str | Path) -> dict[str, str]:
    """NAME=value lines of a file, quotes around a value dropped; a missing file has none."""
    path = Path(path)
    lines = path.read_text(encoding="utf-8").splitlines() if path.exists() else []
    pairs = (line.split("=", 1) for line in map(str.strip, lines) if "=" in line and not line.startswith("#"))
    return {name.removeprefix("export ").strip(): value.strip().strip("\"'") for name, value in pairs}


@dataclass(frozen=True)
class Settings:
    """Paths and keys; folders lie below ``data_dir`` unless they are absolute.  ``require`` raises on a blank one."""

    data_dir: str = "data"
    results_dir: str = "results"
    config_dir: str = "config"
    user_agent: str = ""
    api_key: str = ""

    @classmethod
    def load(cls, env_file: str | Path = ".env") -> Settings:
        """From TESSERA_* of the environment, else of ``env_file``."""
        held = {**read_env(env_file), **os.environ}
        return cls(**{f.name: held[f"TESSERA_{f.name.upper()}"] for f in fields(cls) if f"TESSERA_{f.name.upper()}" in held})

    def path(self, *parts: str) -> str:
        return "/".join([self.data_dir.rstrip("/"), *parts])

    def result(self, name: str) -> str:
        return f"{self.results_dir.rstrip('/')}/{name}"

    def require(self, name: str) -> str:
        value = getattr(self, name)
        if not value.strip():
            raise RuntimeError(f"TESSERA_{name.upper()} must be set")
        return value

    raw = property(lambda self: self.path("raw"))
    parsed = property(lambda self: self.path("parsed"))
    chunks = property(lambda self: self.path("chunks"))
    index = property(lambda self: self.path("index"))
