"""Secret scans through a trigram inverted index.

A Boolean trigram query is derived from each rule's regex: literal stretches (with alternatives and optional
parts spelled out) must occur, so all trigrams of one of their spellings must.  Documents are indexed a block
at a time: postings of the trigrams that any rule names, over lower-cased text.  A rule's query intersects and
unites postings; the regex then verifies the candidates only.  A rule without a mandatory trigram scans
the block in full; if it is a run of one class of bytes, by run lengths over the bytes.
"""

from __future__ import annotations

import hashlib
import re
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Spellings of a literal stretch that are kept apart; beyond it, the stretch is cut.
SPELLINGS = 64


@dataclass(frozen=True)
class Rule:
    """What matches ``pattern`` and has ``least`` characters in ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base rules: fixed patterns of the contract, in its order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Public formats of other credentials, whose spans are added.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]{16,}", any_case=True),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"']{1,64}:[^\s/:@\"']{3,64}@"),
)
RULES = BASE + MORE

# A query is True (all documents), a trigram, or ("and" | "or", queries).


def _all_of(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _spelled(words: set[str]) -> object:
    """One of the spellings occurs: all trigrams of one of them do."""
    return _any_of([_all_of([w[i : i + 3] for i in range(len(w) - 2)]) for w in sorted(words)])


def _walk(nodes: parser.SubPattern) -> tuple[set[str] | None, object]:
    """The exact spellings of a sequence, if few, and the query of what it must contain."""
    queries: list = []
    stretch: set[str] | None = {""}
    exact = True
    for op, value in nodes:
        name = str(op)
        words, query = None, True
        if name == "LITERAL":
            words = {chr(value).lower()}
        elif name == "IN" and len(value) <= 8 and all(str(kind) == "LITERAL" for kind, _ in value):
            words = {chr(c).lower() for _, c in value}
        elif name == "SUBPATTERN":
            words, query = _walk(value[-1])
        elif name == "BRANCH":
            sides = [_walk(side) for side in value[1]]
            if all(w is not None for w, _ in sides):
                words = set().union(*(w for w, _ in sides))
            query = _any_of([q if w is None else _spelled(w) for w, q in sides])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            inside, inner_query = _walk(inner)
            if inside is not None and int(most) <= 1:
                words = inside | ({""} if least == 0 else set())
            elif least > 0:
                query = inner_query if inside is None else _spelled(inside)
        elif name == "AT":
            words = {""}
        joined = {a + b for a in stretch for b in words} if words is not None else None
        if joined is None or len(joined) > SPELLINGS:
            queries += [_spelled(stretch), query]
            stretch, exact = (words if joined is not None else {""}), False
        else:
            stretch = joined
    queries.append(_spelled(stretch))
    return (stretch if exact else None), _all_of(queries)


def trigram_query(rule: Rule) -> object:
    """What lower-cased text must hold for ``rule`` to match: True, a trigram, or ("and" | "or", queries)."""
    return _walk(parser.parse(rule.pattern))[1]


def _trigrams(query: object) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(_trigrams, query[1]))


def _byte_class(rule: Rule) -> np.ndarray | None:
    """The bytes of a pattern that is one repeated ASCII class, else None."""
    m = re.fullmatch(r"\[[^\]^\\]+\]\+", rule.pattern)
    return np.array([b < 128 and bool(re.fullmatch(rule.pattern, chr(b), re.ASCII)) for b in range(256)]) if m else None


class Index:
    """Postings over one block of texts: a row of bits for each trigram that a rule names."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.queries = [trigram_query(r) for r in rules]
        self.names = sorted({t for q in self.queries for t in _trigrams(q) if t.isascii()})
        self.number = np.zeros(1 << 24, np.uint8)
        for i, t in enumerate(self.names):
            a, b, c = t.encode()
            self.number[a << 16 | b << 8 | c] = i + 1
        if len(self.names) > 254:
            raise ValueError("rules name more than 254 trigrams")

    def post(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        low = K.LOWER[buf].astype(np.int32)
        bits = np.zeros((len(self.names) + 1, len(off) - 1), bool)
        if len(low) >= 3:
            found = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(found)
            doc = np.searchsorted(off, at, "right") - 1
            whole = at + 3 <= off[doc + 1]
            bits[found[at[whole]], doc[whole]] = True
        return bits[1:]

    def candidates(self, query: object, bits: np.ndarray) -> np.ndarray:
        if query is True or isinstance(query, str) and not query.isascii():
            return np.ones(bits.shape[1], bool)
        if isinstance(query, str):
            return bits[self.names.index(query)]
        sides = [self.candidates(q, bits) for q in query[1]]
        return np.logical_and.reduce(sides) if query[0] == "and" else np.logical_or.reduce(sides)


def _long_runs(buf: np.ndarray, off: np.ndarray, inside: np.ndarray, least: int) -> np.ndarray:
    """Documents with a run of at least ``least`` bytes of a class."""
    has = np.zeros(len(off) - 1, bool)
    into = np.zeros(len(buf) + 1, np.int8)
    into[:-1] = inside[buf]
    # a run begins where its class begins, and anew where a document does
    begins = np.flatnonzero((into[:-1] == 1) & (np.concatenate([[0], into[:-2]]) == 0)) if len(buf) else np.zeros(0, np.int64)
    firsts = off[1:-1][off[1:-1] < len(buf)]
    begins = np.union1d(begins, firsts[into[firsts] == 1])
    outside = np.flatnonzero(into == 0)
    ends = outside[np.searchsorted(outside, begins)]
    doc = np.searchsorted(off, begins, "right") - 1
    has[doc[np.minimum(ends, off[doc + 1]) - begins >= least]] = True
    return has


def find(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Spans of a rule, leftmost and not overlapping; failing matches are dropped after they were taken."""
    return [m.span() for m in rule.compiled().finditer(text) if len(m.group(rule.group)) >= rule.least]


def _scanned(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], base: int) -> Iterator[pa.RecordBatch]:
    index = Index(rules)
    classes = [_byte_class(r) if q is True else None for r, q in zip(rules, index.queries, strict=True)]
    compiled = [r.compiled() for r in rules]
    kinds = [r.kind for r in rules]
    for batch in batches:
        buf, off = K.binary_column(batch, "text")
        for lo, hi in K.slices(off):
            part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            bits = index.post(part, o)
            wanted = np.stack([index.candidates(q, bits) if c is None else _long_runs(part, o, c, r.least) for q, c, r in zip(index.queries, classes, rules, strict=True)])
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(hi - lo)]
            for d in np.flatnonzero(wanted.any(0)).tolist():
                text = part[o[d] : o[d + 1]].tobytes().decode()
                for k in np.flatnonzero(wanted[:, d]).tolist():
                    r = rules[k]
                    spans[d] += [(m.start(), k, m.end()) for m in compiled[k].finditer(text) if len(m.group(r.group)) >= r.least]
                spans[d].sort()
            said = [[f"{kinds[k]}:{a}:{b}" for a, k, b in s] for s in spans]
            ground = [[x for x, (_, k, _) in zip(t, s, strict=True) if k < base] for t, s in zip(said, spans, strict=True)]
            count = [pa.array([sum(k == i for _, k, _ in s) for s in spans], pa.int64()) for i in range(base)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), *count, pa.array([hashlib.sha256(",".join(t).encode()).hexdigest() for t in ground]), pa.array([",".join(t) for t in said])],
                names=["doc_id", *(f"n_{k}" for k in kinds[:base]), "base_sha256", "spans"],
            )


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, base: int = len(BASE)) -> DataFrame:
    """Secrets of every text of ``docs`` (doc_id, text; other columns are ignored), a row for each row.

    Returns doc_id, n_<kind> for each of the first ``base`` rules, base_sha256 (of their spans) and spans (of all rules).
    A span is kind:start:end in code points, end exclusive; spans are sorted by start, then by the order of the
    rules, and comma-joined.  A null or empty text has none: zeros, the digest of nothing, an empty string.
    """
    counts = ", ".join(f"n_{r.kind} long" for r in rules[:base])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _scanned(it, rules, base), f"doc_id long, {counts}, base_sha256 string, spans string")
