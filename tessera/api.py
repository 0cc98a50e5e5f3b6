"""HTTP: a WSGI application with GET /healthz, GET /configs and POST /query.

Empty filter lists of a request are unrestricted.  Bad input is a 400, a failing backend a 503; a query's answer is a
stream of server-sent events whose first is pulled before the response begins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

from .operators.generation import Event
from .operators.retrieval import MODES
from .sources.config import STRATEGIES

FILTERS = {"tickers": "ticker", "fiscal_years": "fiscal_year", "item_codes": "item_code"}


def parse(body: bytes) -> dict:
    """A validated request; ValueError says what is wrong."""
    try:
        raw = json.loads(body or b"{}")
    except json.JSONDecodeError as e:
        raise ValueError("body is not JSON") from e
    if not isinstance(raw, dict) or not str(raw.get("query") or "").strip():
        raise ValueError("query must be non-empty")
    strategy, mode, k = str(raw.get("strategy", "fixed")).strip().lower(), str(raw.get("mode", "hybrid")).strip().lower(), raw.get("k")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if k is not None and (not isinstance(k, int) or isinstance(k, bool) or k < 1):
        raise ValueError("k must be at least 1")
    return {"query": raw["query"].strip(), "strategy": strategy, "mode": mode, "rerank": bool(raw.get("rerank", False)), "k": k, "filters": {column: raw[name] for name, column in FILTERS.items() if raw.get(name)}}


def application(ask: Callable[[dict], Iterator[Event]], ping: Callable[[], None] = lambda: None) -> Callable[[dict, Callable], Iterable[bytes]]:
    """The application over ``ask`` (request -> events) and ``ping``, which raises if the backend is away."""

    def app(env: dict, start: Callable) -> Iterable[bytes]:
        def reply(status: str, payload: dict) -> list[bytes]:
            start(status, [("Content-Type", "application/json")])
            return [json.dumps(payload).encode()]

        route = (env.get("REQUEST_METHOD"), env.get("PATH_INFO"))
        if route == ("GET", "/healthz"):
            try:
                ping()
            except Exception as e:  # noqa: BLE001
                return reply("503 Service Unavailable", {"status": "unavailable", "detail": str(e)})
            return reply("200 OK", {"status": "ok"})
        if route == ("GET", "/configs"):
            return reply("200 OK", {"strategies": list(STRATEGIES), "modes": list(MODES), "rerank": [False, True]})
        if route != ("POST", "/query"):
            return reply("404 Not Found", {"detail": "not found"})
        try:
            request = parse(env["wsgi.input"].read(int(env.get("CONTENT_LENGTH") or 0)))
        except ValueError as e:
            return reply("400 Bad Request", {"detail": str(e)})
        try:
            events = iter(ask(request))
            first = next(events)
        except ValueError as e:
            return reply("400 Bad Request", {"detail": str(e)})
        except Exception as e:  # noqa: BLE001
            return reply("503 Service Unavailable", {"detail": str(e)})
        start("200 OK", [("Content-Type", "text/event-stream")])

        def stream() -> Iterator[bytes]:
            try:
                for event in chain([first], events):
                    yield event.sse().encode()
            except Exception as e:  # noqa: BLE001
                yield Event("error", {"detail": str(e)}).sse().encode()

        return stream()

    return app
