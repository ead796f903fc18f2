"""A web server on this machine for queries and tests over the paged interfaces: it answers from small tables."""

from __future__ import annotations

import json
import threading
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit


class Answers:
    """``routes``: path -> function of (parameters, request) that gives a JSON value, text, or (status, headers, body). Names of headers are in lower case.

    The first ``failing`` requests of every path are answered with 503, as busy servers do.
    """

    def __init__(self, routes: dict[str, Callable], failing: int = 0):
        self.routes, self.failing = routes, failing
        self.asked: Counter[str] = Counter()
        self.posted: list = []
        self.url = ""

    def answer(self, method: str, target: str, headers: dict[str, str], body: bytes) -> tuple[int, dict[str, str], bytes]:
        parts = urlsplit(target)
        self.asked[parts.path] += 1
        if self.asked[parts.path] <= self.failing:
            return 503, {}, b""
        path = max((r for r in self.routes if parts.path.startswith(r)), key=len, default=None)
        if path is None:
            return 404, {}, b""
        if method == "POST":
            self.posted.append(json.loads(body))
        got = self.routes[path](dict(parse_qsl(parts.query)), {"path": parts.path, "method": method, "headers": {k.lower(): v for k, v in headers.items()}, "url": self.url})
        status, more, value = got if isinstance(got, tuple) else (200, {}, got)
        return status, more, value.encode() if isinstance(value, str) else json.dumps(value).encode()


@contextmanager
def served(routes: dict[str, Callable], failing: int = 0) -> Iterator[Answers]:
    answers = Answers(routes, failing)

    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, headers, value = answers.answer(self.command, self.path, dict(self.headers.items()), body)
            self.send_response(status)
            for k, v in (headers | {"Content-Length": str(len(value))}).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(value)

        do_GET = do_POST = do_HEAD = reply

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    answers.url = f"http://127.0.0.1:{server.server_port}"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield answers
    finally:
        server.shutdown()
        server.server_close()
