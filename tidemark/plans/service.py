"""Requests to a script's tables and functions, and an HTTP endpoint for them."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, urlsplit

from ..operators.paging import PAGE_SIZE
from .engine import Engine
from .tokens import ScriptError


class Service:
    """Answers requests by name. Results of tables and functions with the hint ``cache`` are kept for as long as it says."""

    def __init__(self, engine: Engine, max_page: int = 1000):
        self.engine, self.max_page = engine, max_page
        self._cache: dict[tuple, tuple[float, list[dict]]] = {}

    def request(self, name: str, args: Mapping[str, Any] | None = None, limit: int = PAGE_SIZE, offset: int = 0, auth: Mapping[str, Any] | None = None) -> list[dict]:
        args = dict(args or {})
        if not 0 < limit <= self.max_page or offset < 0:
            raise ScriptError(f"limit must be 1 to {self.max_page}, and offset not negative")
        shown = {n.lower() for n in self.engine.catalog()}
        if name.lower() not in shown:
            raise ScriptError(f"{name} is not defined")
        hints = (self.engine.functions.get(name.lower()) or self.engine.tables[name.lower()]).hints
        keep = hints.seconds("cache")
        key = (name.lower(), json.dumps(args, sort_keys=True, default=str), limit, offset, json.dumps(auth, sort_keys=True, default=str))
        now = time.monotonic()
        if keep and key in self._cache and self._cache[key][0] > now:
            return self._cache[key][1]
        f = self.engine.functions.get(name.lower())
        if f is not None and f.parent is not None:
            rows = self.engine.relationship(name, auth=auth, **args).offset(offset).limit(limit)
        else:
            rows = self.engine.query(name, limit, offset, auth, **args)
        out = [json.loads(x) for x in rows.toJSON().collect()]
        if keep:
            self._cache = {k: v for k, v in self._cache.items() if v[0] > now} | {key: (now + keep, out)}
        return out


def serve(service: Service, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """``GET /name?argument=value&limit=&offset=`` answers with JSON rows, ``GET /`` with the catalog. The caller starts and stops it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            args = dict(parse_qsl(url.query))
            try:
                if url.path == "/":
                    code, body = 200, service.engine.catalog()
                else:
                    limit, offset = int(args.pop("limit", PAGE_SIZE)), int(args.pop("offset", 0))
                    code, body = 200, service.request(url.path.strip("/"), args, limit, offset)
            except PermissionError as e:
                code, body = 403, {"error": str(e)}
            except (ScriptError, ValueError) as e:
                code, body = 400, {"error": str(e)}
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
