"""A thin HTTP adapter on the standard library: health, search, and the documents themselves."""

from __future__ import annotations

import json
import os
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlparse

from .engine import Engine
from .plans.search import served_path


def handler(engine: Engine, data_root: str = "data"):
    # Documents are served from where they are, under the name that results have for them; else the data folder.
    documents, mount = engine.settings.documents, engine.settings.served_as.removeprefix(".").rstrip("/") + "/"

    def located(path: str) -> str | None:
        if path.startswith(mount) and (file := served_path(os.path.abspath(documents), path.removeprefix(mount))) and os.path.isfile(file):
            return file
        return served_path(os.path.abspath(data_root), path.removeprefix("/data/")) if path.startswith("/data/") else None

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: bytes, kind: str = "application/json; charset=utf-8") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _json(self, status: int, value: dict) -> None:
            self._send(status, json.dumps(value, ensure_ascii=False).encode())

        def do_GET(self) -> None:
            path = unquote(urlparse(self.path).path)
            if path == "/health":
                return self._json(200, {"status": "ok"})
            file = located(path)
            if file and os.path.isfile(file):
                with open(file, "rb") as f:
                    return self._send(200, f.read(), "application/pdf" if file.lower().endswith(".pdf") else "application/octet-stream")
            return self._json(404, {"detail": "Not Found"})

        def do_POST(self) -> None:
            if urlparse(self.path).path != "/api/search":
                return self._json(404, {"detail": "Not Found"})
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"null")
                if not isinstance(request, dict):
                    raise ValueError("the request must be an object")
                query, top_k = request.get("query"), request.get("top_k", 3)
                response = engine.api_search(query, top_k)
            except ValueError as e:
                return self._json(422, {"detail": str(e)})
            except Exception as e:
                return self._json(500, {"detail": str(e)})
            return self._json(200, response)

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(engine: Engine, port: int = 8000, data_root: str = "data") -> None:
    ThreadingHTTPServer(("", port), handler(engine, data_root)).serve_forever()
