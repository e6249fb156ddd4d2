"""The read queries over HTTP: one JSON request per call, a health check, a bearer token, a host list.

Standard library only. ``POST /call/<name>`` with a JSON object of arguments answers as the functions
of ``api.Service`` do; ``GET /healthz`` needs no token. Every call reads the store's latest commit,
so a run that commits meanwhile is seen by the next call.
"""

from __future__ import annotations

import hmac
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .api import NotFound, Service

CALLS = ("get_document", "search", "get_chapter_outline", "get_cross_references", "list_changes", "lookup_public_act", "data_status")
MAX_BODY = 1 << 20


def build(service: Service, host: str = "127.0.0.1", port: int = 8000, token: str | None = None, hosts: list[str] | None = None) -> ThreadingHTTPServer:
    """A server that is not started yet. ``token``: what callers must bear; ``hosts``: the names they
    may call it by, any if none is given."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict, **headers: str) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            for k, v in ({"Content-Type": "application/json", "Content-Length": str(len(data))} | {k.replace("_", "-"): v for k, v in headers.items()}).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def _known_host(self) -> bool:
            name = (self.headers.get("Host") or "").rsplit(":", 1)[0]
            if not hosts or name in hosts or (self.headers.get("Host") or "") in hosts:
                return True
            self._answer(421, {"error": "unknown host"})
            return False

        def do_GET(self) -> None:  # noqa: N802
            if not self._known_host():
                return
            if self.path != "/healthz":
                return self._answer(404, {"error": "no such path"})
            try:
                service.data_status()
            except Exception as e:  # noqa: BLE001
                return self._answer(503, {"error": f"store: {e}"})
            self._answer(200, {"status": "ok"})

        def do_POST(self) -> None:  # noqa: N802
            if not self._known_host():
                return
            if token and not hmac.compare_digest((self.headers.get("Authorization") or "").encode(), f"Bearer {token}".encode()):
                return self._answer(401, {"error": "unauthorized"}, WWW_Authenticate="Bearer")
            name = self.path.removeprefix("/call/")
            if name not in CALLS:
                return self._answer(404, {"error": f"no such call; known: {', '.join(CALLS)}"})
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > MAX_BODY:
                    return self._answer(413, {"error": "too long"})
                args = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(args, dict):
                    raise ValueError("arguments are an object")
                self._answer(200, getattr(service, name)(**args))
            except NotFound as e:
                self._answer(404, {"error": str(e)})
            except (ValueError, TypeError) as e:
                self._answer(400, {"error": str(e)})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
