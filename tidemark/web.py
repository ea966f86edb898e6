"""HTTP service: a page, health, new conversations and questions, with answers streamed as they come."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from tidemark.plans.service import Service

PAGE = """<!doctype html><meta charset="utf-8"><title>tidemark</title>
<form id="f"><input id="q" size="60" autofocus><button>Ask</button></form><pre id="a"></pre>
<script>
let id = null;
f.onsubmit = async e => {
  e.preventDefault();
  id ??= (await (await fetch("/conversation/new", {method: "POST"})).json()).conversation_id;
  const r = await fetch("/ask", {method: "POST", body: JSON.stringify({query: q.value, conversation_id: id})});
  const read = r.body.getReader(), text = new TextDecoder();
  a.textContent = "";
  for (let p; !(p = await read.read()).done;) a.textContent += text.decode(p.value, {stream: true});
};
</script>"""


def server(service: Service, host: str = "127.0.0.1", port: int = 8000, public: str | None = None) -> ThreadingHTTPServer:
    """A server that is not started yet. Files below public are served at /public/."""

    class Handler(BaseHTTPRequestHandler):
        def say(self, code: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            if self.path == "/":
                return self.say(200, PAGE.encode(), "text/html")
            if self.path == "/health":
                return self.say(200, b'{"status": "ok"}')
            if public and self.path.startswith("/public/"):
                root = Path(public).resolve()
                found = (root / self.path.removeprefix("/public/")).resolve()
                if found.is_relative_to(root) and found.is_file():
                    return self.say(200, found.read_bytes(), "text/plain")
            return self.say(404, b'{"detail": "not found"}')

        def do_POST(self) -> None:
            if self.path == "/conversation/new":
                return self.say(200, json.dumps({"conversation_id": service.new_conversation()}).encode())
            if self.path != "/ask":
                return self.say(404, b'{"detail": "not found"}')
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                query, conv_id = asked["query"], asked["conversation_id"]
            except (ValueError, KeyError, TypeError):
                return self.say(422, b'{"detail": "query and conversation_id are needed"}')
            self.send_response(200)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.end_headers()  # the end of the connection ends the answer
            for piece in service.ask(query, conv_id):
                self.wfile.write(piece.encode())
                self.wfile.flush()

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
