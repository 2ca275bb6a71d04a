"""The HTTP front: ingest, query, replay and health on the standard library's server."""

from __future__ import annotations

import json
import logging
import re
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from chronoweave.engine import Engine, as_json
from chronoweave.plans import hcl
from chronoweave.plans.spec import SpecError, query_from_json, replay_from_json
from chronoweave.streaming.batches import MicroBatcher

ROUTE = re.compile(r"/timelines/([^/]+)/(events|query|replay_query)")
log = logging.getLogger(__name__)


def respond(engine: Engine, method: str, path: str, body: bytes, content_type: str = "", batcher: MicroBatcher | None = None) -> tuple[int, dict[str, Any]]:
    """Status and JSON body of a request: 202 for ingest, 200 for results, 400 for what can't be read, 500 for what fails.

    With a batcher events are written some at a time, and what it holds is written before a query.
    """
    path = path.partition("?")[0]
    if path == "/health":
        return (200, {"status": "healthy", "time": datetime.now(timezone.utc).isoformat()}) if method == "GET" else (405, {"error": "method not allowed"})
    m = ROUTE.fullmatch(path)
    if not m:
        return 404, {"error": "not found"}
    if method != "POST":
        return 405, {"error": "method not allowed"}
    timeline_id, what = m.groups()
    try:
        text = body.decode()
        if what == "events":
            events = json.loads(text)
            if not isinstance(events, list) or not events:
                raise SpecError("events must be a JSON array with at least one event")
        else:
            kind = hcl.content_kind(text, content_type)
            read = {"query": (query_from_json, hcl.parse_query), "replay_query": (replay_from_json, hcl.parse_replay)}[what][kind == "hcl"]
            spec = read(text)
            spec.timeline_id = timeline_id
    except (ValueError, KeyError, TypeError) as e:
        return 400, {"error": str(e)}
    try:
        if what == "events":
            return 202, {"timeline_id": timeline_id, "status": "accepted", "event_count": batcher.add(timeline_id, events) if batcher else engine.ingest(timeline_id, events)}
        if batcher:
            batcher.flush("query")
        return 200, as_json(engine.query(spec) if what == "query" else engine.replay(spec), timeline_id)
    except Exception as e:
        log.exception("%s of %s failed", what, timeline_id)
        return 500, {"error": str(e).splitlines()[0] if str(e) else type(e).__name__}


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8080, batcher: MicroBatcher | None = None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = respond(engine, self.command, self.path, body, self.headers.get("Content-Type") or "", batcher)
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = answer

        def log_message(self, format: str, *args: Any) -> None:
            log.info(format, *args)

    return ThreadingHTTPServer((host, port), Handler)
