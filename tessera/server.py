"""HTTP with JSON over one engine, by the standard library's server.

Requests that read run as they come; those that write run one after the other in the background
and answer 202 with a job, whose events `/jobs/<id>` tells.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import functions as F

from tessera.__main__ import plain
from tessera.config import DEFAULT_DATABASE
from tessera.engine import Engine
from tessera.operators import readouts as R
from tessera.streaming.progress import Jobs


class Background:
    """Writes, one at a time and in order; each is a job with its events."""

    def __init__(self) -> None:
        self.jobs, self.pool = Jobs(), ThreadPoolExecutor(1)

    def submit(self, kind: str, f: Callable[[], object]) -> str:
        job = f"{kind}-{uuid.uuid4().hex[:12]}"
        self.jobs.emit(job, "start", time.time(), total=1)

        def work() -> None:
            try:
                self.jobs.emit(job, "done", time.time(), result=plain(f()))
            except Exception as e:
                self.jobs.emit(job, "error", time.time(), error=f"{type(e).__name__}: {e}")

        self.pool.submit(work)
        return job


class Api:
    """(status, body) of each request, apart from any transport."""

    def __init__(self, engine: Engine) -> None:
        self.e, self.work = engine, Background()

    def call(self, method: str, path: str, query: dict[str, str], body: dict) -> tuple[int, object]:
        parts = [unquote(x) for x in path.strip("/").split("/")]
        db = query.get("database") or body.get("database") or DEFAULT_DATABASE
        try:
            found = self._get(parts, query, db) if method == "GET" else self._post(parts, body, db) if method == "POST" else self._delete(parts) if method == "DELETE" else None
        except (KeyError, TypeError) as e:
            return 400, {"error": f"missing or wrong: {e}"}
        except LookupError as e:
            return 404, {"error": str(e)}
        except ValueError as e:
            return 400, {"error": str(e)}
        return found or (404, {"error": f"no {method} {path}"})

    def _get(self, parts: list[str], q: dict[str, str], db: str) -> tuple[int, object] | None:
        e = self.e
        limit = R.clamp_limit(int(q.get("limit", 50)), 1, 200)
        chunks = lambda: e.table("chunks").where(F.col("database_id") == db)
        reads = {
            "health": lambda: {"ok": True},
            "stats": e.stats,
            "databases": e.list_databases,
            "chunks": lambda: R.chunk_listing(e.table("chunks").drop("v"), db, q.get("search"), q.get("source"), limit, max(0, int(q.get("offset", 0)))),
            "concepts": lambda: e.table("concepts").where(F.col("database_id") == db).drop("v").orderBy("concept_id").limit(limit),
            "sources": lambda: R.top_sources(chunks(), limit),
            "recent": lambda: R.recent_chunks(chunks(), limit),
            "ingests": lambda: e.table("ingest_events").where(F.col("database_id") == db).orderBy(F.desc("timestamp")).limit(limit),
        }
        if parts[0] == "jobs" and len(parts) == 2:
            events = self.work.jobs.replay(parts[1])
            return (200, events) if events else (404, {"error": f"no job {parts[1]}"})
        return (200, plain(reads[parts[0]]())) if len(parts) == 1 and parts[0] in reads else None

    def _post(self, parts: list[str], b: dict, db: str) -> tuple[int, object] | None:
        e = self.e
        now = {
            "retrieve": lambda: e.retrieve([b["text"]], db, int(b.get("top", 20)), int(b.get("hops", 2)), b.get("relationships")),
            "query": lambda: e.query_answer(b["text"], db),
            "overview": lambda: {k: v for k, v in e.audio_overview(b["text"], db, b.get("form", "dialogue")).items() if k != "sound"},
            "databases": lambda: {"id": e.create_database(b["name"], b.get("description"))},
        }
        later = {
            "ingest": lambda: e.ingest_text(b["source"], b["text"], db, tags=b.get("tags")) if "text" in b else e.ingest(b["folder"], db, tags=b.get("tags")),
            "consolidate": lambda: e.consolidate(db),
            "classify": lambda: e.classify(b.get("limit")),
            "sync": e.sync_concepts,
            "benchmark": lambda: e.benchmark(db),
        }
        if len(parts) != 1:
            return None
        if parts[0] in now:
            return 200, plain(now[parts[0]]())
        if parts[0] in later:
            if parts[0] == "ingest" and not ("folder" in b or "source" in b and "text" in b):
                raise KeyError("folder, or source and text")
            return 202, {"job": self.work.submit(parts[0], later[parts[0]])}
        return None

    def _delete(self, parts: list[str]) -> tuple[int, object] | None:
        if len(parts) == 2 and parts[0] == "databases":
            self.e.delete_database(parts[1])
            return 200, {"deleted": parts[1]}
        return None


def serve(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server over an engine; call `serve_forever`."""
    api = Api(engine)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            url = urlsplit(self.path)
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw) if raw else {}
            except ValueError:
                body = None
            status, out = api.call(self.command, url.path, dict(parse_qsl(url.query)), body) if isinstance(body, dict) else (400, {"error": "the body is no JSON object"})
            data = json.dumps(out, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer  # noqa: N815

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
