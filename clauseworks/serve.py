"""A local HTTP service over an index: status, search, indexing in the background."""

from __future__ import annotations

import hmac
import json
import os
import secrets
import subprocess
import sys
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .functions.embedding import Embedder
from .operators.chunking import ChunkConfig
from .plans import index as plan

MOST_HITS = 100


class Refused(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


@dataclass
class Job:
    state: str = "idle"
    stage: str = ""
    total: int = 0
    began: float = 0.0
    message: str = ""
    skipped: list[tuple[str, str]] = field(default_factory=list)


class Service:
    """What the service does, apart from HTTP; one indexing job at a time."""

    def __init__(self, spark: SparkSession, index_dir: str, embedder: Embedder, config: ChunkConfig) -> None:
        self.spark, self.index_dir, self.embedder, self.config = spark, index_dir, embedder, config
        self.lock, self.job = threading.Lock(), Job()
        self.index: plan.Index | None = None
        self.reason = ""
        self.opener: Callable[[str], None] = open_file
        self._open()

    def _open(self) -> None:
        try:
            self.index, self.reason = plan.Index(self.spark, self.index_dir, self.embedder, self.config), ""
        except plan.IndexFault as e:
            self.index, self.reason = None, str(e)

    def status(self) -> dict[str, Any]:
        if self.index is None:
            return {"ready": False, "reason": self.reason}
        return {"ready": True, "documents": self.index.meta["documents"], "chunks": self.index.meta["chunks"], "source": self.index.meta["source"]}

    def search(self, query: str, k: int = 10) -> dict[str, Any]:
        if not query.strip():
            raise Refused(400, "empty query")
        with self.lock:
            if self.index is None:
                raise Refused(409, self.reason or "no index")
            rows, seconds = self.index.search(query, max(1, min(k, MOST_HITS)))
            hits = [{"rank": r["rank"], "score": r.score, "chunk": r.id, "file": Path(r.path).name, "folder": str(Path(r.path).parent), "page": r.page, "char_start": r.char_start, "char_end": r.char_end, "text": r.text} for r in rows.collect()]
        return {"hits": hits, "encode_ms": seconds["encode"] * 1000, "scan_ms": seconds["scan"] * 1000}

    def open(self, chunk: int) -> dict[str, Any]:
        """Opens the file of a chunk on this machine; files are named by a chunk's id only, never by a path."""
        with self.lock:
            if self.index is None:
                raise Refused(409, self.reason or "no index")
            found = self.index.chunk(chunk)
            path = self.index.document(found.doc_id).path if found else None
        if path is None:
            raise Refused(404, "no such chunk")
        if not Path(path).is_file():
            raise Refused(410, "the file is gone")
        self.opener(path)
        return {"opened": Path(path).name}

    def start(self, folder: str | None = None) -> dict[str, Any]:
        """Indexes a folder, or again the one that the index records."""
        with self.lock:
            if self.job.state == "running":
                raise Refused(409, "an indexing job is running")
            source = folder or (self.index.meta["source"] if self.index else None)
            if not source:
                raise Refused(409, "no index and no folder")
            self.index, self.reason = None, "indexing"
            self.job = Job("running", began=time.time())
        threading.Thread(target=self._build, args=(source,), daemon=True).start()
        return {"started": source}

    def _build(self, source: str) -> None:
        def progress(stage: str, total: int) -> None:
            self.job.stage, self.job.total = stage, total

        try:
            done = plan.build(self.spark, source, self.index_dir, self.embedder, self.config, progress)
            message, state = f"{done.documents} documents, {done.chunks} chunks", "done"
            self.job.skipped = done.skipped
        except Exception as e:  # noqa: BLE001 - the job's fault is its result
            message, state = str(e), "failed"
        with self.lock:
            self._open()
            self.job.message, self.job.state = message, state

    def job_status(self) -> dict[str, Any]:
        j = self.job
        return {"state": j.state, "stage": j.stage, "total": j.total, "seconds": time.time() - j.began if j.began else 0.0, "message": j.message, "skipped": [{"path": p, "reason": r} for p, r in j.skipped]}


def open_file(path: str) -> None:
    """Hands a file to the program that the system uses for it."""
    if hasattr(os, "startfile"):
        os.startfile(path)
    else:
        subprocess.Popen(["open" if sys.platform == "darwin" else "xdg-open", path], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)


def allowed(headers: Any, token: str, port: int) -> bool:
    """Whether a request names this host and carries the token."""
    host = headers.get("Host", "")
    return host in (f"127.0.0.1:{port}", f"localhost:{port}") and hmac.compare_digest(headers.get("Authorization", "").removeprefix("Bearer ").encode(), token.encode())


def serve(service: Service, port: int) -> tuple[ThreadingHTTPServer, str]:
    """A server bound to this machine only, and the token that requests need."""
    token = secrets.token_hex(16)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict[str, Any]) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _handle(self, routes: dict[str, Any]) -> None:
            if not allowed(self.headers, token, self.server.server_address[1]):
                return self._answer(403, {"error": "forbidden"})
            if self.path not in routes:
                return self._answer(404, {"error": "not found"})
            try:
                size = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(size)) if size else {}
                self._answer(200, routes[self.path](body))
            except Refused as e:
                self._answer(e.status, {"error": str(e)})
            except (ValueError, TypeError, AttributeError, KeyError) as e:
                self._answer(400, {"error": str(e)})

        def do_GET(self) -> None:  # noqa: N802
            self._handle({"/api/status": lambda _: service.status(), "/api/index/status": lambda _: service.job_status()})

        def do_POST(self) -> None:  # noqa: N802
            self._handle({"/api/search": lambda b: service.search(str(b.get("query", "")), int(b.get("k", 10))), "/api/index": lambda b: service.start(b.get("folder")), "/api/open": lambda b: service.open(int(b["chunk"]))})

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler), token
