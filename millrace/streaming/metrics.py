"""Counters and gauges of each pipeline, as Prometheus text."""

from __future__ import annotations

import http.server
import threading
import time
from collections.abc import Callable

PREFIX = "millrace"

#: name -> (kind, help)
SERIES: dict[str, tuple[str, str]] = {
    "batches_committed": ("counter", "Batches committed."),
    "rows_written": ("counter", "Rows written to the target."),
    "files_read": ("counter", "Source files read."),
    "errors": ("counter", "Steps that failed."),
    "commits_skipped": ("counter", "Source commits without rows to read."),
    "last_source_version": ("gauge", "Newest source version that is committed."),
    "source_head_version": ("gauge", "Newest source version at the last look."),
    "source_lag_versions": ("gauge", "Source versions not read yet."),
    "pipeline_up": ("gauge", "1 while the pipeline runs."),
    "pipeline_config_valid": ("gauge", "1 if its settings can work."),
    "pipeline_seconds_since_progress": ("gauge", "Seconds since the last commit."),
    "source_file_vacuumed": ("gauge", "1 while a source file that is needed is gone."),
    "pipeline_restarts": ("counter", "Starts after a failure."),
    "rows_rejected": ("counter", "Rows set aside as not fitting."),
    "batches_fully_rejected": ("counter", "Batches of which no row fitted."),
    "upsert_rows_updated": ("counter", "Rows that upserts changed."),
    "upsert_rows_inserted": ("counter", "Rows that upserts added."),
    "upsert_target_files_scanned": ("counter", "Target files that upserts looked into."),
    "upsert_window_unbounded": ("counter", "Merges for which a file had no statistics."),
    "upsert_window_clamped": ("counter", "Merges that the lookback cut short."),
    "merges": ("counter", "Merges."),
    "merge_milliseconds": ("counter", "Time in merges."),
    "merge_queue_milliseconds": ("counter", "Time waiting to merge."),
    "publish_sent": ("counter", "Messages accepted."),
    "publish_failed": ("counter", "Messages that failed."),
    "publish_skipped": ("counter", "Messages left out while the breaker is open."),
    "publish_truncated": ("counter", "Messages too large to carry their rows."),
    "publish_rows": ("counter", "Rows sent in messages."),
    "publish_bytes": ("counter", "Bytes sent in messages."),
    "capacity_exhausted": ("gauge", "1 while memory or disk has run out."),
    "grain_check_passes": ("gauge", "Passes of the last uniqueness check; 0 where it is off."),
    "publish_configured": ("gauge", "1 if the pipeline publishes."),
}


class Metrics:
    def __init__(self, pipeline: str, clock: Callable[[], float] = time.time):
        self.pipeline, self.clock = pipeline, clock
        self.values = dict.fromkeys(SERIES, 0)
        self.values |= {"last_source_version": -1, "source_head_version": -1, "pipeline_config_valid": 1}
        self.progressed_at = clock()
        self._lock = threading.Lock()

    def add(self, **more: int) -> None:
        with self._lock:
            for k, v in more.items():
                self.values[k] += v

    def set(self, progressed_at: float | None = None, **to: int) -> None:
        with self._lock:
            if progressed_at is not None:
                self.progressed_at = progressed_at
            for k, v in to.items():
                if k not in SERIES:
                    raise KeyError(k)
                self.values[k] = v

    def published(self, stats) -> None:
        self.add(publish_sent=int(stats.sent), publish_failed=int(stats.failed), publish_skipped=int(stats.skipped), publish_truncated=int(stats.truncated), publish_rows=stats.rows, publish_bytes=stats.bytes)

    def read(self) -> dict[str, int]:
        with self._lock:
            return self.values | {"pipeline_seconds_since_progress": max(0, int(self.clock() - self.progressed_at))}


def text(all_metrics: list[Metrics], process: dict[str, int] | None = None) -> str:
    """The page: a block a series, a line a pipeline; then what holds for the process."""
    out: list[str] = []
    read = [(m.pipeline.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n"), m.read()) for m in all_metrics]
    for name, (kind, said) in SERIES.items():
        full = f"{PREFIX}_{name}" + ("_total" if kind == "counter" else "")
        out += [f"# HELP {full} {said}", f"# TYPE {full} {kind}", *(f'{full}{{pipeline="{p}"}} {v[name]}' for p, v in read)]
    for name, value in (process or {}).items():
        out += [f"# TYPE {PREFIX}_{name} gauge", f"{PREFIX}_{name} {value}"]
    return "\n".join(out) + "\n"


def serve(address: str, page: Callable[[], str]) -> http.server.ThreadingHTTPServer:
    """/metrics on host:port, in a thread; port 0 takes a free one."""
    host, _, port = address.rpartition(":")

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            found = self.path.split("?")[0] in ("/", "/metrics")
            body = page().encode() if found else b"not found\n"
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer((host or "127.0.0.1", int(port)), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
