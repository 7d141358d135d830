"""Progress of jobs: snapshots by job with replay, the last finished jobs kept, rates over the last completions."""

from __future__ import annotations

import threading
from collections import OrderedDict, deque
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Job:
    id: str
    total: int | None = None
    done: int = 0
    state: str = "running"
    events: list[dict] = field(default_factory=list)
    stamps: deque = field(default_factory=lambda: deque(maxlen=10))

    def rate(self) -> float | None:
        """Completions a second over the last ten; unknown with fewer than two, or in no time."""
        span = self.stamps[-1] - self.stamps[0] if len(self.stamps) > 1 else 0
        return (len(self.stamps) - 1) / span if span > 0 else None

    def left(self) -> float | None:
        r = self.rate()
        return (self.total - self.done) / r if r and self.total is not None else None


class Jobs:
    """Jobs by id. A reader that joins late gets all events of a job; of finished jobs the last twenty stay."""

    def __init__(self, keep: int = 20) -> None:
        self.keep, self.jobs, self.lock = keep, OrderedDict(), threading.Lock()

    def emit(self, job: str, kind: str, at: float, **values: object) -> None:
        """kind: start, chunk, done or error."""
        with self.lock:
            j = self.jobs.setdefault(job, Job(job))
            if kind == "start":
                j.total = values.get("total")
            elif kind == "chunk":
                j.done += 1
                j.stamps.append(at)
            elif kind in ("done", "error"):
                j.state = kind
                self.jobs.move_to_end(job)
            j.events.append({"type": kind, "at": at, **values})
            for old in [k for k, x in self.jobs.items() if x.state != "running"][: -self.keep]:
                del self.jobs[old]

    def replay(self, job: str) -> list[dict]:
        with self.lock:
            return list(self.jobs[job].events) if job in self.jobs else []


class StreamProgress(StreamingQueryListener):
    """Feeds the batches of all streaming queries into `Jobs`, each query as a job."""

    def __init__(self, jobs: Jobs) -> None:
        self.sink = jobs

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.sink.emit(str(event.runId), "start", 0.0, name=event.name)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.sink.emit(str(p.runId), "chunk", float(p.batchId), rows=p.numInputRows, ms=p.batchDuration)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.sink.emit(str(event.runId), "error" if event.exception else "done", 0.0, error=event.exception)
