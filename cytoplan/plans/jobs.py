"""Commands as jobs: each runs in a thread under a Spark job tag, can be followed and cancelled."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

LOG_LINES = 4000
PENDING, RUNNING, DONE, FAILED, CANCELLED = "pending", "running", "done", "failed", "cancelled"


@dataclass
class Job:
    command: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    status: str = PENDING
    began: float | None = None
    ended: float | None = None
    result: Any = None
    error: str = ""
    log: deque = field(default_factory=lambda: deque(maxlen=LOG_LINES))
    first_line: int = 0

    def say(self, line: str) -> None:
        if len(self.log) == self.log.maxlen:
            self.first_line += 1
        self.log.append(line)


class JobManager:
    """Runs at most ``slots`` jobs at once; a job that is cancelled while it waits never starts."""

    def __init__(self, spark: SparkSession, slots: int = 2):
        self.spark, self.jobs = spark, {}
        self._slots, self._lock, self._threads = threading.Semaphore(slots), threading.Lock(), {}

    def submit(self, command: str, run: Callable[[Job], Any]) -> Job:
        job = Job(command)
        self.jobs[job.id] = job
        self._threads[job.id] = threading.Thread(target=self._run, args=(job, run), daemon=True)
        self._threads[job.id].start()
        return job

    def _run(self, job: Job, run: Callable[[Job], Any]) -> None:
        with self._slots:
            with self._lock:
                if job.status != PENDING:
                    return
                job.status, job.began = RUNNING, time.time()
            self.spark.addTag(job.id)
            try:
                job.result = run(job)
                end = DONE
            except Exception as e:  # the job's own failure is its result
                job.error, end = f"{type(e).__name__}: {e}", FAILED
                job.say(job.error)
            finally:
                self.spark.removeTag(job.id)
            with self._lock:
                job.status = end if job.status == RUNNING else job.status
                job.ended = time.time()

    def cancel(self, id: str) -> Job:
        """Stop a job: a waiting one at once, a running one by its Spark jobs."""
        job = self.jobs[id]
        with self._lock:
            if job.status in (PENDING, RUNNING):
                was, job.status = job.status, CANCELLED
                if was == RUNNING:
                    self.spark.interruptTag(job.id)
        return job

    def wait(self, id: str, seconds: float | None = None) -> Job:
        self._threads[id].join(seconds)
        return self.jobs[id]

    def lines(self, id: str, start: int = 0, n: int = 200) -> tuple[int, list[str]]:
        """Next line to ask for, and up to n lines from ``start``; the oldest are dropped beyond LOG_LINES."""
        job = self.jobs[id]
        at = max(start - job.first_line, 0)
        out = list(job.log)[at : at + n]
        return job.first_line + at + len(out), out
