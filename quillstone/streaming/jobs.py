"""Bounded job queue of the service, and document intake as a stream.

The queue is driver-side state for one service process; the stream takes new text
files a few at a time (bounded admission), extracts fields once for each document
(late duplicates within the time to live are dropped) and writes result tables.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import extract_fields, validate_text

CAPACITY, TTL_SECONDS = 8, 900.0


class QueueFull(Exception):
    """No more jobs are admitted now."""


@dataclass
class Job:
    id: str
    file: str
    status: str = "accepted"
    result: object = None
    error: str | None = None
    expires_at: float | None = None
    cancelled: bool = False


class JobQueue:
    """Admission, life cycle, expiry and single consumption of jobs, under one lock."""

    def __init__(self, capacity: int = CAPACITY, ttl: float = TTL_SECONDS, clock: Callable[[], float] = time.monotonic):
        self._jobs: dict[str, Job] = {}
        self._lock = threading.Lock()
        self.capacity, self.ttl, self._clock = capacity, ttl, clock

    def _reap(self) -> None:
        now = self._clock()
        self._jobs = {k: j for k, j in self._jobs.items() if j.expires_at is None or j.expires_at > now}

    def submit(self, file: str) -> str:
        """Id of a new job; QueueFull if as many as the capacity are kept."""
        with self._lock:
            self._reap()
            if len(self._jobs) >= self.capacity:
                raise QueueFull
            job = Job(uuid.uuid4().hex, file)
            self._jobs[job.id] = job
            return job.id

    def run(self, job_id: str, work: Callable[[str], object]) -> None:
        """Run a job's work unless it was cancelled; its time to live begins when it ends."""
        with self._lock:
            job = self._jobs.get(job_id)
            if job is None or job.cancelled:
                return
            job.status = "running"
        try:
            result, error = work(job.file), None
        except Exception as e:  # the job fails, not the service
            result, error = None, type(e).__name__
        with self._lock:
            job.result, job.error, job.status = result, error, "failed" if error else "done"
            job.expires_at = self._clock() + self.ttl

    def cancel(self, job_id: str) -> bool:
        """Forget a job; a running one ends without a result."""
        with self._lock:
            job = self._jobs.pop(job_id, None)
            if job:
                job.cancelled = True
            return job is not None

    def take(self, job_id: str) -> dict | None:
        """State of a job; a finished one is handed over once and forgotten."""
        with self._lock:
            self._reap()
            job = self._jobs.get(job_id)
            if job is None:
                return None
            if job.status in ("done", "failed"):
                del self._jobs[job_id]
            return {"job_id": job.id, "status": job.status, "file": job.file, "result": job.result, "error": job.error}

    def summary(self) -> dict:
        with self._lock:
            self._reap()
            jobs = list(self._jobs.values())
        return {"total": len(jobs), "running": sum(j.status == "running" for j in jobs), "capacity": self.capacity, "jobs": [{"job_id": j.id, "status": j.status, "file": j.file} for j in jobs]}


def queue_summary(jobs: DataFrame, now) -> DataFrame:
    """(total, running) of a table of jobs (status, expires_at) that haven't expired."""
    kept = jobs.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return kept.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "running").alias("running"))


def intake(spark: SparkSession, folder: str, files_per_trigger: int = CAPACITY) -> DataFrame:
    """Stream of documents (doc_id, text, arrived) from new text files, so many at a time."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.txt\z", 1)
    return rows.select(name.alias("doc_id"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def results(docs: DataFrame, ttl: str = "900 seconds") -> DataFrame:
    """Fields and warnings of each streamed document, one result a document within the time to live."""
    once = docs.withWatermark("arrived", ttl).dropDuplicatesWithinWatermark(["doc_id"])
    return once.select("doc_id", "arrived", extract_fields("text").alias("fields"), validate_text("text").alias("warnings"))


def run_available(docs: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop."""
    results(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window; works on a stream or a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
