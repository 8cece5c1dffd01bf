"""Running one SQL statement over a named database of parquet tables: read-only gate, timeout, row cap, one envelope for all outcomes."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.compare import keep_last_names
from ..functions.text import WRITE_PREFIXES
from ..sources.catalog import Catalog
from .dialect import SETTINGS, to_spark

MAX_TIMEOUT_MS, MAX_ROWS, TIMEOUT_MS, ROWS, CONCURRENT = 120_000, 50_000, 120_000, 10_000, 100
#: Spark's name for the scheduler pool of a thread's jobs.
POOL = "spark.scheduler.pool"
_gate = threading.BoundedSemaphore(CONCURRENT)


@dataclass
class Envelope:
    """The outcome of one statement."""

    ok: bool
    statement_type: str
    rows: list[dict[str, Any]] | None = None
    row_count: int | None = None
    pandas_result: str | None = None
    notice: str | None = None
    error: str | None = None
    timed_out: bool = False

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


@dataclass
class Request:
    dataset: str
    db: str
    sql: str
    mode: str = "read_only"
    timeout_ms: int = TIMEOUT_MS
    max_rows: int = ROWS
    names: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in ("read_only", "sandbox_rollback"):
            raise ValueError(f"no such mode: {self.mode}")
        if not 1 <= self.timeout_ms <= MAX_TIMEOUT_MS or not 1 <= self.max_rows <= MAX_ROWS:
            raise ValueError("timeout_ms or max_rows out of range")


def kind_of(sql: str) -> str:
    """The first word in capitals, or UNKNOWN."""
    words = sql.split()
    return words[0].upper() if words else "UNKNOWN"


def selects(sql: str) -> bool:
    return sql.lstrip().lower().startswith(("select", "with", "explain"))


def plan(own: SparkSession, catalog: Catalog, dataset: str, db: str, sql: str, sandbox: bool = False) -> DataFrame:
    """The statement as a DataFrame over the database's tables that it may name, as views of the session (which should be one of its own). Raises on commands, and on SQL that does not parse."""
    for key, value in SETTINGS.items():
        own.conf.set(key, value)
    for name, path in catalog.tables(own, dataset, db).items():
        if name.lower() in sql.lower():
            own.read.parquet(path).createOrReplaceTempView(name)
    text = to_spark(sql, sandbox)
    parsed = own._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if kind_of(sql) != "EXPLAIN" and _is_command(own, parsed):
        raise ValueError("only queries run in read-only mode")
    return keep_last_names(own.sql(text))


def _is_command(own: SparkSession, parsed: Any) -> bool:
    command = own._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    return command.isInstance(parsed) or parsed.getClass().getSimpleName().endswith("Statement")


@contextmanager
def limited(spark: SparkSession, timeout_ms: int, pool: str | None = None) -> Iterator[threading.Event]:
    """The jobs that this thread starts within are cancelled when the time is up, which sets the event. With a FAIR scheduler they run in the pool. Running tasks are interrupted; one that doesn't heed it (a
    tight loop of generated code) holds its core until it ends, or until Spark's task reaper (spark.task.reaper.*) ends its executor."""
    jobs, tag, late, done = spark.sparkContext, f"execute-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(timeout_ms / 1000):
            late.set()
            while not done.wait(0.2):  # again and again, as a plan may be about to start jobs
                jobs.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    jobs.setInterruptOnCancel(True)
    jobs.addJobTag(tag)
    before = jobs.getLocalProperty(POOL)
    jobs.setLocalProperty(POOL, pool or before)
    try:
        yield late
    finally:
        done.set()
        watcher.join()
        jobs.removeJobTag(tag)
        jobs.setLocalProperty(POOL, before)


def refused(kind: str, sql: str, mode: str) -> Envelope | None:
    """The envelope of a statement that isn't run at all."""
    if mode == "read_only" and kind in WRITE_PREFIXES:
        return Envelope(False, kind, error=f"{kind} is not allowed in read-only mode")
    if mode == "sandbox_rollback" and not selects(sql):
        return Envelope(True, kind, notice="statements other than queries are not run")
    return None


def failure(kind: str, error: Exception, late: bool) -> Envelope:
    return Envelope(False, kind, error="interrupted" if late else str(error).split("\n\nJVM stacktrace")[0], timed_out=late)


def execute(spark: SparkSession, catalog: Catalog, request: Request) -> Envelope:
    """Run the request. Errors and timeouts come back as envelopes. Rows are capped at max_rows by a limit, in the order that the statement gives."""
    kind = kind_of(request.sql)
    if not_run := refused(kind, request.sql, request.mode):
        return not_run
    with _gate, limited(spark, request.timeout_ms) as late:
        try:
            found = plan(spark.newSession(), catalog, request.dataset, request.db, request.sql, request.mode != "read_only").limit(request.max_rows).toPandas()
        except Exception as e:  # every failure of user SQL is an outcome
            return failure(kind, e, late.is_set())
        rows = found.to_dict("records")
        return Envelope(True, kind, rows, len(rows), found.to_string(index=False) if rows else "Empty result set")


def timed(df: DataFrame) -> float:
    """Seconds to run a plan without fetching its rows."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began
