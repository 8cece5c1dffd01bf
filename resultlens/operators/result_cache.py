"""A cache of executed statements: a table of statements goes in, each missing one is run once under the gate, and its rows and its envelope stay under its key.

A statement's plan is made on the driver, as any plan is, but its rows are written by the executors that compute them; only envelopes (a few numbers each) come back. At most ``concurrent`` statements run at a time, each with its time limit
and its jobs in a scheduler pool. Statements are taken in chunks from an iterator, so neither their number nor the cache's size weighs on the driver. A chunk becomes part of the cache by one
rename: what a broken run leaves behind is never read, and a rerun takes up only what is missing (failures are tried again; rows and timeouts stay).

The key is the hash of data set, database and normalised SQL, so spellings of a statement share one execution. Rows carry their place, their text as JSON, and the row keys of all ways to compare results, taken from typed columns as they were computed."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice
from threading import Lock
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compare import key_digests, row_key
from ..functions.text import normalize_sql
from ..sources.catalog import Catalog
from . import execute
from .execute import Envelope

ENVELOPE = "key string, dataset string, db string, normal_sql string, statement_type string, status string, ok boolean, row_count long, notice string, error string, timed_out boolean, seconds double"
MODES = ("positional", "agnostic", "named", "raw")
ROW = "key string, pos long, row string, " + ", ".join(f"{m} string" for m in MODES)
KEYS = ("dataset", "db", "normal_sql")


def statement_key(dataset: Column, db: Column, sql: Column) -> Column:
    """Null where a part is missing."""
    parts = [F.nullif(p, F.lit("")) for p in (dataset, db, normalize_sql(sql))]
    return F.when(F.forall(F.array(*parts), lambda p: p.isNotNull()), F.sha2(F.concat_ws("\x00", *parts).cast("binary"), 256))


def keyed(statements: DataFrame, sql: str = "sql", name: str = "key") -> DataFrame:
    return statements.withColumn(name, statement_key(F.col("dataset"), F.col("db"), F.col(sql)))


@dataclass
class ResultCache:
    """The cache at a path. mode and limits hold for statements without a `timeout_ms` of their own."""

    spark: SparkSession
    catalog: Catalog
    path: str
    mode: str = "read_only"
    timeout_ms: int = execute.TIMEOUT_MS
    max_rows: int = execute.ROWS
    concurrent: int = 16
    pool: str | None = None
    every: int = 1000
    _sessions: dict[tuple[str, str], SparkSession] = field(default_factory=dict)
    _lock: Any = field(default_factory=Lock)

    # reading

    def _chunks(self) -> list[str]:
        return sorted((f"{self.path}/{n}" for n in self._names(self.path) if n.startswith("chunk=")), key=lambda p: int(p.rsplit("=", 1)[1].split("-")[0]))

    def envelopes(self) -> DataFrame:
        """One row a statement: its last envelope."""
        chunks = self._chunks()
        if not chunks:
            return self.spark.createDataFrame([], ENVELOPE)
        all_of = self.spark.read.schema(ENVELOPE + ", chunk long").parquet(*(f"{c}/envelopes" for c in chunks))
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("chunk")))
        return all_of.withColumn("__n", nth).where("__n = 1").drop("__n", "chunk")

    def rows(self) -> DataFrame:
        """The rows of all statements that gave rows."""
        chunks = [f"{c}/rows" for c in self._chunks() if "rows" in self._names(c)]
        return self.spark.read.schema(ROW).parquet(*chunks) if chunks else self.spark.createDataFrame([], ROW)

    def missing(self, statements: DataFrame) -> DataFrame:
        """The distinct statements that have no rows and no timeout here; those without a part of their key are left out. Of spellings of a statement the first by text goes."""
        limit = F.col("timeout_ms").cast("long") if "timeout_ms" in statements.columns else F.lit(None).cast("long")
        todo = keyed(statements).where("key IS NOT NULL").select("key", "dataset", "db", normalize_sql(F.col("sql")).alias("normal_sql"), "sql", limit.alias("timeout_ms"))
        todo = todo.groupBy("key").agg(F.min(F.struct("sql", "dataset", "db", "normal_sql", "timeout_ms")).alias("s")).select("key", "s.*")
        return todo.join(self.envelopes().where("status <> 'failed'").select("key"), "key", "left_anti")

    # building

    def fill(self, statements: DataFrame) -> int:
        """Run what is missing of the statements (dataset, db, sql, and timeout_ms where given); how many ran."""
        todo, n = self.missing(statements).toLocalIterator(prefetchPartitions=True), 0
        with ThreadPoolExecutor(self.concurrent) as workers:
            while chunk := list(islice(todo, self.every)):
                at = f"{self.path}/_staging/{uuid.uuid4().hex}"
                envelopes = list(workers.map(lambda s: self._run(s.asDict(), at), chunk))  # noqa: B023
                self._commit(envelopes, at)
                n += len(chunk)
        return n

    def time(self, statements: DataFrame, iterations: int = 3) -> DataFrame:
        """key, iteration, seconds of repeated runs of the distinct statements, one at a time and without fetching rows; seconds are null where a run failed, and a late run is a statement's last."""
        todo = keyed(statements).where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("dataset", "db", "sql")).alias("s")).select("key", "s.*")
        at, chunk = f"{self.path}/_times/{uuid.uuid4().hex}", 0
        source = todo.toLocalIterator()
        while some := list(islice(source, self.every)):
            rows = [(s["key"], n, seconds) for s in some for n, seconds in enumerate(self._times(s, iterations))]
            self.spark.createDataFrame(rows, "key string, iteration int, seconds double").coalesce(1).write.parquet(f"{at}/{chunk}")
            chunk += 1
        return self.spark.read.parquet(*(f"{at}/{k}" for k in range(chunk))) if chunk else self.spark.createDataFrame([], "key string, iteration int, seconds double")

    def _times(self, s: Any, iterations: int) -> Iterator[float | None]:
        for _ in range(iterations):
            with execute.limited(self.spark, self.timeout_ms, self.pool) as late:
                try:
                    if execute.refused(execute.kind_of(s["sql"]), s["sql"], self.mode):
                        raise ValueError("not run")
                    yield execute.timed(execute.plan(self._session(s["dataset"], s["db"]), self.catalog, s["dataset"], s["db"], s["sql"], self.mode != "read_only"))
                except Exception:  # a failed run has no time
                    yield None
            if late.is_set():
                return

    def _run(self, s: dict[str, Any], at: str) -> dict[str, Any]:
        kind, limit, began = execute.kind_of(s["sql"]), s["timeout_ms"] or self.timeout_ms, time.perf_counter()
        envelope = execute.refused(kind, s["sql"], self.mode)
        if envelope is None:
            with execute.limited(self.spark, limit, self.pool) as late:
                try:
                    envelope = Envelope(True, kind, row_count=self._write(s, f"{at}/parts/{s['key']}"))
                except Exception as e:  # every failure of user SQL is an outcome
                    envelope = execute.failure(kind, e, late.is_set())
        status = "timeout" if envelope.timed_out else "rows" if envelope.ok else "failed"
        return {**{k: s[k] for k in ("key", *KEYS)}, "statement_type": kind, "status": status, "ok": envelope.ok, "row_count": envelope.row_count, "notice": envelope.notice, "error": envelope.error, "timed_out": envelope.timed_out, "seconds": time.perf_counter() - began}

    def _write(self, s: dict[str, Any], part: str) -> int:
        """Write the statement's rows; their number is counted by the job that writes them."""
        found = execute.plan(self._session(s["dataset"], s["db"]), self.catalog, s["dataset"], s["db"], s["sql"], self.mode != "read_only").limit(self.max_rows)
        names = [f"c{k}" for k in range(len(found.columns))]
        plain = found.toDF(*names)  # a column's name may hold anything
        text = F.to_json(F.struct(*(plain[c].alias(n) for c, n in zip(names, found.columns, strict=True))), {"ignoreNullFields": "false"})
        by_name = [c for _, c in sorted(zip(found.columns, names, strict=True))]
        keys = [row_key(plain, by_name, "positional") if m == "named" else row_key(plain, names, m) for m in MODES]
        seen = Observation()
        out = plain.select(F.lit(s["key"]).alias("key"), F.monotonically_increasing_id().alias("pos"), text.alias("row"), *(k.alias(m) for k, m in zip(keys, MODES, strict=True)))
        out.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(part)  # the limit leaves one task, in the statement's order
        return seen.get["n"]

    def _session(self, dataset: str, db: str) -> SparkSession:
        with self._lock:
            if (dataset, db) not in self._sessions:
                self._sessions[dataset, db] = self.spark.newSession()
            return self._sessions[dataset, db]

    def _commit(self, envelopes: list[dict[str, Any]], at: str) -> None:
        names = self._chunks()
        chunk = 1 + (int(names[-1].rsplit("=", 1)[1].split("-")[0]) if names else -1)
        held = sum(e["row_count"] or 0 for e in envelopes)
        parts = [f"{at}/parts/{e['key']}" for e in envelopes if e["row_count"]]
        if parts:
            self.spark.read.schema(ROW).parquet(*parts).coalesce(max(1, held // 1_000_000)).write.parquet(f"{at}/chunk/rows")
        rows = self.spark.createDataFrame(envelopes, ENVELOPE).withColumn("chunk", F.lit(chunk).cast("long"))
        rows.coalesce(1).write.parquet(f"{at}/chunk/envelopes")
        files, place = self._files()
        files.mkdirs(place(self.path))
        if not files.rename(place(f"{at}/chunk"), place(f"{self.path}/chunk={chunk}-{uuid.uuid4().hex[:8]}")):
            raise OSError(f"could not add a chunk to {self.path}")
        files.delete(place(at), True)

    def _files(self) -> tuple[Any, Any]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        return place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, path: str) -> Iterator[str]:
        files, place = self._files()
        return [f.getPath().getName() for f in files.listStatus(place(path))] if files.exists(place(path)) else []


def efficiency(pairs: DataFrame, times: DataFrame, sql: str = "sql", truth: str = "truth") -> DataFrame:
    """The ratio of the ground truth's time to the statement's, for each pair and iteration in which both ran."""
    both = keyed(keyed(pairs, sql, "__p"), truth, "__g")
    mine, gold = (times.select(F.col("key").alias(k), "iteration", F.col("seconds").alias(f"{k}_s")) for k in ("__p", "__g"))
    joined = both.join(mine, "__p").join(gold, ["__g", "iteration"])
    return joined.withColumn("ratio", F.try_divide("__g_s", "__p_s")).where("ratio IS NOT NULL").drop("__p", "__g", "__p_s", "__g_s")


def looked_up(candidates: DataFrame, cache: ResultCache, sql: str = "sql") -> DataFrame:
    """Candidates (dataset, db and SQL) with `hit`, `row_count` and `seconds` of their statement, however it is spelled; only successes count as hits."""
    good = cache.envelopes().where("ok AND NOT timed_out").select(F.col("key").alias("__k"), F.lit(True).alias("hit"), "row_count", "seconds")
    return keyed(candidates, sql, "__k").join(good, "__k", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("__k")


def judged(pairs: DataFrame, cache: ResultCache, sql: str = "sql", truth: str = "truth", mode: str = "positional") -> DataFrame:
    """Pairs (dataset, db, a statement and its ground truth) with `correct`, `ran`, `error` and `timed_out`, looked up: correct where both gave equal sets of rows, ran where both ran. What the
    cache lacks, or holds as failed or late, is never correct. Statements are compared once however many pairs name them."""
    both = keyed(keyed(pairs, sql, "__p"), truth, "__g")
    asked = both.select("__p", "__g").where("__p IS NOT NULL AND __g IS NOT NULL").distinct()
    digests = key_digests(cache.rows().select("key", F.col(mode).alias("k")).withColumnsRenamed({"key": "result", "k": "key"}), "result")
    state = cache.envelopes().select("key", "status", "error", "timed_out").join(digests.withColumnRenamed("result", "key"), "key", "left")
    side = lambda p: state.select(F.col("key").alias(f"__{p}"), F.struct("status", "error", "timed_out").alias(f"s{p}"), F.struct("n_rows", "d1", "d2", "d3").alias(f"d{p}"))
    found = asked.join(side("p"), "__p", "left").join(side("g"), "__g", "left")
    ran = F.coalesce((F.col("sp.status") == "rows") & (F.col("sg.status") == "rows"), F.lit(False))
    found = found.select("__p", "__g", ran.alias("ran"), (ran & F.col("dp").eqNullSafe(F.col("dg"))).alias("correct"), F.col("sp.error").alias("error"), F.coalesce("sp.timed_out", F.lit(False)).alias("timed_out"))
    out = both.join(found, ["__p", "__g"], "left").drop("__p", "__g")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("ran", "correct", "timed_out")})
