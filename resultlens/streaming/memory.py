"""Stateful growth: an online vector memory, and caches that take only what is missing. Each works per micro-batch, so batch and stream share the code."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import text
from ..operators.result_cache import ResultCache
from ..operators.vector_index import squared_distances

#: Rows of a micro-batch that are settled at a time, and that meet the memory in one job.
BLOCK = FETCH = 4096


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1), 1e-8)


Near = tuple[float, str, float]


def _nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x: distance, place and cosine of the nearest of y, ties to the smallest id."""
    order = np.argsort(ids, kind="stable")
    d = np.round(squared_distances(x, y[order]), 9)
    j = order[d.argmin(1)]
    lengths = np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y[j], axis=1), 1e-8)
    return d.min(1), j, np.einsum("ij,ij->i", x, y[j]) / lengths


def _against(x: np.ndarray, ids: list[str], kinds: list, memory: DataFrame) -> tuple[dict[int, Near], set[int]]:
    """In one job, for each row of x that has any: distance, id and cosine of its nearest in the memory of its collection; and the rows whose id is in it. A task returns one candidate a row."""
    places: dict[Any, np.ndarray] = {c: np.array([k for k, kind in enumerate(kinds) if kind == c]) for c in set(kinds)}
    named: dict[tuple[Any, str], list[int]] = {}
    for k, key in enumerate(zip(kinds, ids, strict=True)):
        named.setdefault(key, []).append(k)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Near] = {}
        known: set[int] = set()
        for b in batches:
            own, theirs, vectors = b.column("collection").to_pylist(), b.column("id").to_pylist(), _vectors(b.column("embedding"))
            known.update(k for key in zip(own, theirs, strict=True) if key in named for k in named[key])
            names, of = np.array(theirs, object), np.array(own, object)
            for c, at in places.items():
                rows = np.flatnonzero(of == c)
                for k in range(0, len(rows), 2048):
                    some = rows[k : k + 2048]
                    low, j, cosine = _nearest(x[at], vectors[some], names[some])
                    for i, *found in zip(at.tolist(), low.tolist(), names[some[j]], cosine.tolist(), strict=True):
                        if i not in held or (found[0], found[1]) < held[i][:2]:
                            held[i] = tuple(found)
        if held:  # a row whose id is known has a nearest
            columns = {n: [h[k] for h in held.values()] for k, n in enumerate(("distance", "id", "cosine"))}
            yield pa.RecordBatch.from_pydict({"row": pa.array(list(held), pa.int32()), **columns, "known": [k in known for k in held]})

    found = memory.select("id", "collection", "embedding").mapInArrow(best, "row int, distance double, id string, cosine double, known boolean")
    least = found.groupBy("row").agg(F.min(F.struct("distance", "id", "cosine")).alias("m"), F.bool_or("known").alias("known")).collect()  # a row for each of x
    return {r["row"]: tuple(r["m"]) for r in least}, {r["row"] for r in least if r["known"]}


def _settled(x: np.ndarray, ids: list[str], kinds: list, before: dict[int, Near], known: set[tuple[Any, str]], threshold: float, block: int) -> list[int]:
    """Which rows enter: block by block, each after the nearest of the blocks before it that entered is known."""
    enter: dict[Any, list[int]] = {}
    known = set(known)
    for at in range(0, len(ids), block):
        rows, near = range(at, min(at + block, len(ids))), {}
        for c in {kinds[k] for k in rows}:
            own, inside = [k for k in rows if kinds[k] == c], enter.get(c, [])
            found = zip(*_nearest(x[own], x[inside], np.array([ids[k] for k in inside], object)), strict=True) if inside else ((np.inf, 0, 0.0) for _ in own)
            for k, (d, j, cosine) in zip(own, found, strict=True):
                here = [(float(d), ids[inside[j]], float(cosine))] if inside else []
                if least := min([*here, *([before[k]] if k in before else [])], default=None):
                    near[k - at] = least
        some = [at + k for k in _entering(x[at : rows.stop], ids[at : rows.stop], kinds[at : rows.stop], near, known, threshold)]
        for k in some:
            enter.setdefault(kinds[k], []).append(k)
            known.add((kinds[k], ids[k]))
    return sorted(k for rows in enter.values() for k in rows)


def _entering(x: np.ndarray, ids: list[str], kinds: list, before: dict[int, Near], known: set[tuple[Any, str]], threshold: float) -> list[int]:
    """Which rows of a block enter, one after another: the nearest of all that is in by then must be less alike than the threshold, and the id not be in. known: ids that were in before."""
    kept: dict[Any, list[int]] = {}
    known = set(known)
    alike, apart = _cosines(x, x), np.round(squared_distances(x, x), 9)
    for k, c in enumerate(kinds):
        near, own = before.get(k), kept.setdefault(c, [])
        if own:
            d = apart[k, own]
            j = min((own[t] for t in np.flatnonzero(d == d.min())), key=lambda t: ids[t])
            here = (float(apart[k, j]), ids[j], float(alike[k, j]))
            near = here if near is None or here[:2] < near[:2] else near
        if (c, ids[k]) not in known and (near is None or near[2] < threshold):
            own.append(k)
            known.add((c, ids[k]))
    return sorted(k for rows in kept.values() for k in rows)


def admit(batch: DataFrame, memory: DataFrame, path: str, threshold: float = 0.9, order: str = "arrival", block: int = BLOCK) -> DataFrame:
    """The rows of the batch (id, collection, embedding and an order) that enter the memory, written to the path: one enters unless the nearest of its collection in the memory, earlier rows that entered among
    them, is as alike as the threshold. So the result doesn't depend on how a stream is cut in batches.

    What is in by then depends on every row before, so rows are taken in order. About ``FETCH`` of them (`block`, if that is more) meet the memory in one job: their vectors travel to its partitions, each of which returns one
    nearest candidate a row. They are settled in blocks of `block`, a block row by row. These rows are all that the driver holds, whatever the sizes of batch, collections and memory. The batch is computed once. An id
    enters a collection once; rows of a null vector don't enter."""
    spark, schema = batch.sparkSession, batch.schema
    at = path.rstrip("/")
    batch.where("embedding IS NOT NULL").write.mode("overwrite").parquet(f"{at}/_rows")
    rows = spark.read.schema(schema).parquet(f"{at}/_rows")
    rows.repartitionByRange(max(1, -(-rows.count() // max(block, FETCH))), order, "id").sortWithinPartitions(order, "id").write.mode("overwrite").parquet(f"{at}/_blocks")
    files = sorted(spark.read.schema(schema).parquet(f"{at}/_blocks").select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_name").alias("n")).distinct().collect(), key=lambda r: int(re.search(r"part-(\d+)", r["n"])[1]))
    done: list[str] = []
    for k, f in enumerate(files):
        block_rows = spark.read.schema(schema).parquet(f["f"])
        held = block_rows.select("id", "collection", order, "embedding").orderBy(order, "id").toArrow()
        ids, kinds, orders, x = held["id"].to_pylist(), held["collection"].to_pylist(), held[order].to_pylist(), _vectors(held["embedding"].combine_chunks())
        so_far = memory.select("id", "collection", "embedding")
        if done:
            so_far = so_far.unionByName(spark.read.schema(schema).parquet(*done).select("id", "collection", "embedding"))
        before, known = _against(x, ids, kinds, so_far)
        enter = _settled(x, ids, kinds, before, {(kinds[i], ids[i]) for i in known}, threshold, block)
        if enter:
            names = spark.createDataFrame([(ids[i], kinds[i], orders[i]) for i in enter], block_rows.select("id", "collection", order).schema)
            block_rows.join(F.broadcast(names), ["id", "collection", order], "left_semi").dropDuplicates(["id", "collection"]).write.mode("overwrite").parquet(f"{at}/block={k}")
            done.append(f"{at}/block={k}")
    return spark.read.schema(schema).parquet(*done) if done else batch.limit(0)


def remembered(batch: DataFrame, **gate: float) -> DataFrame:
    """Thoughts (dataset, db, prompt, thought, correct, embedding, arrival) as candidates of the memory: those of quality, with the id of their content, in the collection of correct or of failed ones."""
    columns = text.prompt_columns(F.col("prompt"))
    good = text.quality_gate(batch.where("thought IS NOT NULL"), "thought", columns, **gate).where("accepted").drop("accepted")
    kind = F.when(F.coalesce("correct", F.lit(False)), "correct").otherwise("failed")
    return good.withColumns({"id": text.content_id(F.col("dataset"), F.col("db"), F.col("thought")), "collection": kind})


def grow_thoughts(stream: DataFrame, path: str, checkpoint: str, threshold: float = 0.9, block: int = BLOCK, **gate: float) -> StreamingQuery:
    """Quality gate, near-duplicate gate and insertion of a stream of thoughts; each row sees all that entered before it, in its own batch too."""
    schema = remembered(stream, **gate).schema

    def step(batch: DataFrame, batch_id: int) -> None:
        memory = _earlier(batch.sparkSession, path, batch_id, schema)
        dealt = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)  # a batch may be one file, and the gate is dear
        _insert(remembered(dealt, **gate), memory, _part(path, batch_id), threshold, block)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _insert(batch: DataFrame, memory: DataFrame | None, part: str, threshold: float, block: int = BLOCK) -> None:
    admit(batch, batch.limit(0) if memory is None else memory, f"{part}-work", threshold, block=block).write.mode("overwrite").parquet(part)
    place = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{part}-work")
    place.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def grow_memory(stream: DataFrame, path: str, checkpoint: str, threshold: float = 0.9) -> StreamingQuery:
    """Feed a stream of vectors into the memory table at path; each batch sees all that earlier ones added."""

    def step(batch: DataFrame, batch_id: int) -> None:
        # only what earlier batches wrote counts, and a batch that runs again writes its own part anew
        _insert(batch, _earlier(batch.sparkSession, path, batch_id, batch.schema), _part(path, batch_id), threshold)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _part(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/part={batch_id}"


def _earlier(spark: SparkSession, path: str, batch_id: int, schema: StructType | None = None) -> DataFrame | None:
    """What earlier batches wrote at path; parts of this batch and later ones (a run that was broken off) are left out. None if there is nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(hadoop) if f.isDirectory()]
    earlier = [f"{path.rstrip('/')}/{n}" for n in names if re.fullmatch(r"part=\d+", n) and int(n[5:]) < batch_id]
    if not earlier:
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(*earlier)


def missing(entries: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that the cache lacks; rows and timeouts count as cached, failures do not."""
    return entries.dropDuplicates(keys).join(cache.where(F.col("status").isin("rows", "timeout")).select(*keys), keys, "left_anti")


def fill_cache(stream: DataFrame, cache_path: str, checkpoint: str, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Compute and append what the cache lacks, batch by batch. compute gives rows with the cache's columns, `status` among them."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.dropna(subset=keys)  # an entry without a part of its key can't be looked up
        cache = _earlier(batch.sparkSession, cache_path, batch_id)
        todo = batch.dropDuplicates(keys) if cache is None else missing(batch, cache, keys)
        compute(todo).write.mode("overwrite").parquet(_part(cache_path, batch_id))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_into_cache(stream: DataFrame, cache: ResultCache, checkpoint: str) -> StreamingQuery:
    """Run the statements of a stream (dataset, db, sql) into the cache of their results, those that it lacks. A batch that runs again finds what it did."""
    return stream.writeStream.foreachBatch(lambda batch, _: cache.fill(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_successes(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The cache and new successes whose key it lacks."""
    good = new.where(F.col("ok") & ~F.coalesce("timed_out", F.lit(False)))
    return cache.unionByName(good.dropDuplicates(keys).join(cache.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def log_samples(sink: Callable[[list], None], every: int = 100, size: int = 3) -> Callable[[DataFrame, int], None]:
    """A batch function that hands a few rows of each `every`-th batch to sink."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch_id % every == 0:
            sink(batch.limit(size).collect())

    return step
