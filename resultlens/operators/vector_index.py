"""An index for nearest neighbours: inverted lists around centroids.

Centroids are fitted by k-means on a bounded sample (``sample`` vectors, those whose ids hash lowest); every vector is then put on the list of its nearest centroid. A list of many vectors is dealt in chunks, so that no task holds more than
``LIST_ROWS`` or so of them, however the data cluster. A search looks at the nearest lists of each probe and ranks what is there by exact distance, so what it returns is exact for the vectors it looked at; how many lists it takes
is the caller's choice between speed and recall (``lists_for`` finds the least number for a target, ``recall`` measures it), and all lists give the exact answer. Probes that find fewer than k rows in their scope are searched exactly. Rows of a null
vector are on no list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import MAX_PROBES, SCOPES, nearest, nearest_of_blocks

SAMPLE, MOST_LISTS, LIST_ROWS, ROUNDS = 50_000, 4096, 20_000, 12


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y) - 2 * x @ y.T)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def kmeans(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids of a sample, at first sample rows far from each other; an empty cluster takes the row that is worst off."""
    rng = np.random.default_rng(seed)
    first, away = [int(rng.integers(len(x)))], np.full(len(x), np.inf)
    while len(first) < min(lists, len(x)):
        away = np.minimum(away, squared_distances(x, x[first[-1:]])[:, 0])
        total = away.sum()
        first.append(int(rng.choice(len(x), p=away / total)) if total > 0 else int(rng.integers(len(x))))
    centres = x[first].copy()
    for _ in range(rounds):
        index, least = np.zeros(len(x), np.int64), np.zeros(len(x))
        for k in range(0, len(x), 4096):
            d = squared_distances(x[k : k + 4096], centres)
            index[k : k + 4096], least[k : k + 4096] = d.argmin(1), d.min(1)
        for c in range(len(centres)):
            own = index == c
            centres[c] = x[own].mean(0) if own.any() else x[least.argmax()]
    return centres


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 0) -> None:
    """Write the index of vectors (id, db_id, embedding) to a path: about as many lists as the root of their number, unless given."""
    spark, rows = vectors.sparkSession, vectors.where("embedding IS NOT NULL").select("id", "db_id", "embedding")
    lists = lists or min(MOST_LISTS, max(1, round(rows.count() ** 0.5)))
    chosen = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("embedding").toPandas()["embedding"]
    centres = kmeans(np.array(chosen.tolist(), float), lists, seed=seed) if len(chosen) else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(squared_distances(_matrix(b.column("embedding")), centres).argmin(1).astype(np.int32))], [*b.schema.names, "list"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    dealt = rows.mapInArrow(assign, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", list int") if len(centres) else rows.withColumn("list", F.lit(0))
    dealt.write.mode("overwrite").parquet(f"{path}/assigned")
    dealt = spark.read.parquet(f"{path}/assigned")
    chunks = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("chunks"))
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, centre array<double>").join(chunks, "list").write.mode("overwrite").parquet(f"{path}/lists")
    placed = dealt.join(F.broadcast(chunks), "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")  # MOST_LISTS rows at most
    placed.repartition("list", "chunk").sortWithinPartitions("list", "chunk").write.mode("overwrite").parquet(f"{path}/vectors")


def search(spark: SparkSession, path: str, probes: DataFrame, k: int, lists: int, scope: str = "any") -> DataFrame:
    """probe_id, id, distance (squared L2) and place of the k nearest of each probe (id, db_id, embedding) on its nearest lists."""
    if scope not in SCOPES:
        raise ValueError(f"no such scope: {scope}")
    known = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # MOST_LISTS rows at most
    memory = spark.read.parquet(f"{path}/vectors")
    p = probes.where("embedding IS NOT NULL").select(F.col("id").alias("probe_id"), F.col("db_id").alias("probe_db"), F.col("embedding").alias("probe"))
    if not known:
        return nearest(probes, memory, k, scope)
    centres, names = np.array([r["centre"] for r in known]), np.array([r["list"] for r in known], np.int32)
    take = min(lists, len(known))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = names[np.argsort(squared_distances(_matrix(b.column("probe")), centres), axis=1, kind="stable")[:, :take]]
                found = pa.ListArray.from_arrays(np.arange(0, near.size + 1, take, dtype=np.int32), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "lists"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema.fields)
    asked = p.mapInArrow(look, kinds + ", lists array<int>").select("probe_id", "probe_db", "probe", F.explode("lists").alias("list"))
    chunks = F.broadcast(spark.read.parquet(f"{path}/lists").select("list", "chunks"))
    asked = asked.join(chunks, "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    parts = max(1, -(-p.count() // MAX_PROBES))  # many probes may ask for a list
    asked = asked.withColumn("part", F.pmod(F.xxhash64("probe_id"), F.lit(parts)).cast("int"))
    held = memory.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = nearest_of_blocks(asked, held, ["list", "chunk", "part"], k, scope).select("probe_id", "id", "distance", "place")
    if take == len(known):
        return found
    full = found.groupBy("probe_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= k).select(F.col("probe_id").alias("id"))
    few = probes.join(full, "id", "left_anti")  # those whose scope is scarce on their lists
    return found.join(full.withColumnRenamed("id", "probe_id"), "probe_id", "left_semi").unionByName(nearest(few, memory, k, scope))


def lists_for(spark: SparkSession, path: str, k: int, target: float = 0.9, sample: int = 200, seed: int = 1) -> int:
    """The least number of nearest lists that hold the target share of the k nearest others of a sample of the indexed vectors, searched exactly. Vectors without clusters need most lists."""
    memory = spark.read.parquet(f"{path}/vectors")
    some = memory.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("id", "db_id", "embedding")
    found = nearest(some, memory, k + 1).where("id <> probe_id").join(memory.select("id", "list"), "id")
    pairs = found.join(some.select(F.col("id").alias("probe_id"), "embedding"), "probe_id").select("embedding", "list").toPandas()  # sample x (k + 1) rows at most
    known = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    if not len(pairs):
        return max(1, len(known))
    centres, names = np.array([r["centre"] for r in known]), np.array([r["list"] for r in known])
    order = names[np.argsort(squared_distances(np.array(pairs["embedding"].tolist(), float), centres), axis=1, kind="stable")]
    places = np.sort((order == pairs["list"].to_numpy()[:, None]).argmax(1)) + 1
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_probes and recall: the share of the exact neighbours (probe_id, id) that were found."""
    hit = found.select("probe_id", "id", F.lit(1).alias("__hit"))
    return exact.join(hit, ["probe_id", "id"], "left").agg(F.count_distinct("probe_id").alias("n_probes"), F.round(F.avg(F.coalesce("__hit", F.lit(0))), 6).alias("recall"))
