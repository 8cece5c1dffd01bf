"""Vector memory: filtered nearest neighbours, centroids, contrastive and intrinsic scores, gated inserts.

Neighbour search is exact. Blocks of at most about ``MAX_PROBES`` probes and ``MEMORY_BLOCK`` rows of memory meet in pairs, in one plan; a task gets one block of each, multiplies them as matrices and returns the k nearest
of each probe, evaluated exactly. Of these a window takes the k nearest of all blocks. Every pair is looked at, so work grows with the product of both sides."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector_blocks
from ..functions.vectors import cosine, l2_squared

MAX_PROBES, MEMORY_BLOCK = 20_000, 25_000
SCOPES = ("other", "same", "any")


def nearest(probes: DataFrame, memory: DataFrame, k: int, scope: str = "any", drop_same_after: bool = False) -> DataFrame:
    """probe_id, id, distance (squared L2), place for the k nearest of each probe. Both sides: id, db_id, embedding.

    scope filters before k: memory of other databases, the same, or any. drop_same_after ranks first and then drops rows of the probe's database, so fewer may come back."""
    if scope not in SCOPES:
        raise ValueError(f"no such scope: {scope}")
    p = probes.select(F.col("id").alias("probe_id"), F.col("db_id").alias("probe_db"), F.col("embedding").alias("probe"))
    mine, other = in_blocks(p, memory.select("id", "db_id", "embedding"))
    found = nearest_of_blocks(mine, other, ["__a", "__b"], k, scope)
    if drop_same_after:
        found = found.where("db_id != probe_db")
    return found.select("probe_id", "id", "distance", "place")


def in_blocks(probes: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers __a and __b of their blocks: each block of probes (probe_id) and each block of the memory (id) have one pair in common."""
    a, b = (max(1, -(-df.count() // most)) for df, most in ((probes, MAX_PROBES), (memory, MEMORY_BLOCK)))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    mine = probes.withColumn("__a", F.pmod(F.xxhash64("probe_id"), F.lit(a)).cast("int")).withColumn("__b", each(b))
    return mine, memory.withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int")).withColumn("__a", each(a))


def nearest_of_blocks(mine: DataFrame, other: DataFrame, keys: list[str], k: int, scope: str) -> DataFrame:
    """probe_id, probe_db, id, db_id, distance and place of the k nearest of each probe (probe_id, probe_db, probe) among the rows (id, db_id, embedding) that share its keys; rows without a distance come last."""
    kinds = {n: f"{df.schema[n].dataType.simpleString()}" for df, names in ((mine, ("probe_id", "probe_db")), (other, ("id", "db_id"))) for n in names}
    one = mine.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(_nearest_in(k, scope), ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", distance double")
    place = F.row_number().over(Window.partitionBy("probe_id").orderBy(F.asc_nulls_last("distance"), "id"))
    return one.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def _nearest_in(k: int, scope: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(p: pa.Table, m: pa.Table) -> pa.Table:
        m = m.take(pc.sort_indices(m["id"], null_placement="at_start"))
        probe_kinds, kinds = vector_blocks.codes(p["probe_db"], m["db_id"])
        i, j, distance, none = vector_blocks.nearest_rows(p["probe"], probe_kinds, m["embedding"], kinds, k, scope)
        pairs = {"probe_id": p["probe_id"].take(pa.array(i)), "probe_db": p["probe_db"].take(pa.array(i)), "id": m["id"].take(pa.array(j)), "db_id": m["db_id"].take(pa.array(j))}
        return pa.table(pairs | {"distance": pa.array(distance, pa.float64(), mask=none)})

    return best


def centroid(rows: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """keys and the element-wise mean, as an array of double. Means are taken per position, so no vectors of a group meet in one task."""
    flat = rows.select(*keys, F.posexplode(vector).alias("pos", "x"))
    means = flat.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def thought_reward(probes: DataFrame, memory: DataFrame, k: int, scope: str = "other") -> DataFrame:
    """probe_id and the cosine of each probe with the mean of its k nearest; 0 without neighbours."""
    near = nearest(probes, memory, k, scope).join(memory.select("id", "embedding"), "id")
    mean = centroid(near, "probe_id")
    joined = probes.select(F.col("id").alias("probe_id"), "embedding").join(mean, "probe_id", "left")
    return joined.select("probe_id", F.coalesce(F.when(F.col("centroid").isNotNull(), cosine(F.col("embedding"), F.col("centroid"))), F.lit(0.0)).alias("reward"))


def _best(probes: DataFrame, found: DataFrame, memory: DataFrame, name: str) -> DataFrame:
    near = found.join(memory.select("id", F.col("embedding").alias("e")), "id").join(probes.select(F.col("id").alias("probe_id"), "embedding"), "probe_id")
    return near.groupBy("probe_id").agg(F.max(cosine(F.col("embedding"), F.col("e"))).alias(name))


def contrastive(probes: DataFrame, correct: DataFrame, failed: DataFrame, k: int = 5) -> DataFrame:
    """Best cosine among correct neighbours of other databases minus best among failed ones (dropped if of the same database), clipped to [-1, 1]; an absent side counts 0."""
    good = _best(probes, nearest(probes, correct, k, "other"), correct, "good")
    bad = _best(probes, nearest(probes, failed, k, "any", drop_same_after=True), failed, "bad")
    out = probes.select(F.col("id").alias("probe_id")).join(good, "probe_id", "left").join(bad, "probe_id", "left")
    value = F.coalesce("good", F.lit(0.0)) - F.coalesce("bad", F.lit(0.0))
    return out.select("probe_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)).alias("reward"))


def intrinsic(score: Column, beta_s: float = 0.5, beta_e: float = 0.5, exploration: float = 1.0) -> Column:
    """Similarity brought to [0, 1], and exploration, weighted."""
    return beta_s * (score + 1) / 2 + beta_e * exploration


def greatest_cosine(probes: DataFrame, memory: DataFrame) -> DataFrame:
    """probe_id and similarity, the greatest cosine with any vector of the memory. Pairs never leave their task: a block returns one value a probe."""
    mine, other = in_blocks(probes.select(F.col("id").alias("probe_id"), F.col("embedding").alias("probe")), memory.select("id", "embedding"))

    def best(p: pa.Table, m: pa.Table) -> pa.Table:
        values = vector_blocks.greatest_cosines(p["probe"], m["embedding"]) if len(m) else []
        return pa.table({"probe_id": p["probe_id"].slice(0, len(values)), "similarity": pa.array(values, pa.float64())})

    kind = mine.schema["probe_id"].dataType.simpleString()
    pairs = mine.groupBy("__a", "__b").cogroup(other.groupBy("__a", "__b")).applyInArrow(best, f"probe_id {kind}, similarity double")
    return pairs.groupBy("probe_id").agg(F.max("similarity").alias("similarity"))


def exploit_explore(probes: DataFrame, memory: DataFrame) -> DataFrame:
    """exploit: minus the distance to the centroid of correct vectors (0 without any). explore: 1 minus the best cosine with incorrect ones (1 without any). memory: is_correct (null: true)."""
    flagged = memory.withColumn("is_correct", F.coalesce("is_correct", F.lit(True)))
    mean = centroid(flagged.where("is_correct").withColumn("one", F.lit(1)), "one")  # one row
    wrong = flagged.where("NOT is_correct").select("id", "db_id", "embedding")
    best = greatest_cosine(probes, wrong).withColumnRenamed("similarity", "best")
    out = probes.select(F.col("id").alias("probe_id"), "embedding", F.lit(1).alias("one")).join(F.broadcast(mean), "one", "left").join(best, "probe_id", "left")
    exploit = F.when(F.col("centroid").isNotNull(), -F.sqrt(l2_squared(F.col("embedding"), F.col("centroid")))).otherwise(0.0)
    explore = F.when(F.col("best").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("best"))).otherwise(1.0)  # a cosine may round to over 1
    return out.select("probe_id", exploit.alias("exploit"), explore.alias("explore"))


def near_duplicates(new: DataFrame, memory: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The new rows with nearest_id, similarity and is_new: whether the nearest of the memory (any database) is less alike than the threshold."""
    near = nearest(new, memory, 1).select("probe_id", F.col("id").alias("nearest_id"))
    joined = new.join(near, F.col("id") == F.col("probe_id"), "left").drop("probe_id").join(memory.select(F.col("id").alias("nearest_id"), F.col("embedding").alias("__e")), "nearest_id", "left")
    similarity = F.when(F.col("__e").isNotNull(), cosine(F.col("embedding"), F.col("__e")))
    return joined.withColumn("similarity", similarity).withColumn("is_new", F.coalesce(similarity < threshold, F.lit(True))).drop("__e")


def insert_if_absent(memory: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The memory and the new rows whose key it lacks; of new rows with one key, one."""
    return memory.unionByName(new.dropDuplicates([key]).join(memory.select(key), key, "left_anti"), allowMissingColumns=True)
