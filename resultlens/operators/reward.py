"""The composite reward of a completion: format, execution, overlap of operations, similarity to memory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import sqlops, vectors
from .result_cache import ResultCache, judged

FORMAT_WEIGHT, LEAST_THOUGHT = 1.0, 30


def composite(formatted: Column, correct: Column, ran: Column, atomic: Column, thought_length: Column, memory: Column, use_memory: bool = True, least: int = LEAST_THOUGHT) -> Column:
    """0 unless the format holds; else format (1), execution (2 if correct, 1 and the overlap if it ran, 0) and memory (1 if correct, else the similarity of a
    thought of more than `least` characters). At most 4, or 3 without memory."""
    execution = F.when(correct, 2.0).when(ran, 1.0 + atomic).otherwise(0.0)
    remembered = F.when(correct, 1.0).when(thought_length > least, memory).otherwise(0.0)
    total = FORMAT_WEIGHT + execution + (remembered if use_memory else 0.0)
    return F.when(F.coalesce(formatted, F.lit(False)), total).otherwise(0.0)


def rewarded(completions: DataFrame, cache: ResultCache, memory: DataFrame, k: int = 5, scope: str = "other", use_memory: bool = True, key: str = "doc_id") -> DataFrame:
    """completions (a key, dataset, db, truth, completion, and db_id and embedding of the thought) with sql, formatted, correct, ran, atomic, remembered and reward.

    The verdict is looked up by normalised SQL in the cache, which must hold the results of both statements (``ResultCache.fill``). Overlap is taken only of statements that ran and are wrong, similarity
    only of thoughts that can earn it; either is 0 elsewhere. Rows of a null embedding have no similarity. What comes from the texts is computed once and
    kept beside the cache, without the texts, as every part of the reward reads it."""
    c = F.col("completion")
    own = completions.withColumns({"sql": text.extract_sql(c), "formatted": text.format_gate(c), "n_thought": F.coalesce(F.length(text.extract_thought(c)), F.lit(0))}).drop("completion")
    at = f"{cache.path}/_rewards/{uuid.uuid4().hex}"
    own.write.parquet(at)
    own = judged(completions.sparkSession.read.schema(own.schema).parquet(at), cache)
    partly = F.col("ran") & ~F.col("correct")
    ops = sqlops.with_ops(sqlops.with_ops(own.where(partly).select("sql", "truth").distinct(), "sql", "p"), "truth", "g").select("sql", "truth", sqlops.best_shaped(F.col("p"), F.array("g")).alias("atomic"))
    own = own.join(ops, ["sql", "truth"], "left").withColumn("atomic", F.coalesce("atomic", F.lit(0.0)))
    if use_memory:
        earns = own.where(F.col("formatted") & ~F.col("correct") & (F.col("n_thought") > LEAST_THOUGHT) & F.col("embedding").isNotNull())
        near = vectors.thought_reward(earns.select(F.col(key).alias("id"), "db_id", "embedding"), memory, k, scope)
        own = own.join(near.select(F.col("probe_id").alias(key), F.col("reward").alias("remembered")), key, "left")
        own = own.withColumn("remembered", F.coalesce("remembered", F.lit(0.0)))
    else:
        own = own.withColumn("remembered", F.lit(0.0))
    total = composite(F.col("formatted"), F.col("correct"), F.col("ran"), F.col("atomic"), F.col("n_thought"), F.col("remembered"), use_memory)
    return own.withColumn("reward", total)


def as_callback(spark: SparkSession, pipeline: Callable[[DataFrame], DataFrame]) -> Callable[..., list[float]]:
    """A function (prompts, completions, **columns) -> rewards over a DataFrame pipeline that keeps `row` and gives `reward`."""

    def reward(prompts: list[str], completions: list[str], **columns: list) -> list[float]:
        rows = pd.DataFrame({"row": range(len(completions)), "prompt": prompts, "completion": completions, **columns})
        out = pipeline(spark.createDataFrame(rows)).select("row", "reward").toPandas().sort_values("row")
        return out["reward"].astype(float).tolist()

    return reward
