"""Accuracy, recall, efficiency and error reports. Per-level reports with a total are rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import error_class, strip


def recall_at_n(candidates: DataFrame) -> DataFrame:
    """recall (any candidate correct), has_sql_rate, n_samples, n_failed."""
    per = candidates.groupBy("sample_id").agg(F.bool_or("correct").alias("any_correct"), F.bool_or(F.coalesce(strip(F.col("sql_text")), F.lit("")) != "").alias("any_sql"))
    return per.agg(
        F.round(F.avg(F.col("any_correct").cast("int")), 6).alias("recall"), F.round(F.avg(F.col("any_sql").cast("int")), 6).alias("has_sql_rate"), F.count(F.lit(1)).alias("n_samples"), F.count_if(~F.col("any_correct")).alias("n_failed")
    )


def failed_samples(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("sample_id").agg(F.bool_or("correct").alias("c"), F.count(F.lit(1)).alias("n_candidates")).where("NOT c").drop("c")


def first_correct(candidates: DataFrame) -> DataFrame:
    """sample_id and the index of its first correct candidate, -1 without one."""
    return candidates.groupBy("sample_id").agg(F.coalesce(F.min(F.when(F.col("correct"), F.col("idx"))), F.lit(-1)).cast("long").alias("first_correct"))


def recall_top(ranked: DataFrame, n: int = 2) -> DataFrame:
    """recall_at_1 .. recall_at_n of ranked groups (sample_id, place, correct), over samples that have any group."""
    per = ranked.groupBy("sample_id").agg(*(F.bool_or(F.col("correct") & (F.col("place") <= k)).alias(f"c{k}") for k in range(1, n + 1)))
    return per.agg(F.count(F.lit(1)).alias("n_samples"), *(F.round(F.avg(F.coalesce(f"c{k}", F.lit(False)).cast("int")), 6).alias(f"recall_at_{k}") for k in range(1, n + 1)))


def accuracy(records: DataFrame, correct: str = "is_correct") -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(correct).alias("correct"), F.round(F.avg(F.col(correct).cast("int")), 6).alias("accuracy"))


def by_level(df: DataFrame, level: str, *aggregates: Column, missing: str = "simple", total: str = "overall") -> DataFrame:
    """The aggregates by level and over all rows; a missing level counts as `missing`."""
    rolled = df.withColumn(level, F.coalesce(level, F.lit(missing))).rollup(level).agg(*aggregates, F.grouping(level).alias("__all"))
    return rolled.withColumn(level, F.when(F.col("__all") == 1, total).otherwise(F.col(level))).drop("__all")


def ex_by_level(df: DataFrame, level: str = "difficulty", correct: str = "correct") -> DataFrame:
    return by_level(df, level, F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(correct).cast("int")) * 100, 4).alias("accuracy"))


def ves_by_level(df: DataFrame, level: str = "difficulty", ratio: str = "ratio") -> DataFrame:
    """Valid efficiency score: 100 times the mean root of the time ratio."""
    return by_level(df, level, F.count(F.lit(1)).alias("n"), F.round(F.sum(F.sqrt(ratio)) * 100 / F.count(F.lit(1)), 4).alias("ves"))


def trimmed_mean(df: DataFrame, key: str, value: str, sigmas: float = 3.0) -> DataFrame:
    """Mean of the values strictly within so many population deviations; 0 where none is (as for constant values)."""
    w = Window.partitionBy(key)
    spread = df.select(key, value, F.avg(value).over(w).alias("m"), F.stddev_pop(value).over(w).alias("s"))
    inside = (F.col(value) > F.col("m") - sigmas * F.col("s")) & (F.col(value) < F.col("m") + sigmas * F.col("s"))
    return spread.groupBy(key).agg(F.count_if(inside).alias("n_kept"), F.round(F.coalesce(F.avg(F.when(inside, F.col(value))), F.lit(0.0)), 6).alias("trimmed_mean"))


def time_ratio(df: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    """Mean ratio of gold to predicted time over iterations."""
    return df.groupBy(key).agg(F.coalesce(F.avg(F.try_divide(gold, pred)), F.lit(0.0)).alias("ratio"))


def top_errors(candidates: DataFrame, k: int = 20, most: int = 100) -> DataFrame:
    """error_class, message (lower-cased prefix), n, place: the k most common messages of each class."""
    failed = candidates.where(~F.col("ok")).select(error_class(F.col("error")).alias("error_class"), F.substring(F.lower("error"), 1, most).alias("message"))
    counted = failed.groupBy("error_class", "message").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("error_class").orderBy(F.desc("n"), "message"))
    return counted.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def quartiles(df: DataFrame, level: str, value: str, missing: str = "unknown") -> DataFrame:
    """Box-plot statistics by level and overall."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = by_level(df, level, F.count(F.lit(1)).alias("n"), F.min(value).cast("double").alias("low"), q.alias("__q"), F.max(value).cast("double").alias("high"), missing=missing)
    return out.select(level, "n", "low", *(F.round(F.col("__q")[k], 4).alias(f"q{k + 1}") for k in range(3)), "high")


def quartile_sketch(df: DataFrame, level: str, value: str, accuracy: int = 10_000, missing: str = "unknown") -> DataFrame:
    """Box-plot statistics by level and overall from mergeable quantile summaries: a quartile is a value that occurs, whose rank is off by n / accuracy at most. A summary holds some `accuracy` values, however many there are."""
    q = F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(accuracy))
    out = by_level(df, level, F.count(F.lit(1)).alias("n"), F.min(value).cast("double").alias("low"), q.alias("__q"), F.max(value).cast("double").alias("high"), missing=missing)
    return out.select(level, "n", "low", *(F.col("__q")[k].cast("double").alias(f"q{k + 1}") for k in range(3)), "high")


def preferred_order(level: str = "difficulty", first: Sequence[str] = ("simple", "moderate", "challenging"), last: str = "overall") -> list[Column]:
    """Ordering: known levels as listed, then others by name, the total last."""
    rank = F.when(F.col(level) == last, len(first) + 1)
    for k, name in enumerate(first):
        rank = rank.when(F.col(level) == name, k)
    return [rank.otherwise(len(first)).asc(), F.col(level).asc()]


def vote_summary(records: DataFrame) -> DataFrame:
    """Voted-SQL rate, success rate and error totals of voting records."""
    return records.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.round(F.avg((F.col("selected_idx") >= 0).cast("int")), 6).alias("voted_rate"),
        F.round(F.avg((F.col("n_ok") > 0).cast("int")), 6).alias("success_rate"),
        F.sum("n_syntax").alias("syntax_errors"),
        F.sum("n_infra").alias("infra_errors"),
        F.round(F.sum("n_syntax") / F.sum("n_candidates"), 6).alias("syntax_rate"),
    )


def pair_quality(pairs: DataFrame) -> DataFrame:
    """For candidates with pred_ok, gold_ok, equal, errors and row counts: one record with every failure path as false, 0 or empty."""
    both = F.col("pred_ok") & F.coalesce("gold_ok", F.lit(False))
    return pairs.withColumns({
        "has_sql": F.coalesce(strip(F.col("sql_text")), F.lit("")) != "",
        "execution_correct": F.coalesce(both & F.col("equal"), F.lit(False)),
        "pred_error": F.when(F.col("pred_ok"), "").otherwise(F.coalesce("pred_error", F.lit(""))),
        "pred_rows": F.when(F.col("pred_ok"), F.coalesce("pred_rows", F.lit(0))).otherwise(0).cast("long"),
        "gold_rows": F.when(F.coalesce("gold_ok", F.lit(False)), F.coalesce("gold_rows", F.lit(0))).otherwise(0).cast("long"),
    })


def verdict(pairs: DataFrame) -> DataFrame:
    """verdict_ok and reason by the first condition that holds."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    reason = (
        F.when(blank("db_id"), "missing dataset or db")
        .when(blank("pred_sql"), "missing predicted sql")
        .when(blank("gold_sql"), "missing ground truth")
        .when(~F.coalesce("pred_ok", F.lit(False)), "prediction failed")
        .when(~F.coalesce("gold_ok", F.lit(False)), "ground truth failed")
        .when(~F.coalesce("equal", F.lit(False)), "results differ")
    )
    return pairs.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("verdict_ok", F.col("reason") == "")


def least_verdict(verdicts: DataFrame, *keys: str) -> DataFrame:
    """0 for a key if any of its verdicts is 0."""
    return verdicts.groupBy(*keys).agg(F.min("verdict").alias("verdict"))
