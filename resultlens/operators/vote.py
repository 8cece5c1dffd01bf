"""Grouping the candidates of a sample by result and choosing one: majority, value-aware, top groups, and the full record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_zero, first_line, is_infra, strip

VALUES = "SUCCESS_VALUES:"


def groups(signed: DataFrame) -> DataFrame:
    """sample_id, signature, size, min_idx from successful candidates."""
    return signed.where("ok").groupBy("sample_id", "signature").agg(F.count(F.lit(1)).alias("size"), F.min("idx").alias("min_idx"))


def _useful() -> Column:
    """Whether a group holds values that are neither empty nor all zero."""
    value = F.substring("signature", len(VALUES) + 1, 1 << 30)
    return F.startswith("signature", F.lit(VALUES)) & (strip(value) != "") & ~all_zero(value)


def ranked(grouped: DataFrame, strategy: str = "vav") -> DataFrame:
    """The groups with `place`, 1 for the chosen one. majority: largest, then first seen. vav: useful groups before others, then largest, then greatest signature."""
    if strategy == "majority":
        order = [F.desc("size"), F.asc("min_idx")]
    elif strategy == "vav":
        order = [_useful().desc(), F.desc("size"), F.desc("signature")]
    else:
        raise ValueError(f"no such strategy: {strategy}")
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy("sample_id").orderBy(*order)))


def vote(signed: DataFrame, strategy: str = "vav", fall_back: bool = False) -> DataFrame:
    """One row a sample: signature, size, selected_idx. Samples without a successful candidate: NO_RESULTS, 0 and -1 (or 0 with fall_back)."""
    best = ranked(groups(signed), strategy).where("place = 1").select("sample_id", "signature", "size", F.col("min_idx").alias("selected_idx"))
    out = signed.select("sample_id").distinct().join(best, "sample_id", "left")
    return out.select(
        "sample_id", F.coalesce("signature", F.lit("NO_RESULTS")).alias("signature"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("selected_idx", F.lit(0 if fall_back else -1)).cast("long").alias("selected_idx")
    )


def top_groups(signed: DataFrame, n: int = 2, strategy: str = "vav") -> DataFrame:
    return ranked(groups(signed), strategy).where(F.col("place") <= n)


def record(signed: DataFrame, gold: DataFrame, strategy: str = "vav") -> DataFrame:
    """The record of each sample: group counts, the chosen group, whether it equals the ground truth's signature, and how many candidates failed in which way.

    gold: sample_id, gold_signature. The sizes of all groups sum to the successful candidates."""
    chosen = vote(signed, strategy)
    grouped = groups(signed).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_grouped"))
    infra = is_infra(F.coalesce("error", F.lit("")))
    counts = signed.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok") & infra).alias("n_infra"),
        F.count_if(~F.col("ok") & ~infra).alias("n_syntax"),
    )
    out = chosen.join(counts, "sample_id").join(grouped, "sample_id", "left").join(gold, "sample_id", "left")
    return out.withColumns({
        "n_groups": F.coalesce("n_groups", F.lit(0)).cast("long"),
        "n_grouped": F.coalesce("n_grouped", F.lit(0)).cast("long"),
        "is_correct": F.coalesce((F.col("signature") == F.col("gold_signature")) & (F.col("selected_idx") >= 0), F.lit(False)),
    })


def result_groups(signed: DataFrame, gold: DataFrame, strategy: str = "vav") -> DataFrame:
    """sample_id and a map of signature to (size, is_majority, is_correct, sqls)."""
    members = signed.where("ok").groupBy("sample_id", "signature").agg(F.array_sort(F.collect_list(F.struct("idx", "sql_text"))).alias("m"))
    rows = ranked(groups(signed), strategy).join(members, ["sample_id", "signature"]).join(gold, "sample_id", "left")
    entry = F.struct(
        "size", (F.col("place") == 1).alias("is_majority"), F.coalesce(F.col("signature") == F.col("gold_signature"), F.lit(False)).alias("is_correct"), F.transform("m", lambda x: x["sql_text"]).alias("sqls")
    )
    return rows.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("signature", entry.alias("g")))).alias("result_groups"))


def infra_reasons(signed: DataFrame) -> DataFrame:
    """reason (first line, 120 characters) and how many candidates failed by it."""
    failed = signed.where(~F.col("ok") & is_infra(F.coalesce("error", F.lit(""))))
    return failed.groupBy(first_line(F.col("error")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
