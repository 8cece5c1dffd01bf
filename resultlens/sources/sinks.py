"""Sinks: JSON, text, parquet and CSV outputs, exports in evaluators' formats, overwrite rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import export_line, export_pair
from ..operators.etl import keep_larger, prompt_ids


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Atomic by Spark's commit protocol."""
    df.write.mode("overwrite").parquet(path)


def write_failed(df: DataFrame, path: str, ok: str = "ok") -> None:
    df.where(~F.coalesce(F.col(ok), F.lit(False))).write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_timeouts(cache: DataFrame, path: str) -> None:
    """A line for each entry that timed out."""
    lines = cache.where("status = 'timeout'").select(F.concat_ws("\t", "dataset", "db", "sql", F.coalesce("error", F.lit(""))).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_per_sample(rows: DataFrame, path: str, key: str = "instance_id") -> None:
    """A folder for each sample."""
    rows.write.mode("overwrite").partitionBy(key).option("header", "true").csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """One result as one CSV file of that name, with its header. A result is capped before (see ``execute``), so one task writes it."""
    spark, place = rows.sparkSession, rows.sparkSession._jvm.org.apache.hadoop.fs.Path
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}-parts")
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(place(f"{path}-parts")) if f.getPath().getName().startswith("part-"))
    files.delete(place(path), True)
    files.rename(part, place(path))
    files.delete(place(f"{path}-parts"), True)


def write_cache(fresh: DataFrame, path: str, most: int = 50_000) -> bool:
    """Overwrite the cache at path if the fresh one is larger, and not too large; whether it was written."""
    spark = fresh.sparkSession
    try:
        disk = spark.read.parquet(path)
    except Exception as e:
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):  # no folder, or an empty one
            raise
        disk = None
    if not keep_larger(disk, fresh, most):
        return False
    fresh.write.mode("overwrite").parquet(path)
    return True


def pairs_export(rows: DataFrame) -> DataFrame:
    """value: [question, sql and database], ordered by numeric sample_id."""
    value = F.to_json(F.array("question", export_pair(F.col("sql"), F.col("db_id"))))
    return rows.select(F.col("sample_id").cast("long").alias("n"), value.alias("value")).orderBy("n").select("value")


def lines_export(rows: DataFrame) -> DataFrame:
    """line (its place, from 0), sample_id, value: one line of SQL a sample, in the order of sample_id. line and sample_id are the index mapping."""
    ordered = rows.select(F.col("sample_id").cast("long").alias("sample_id"), export_line(F.col("sql")).alias("value"))
    numbered = prompt_ids(ordered, ["sample_id", "value"]).withColumn("line", F.substring("prompt_id", 8, 20).cast("long"))
    return numbered.select("line", "sample_id", "value").orderBy("line")


def write_lines(rows: DataFrame, path: str) -> None:
    """path/lines (text, in order) and path/mapping (line, sample_id)."""
    out = lines_export(rows)
    out.select("value").write.mode("overwrite").text(f"{path}/lines")
    out.select("line", "sample_id").write.mode("overwrite").option("header", "true").csv(f"{path}/mapping")


def write_samples(samples: DataFrame, rows: DataFrame, path: str, key: str = "instance_id") -> None:
    """A folder for each sample below result (its rows as CSV), sql (its statement) and log (its log). samples: key, sql, log; rows: key and the columns of the results."""
    write_per_sample(rows, f"{path}/result", key)
    for name in ("sql", "log"):
        samples.select(key, F.coalesce(name, F.lit("")).alias("value")).write.mode("overwrite").partitionBy(key).text(f"{path}/{name}")


def train_test(rows: DataFrame, path: str, order: str = "prompt_id", test: int = 10) -> None:
    """train_sft holds all rows, test_sft the first ten (which overlap)."""
    rows.write.mode("overwrite").parquet(f"{path}/train_sft")
    rows.orderBy(order).limit(test).write.mode("overwrite").parquet(f"{path}/test_sft")


def report(df: DataFrame, columns: Sequence[str], most: int = 100) -> str:
    """A fixed-width table of at most `most` rows."""
    rows = [tuple(str(v) for v in r) for r in df.select(*columns).limit(most).collect()]
    width = [max(len(x) for x in column) for column in zip(columns, *rows, strict=True)]
    return "\n".join(" ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in (tuple(columns), *rows))
