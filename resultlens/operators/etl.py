"""Building and merging tables: filters with their accounting, cache joins, merges, upserts, stratified limits, training rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.text import append_answer, normalize_sql

#: Names of models that are broadcast.
MAX_MODELS = 100_000

def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_cache(samples: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples with the cache's columns, null where it misses."""
    return samples.join(cache, list(keys), "left")


def cached_hits(candidates: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates with cached results; only successes that did not time out are hits."""
    return candidates.join(cache.where(F.col("ok") & ~F.coalesce("timed_out", F.lit(False))).drop("ok", "timed_out"), list(keys), "left")


def misses(entries: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    return entries.join(cache.select(*keys), list(keys), "left_anti")


def drop_timeouts(samples: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.join(cache.where("status = 'timeout'").select(*keys), list(keys), "left_anti")


def drop_empty_truth(samples: DataFrame, cache: DataFrame, keys: Sequence[str], n_rows: str = "n_rows") -> DataFrame:
    """Samples whose ground truth is known to be empty go; unknown ones and timeouts stay."""
    known = cache.select(*keys, F.col("status").alias("__s"), F.col(n_rows).alias("__n"))
    return samples.join(known, list(keys), "left").where("__s IS NULL OR __s = 'timeout' OR __n > 0").drop("__s", "__n")


def filter_summary(samples: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """stage, n_before, n_after, rate of conditions applied one after another, in one pass."""
    keep, sums = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for k, cond in enumerate(stages.values(), 1):
        keep = keep & F.coalesce(cond, F.lit(False))
        sums.append(F.count_if(keep).alias(f"n{k}"))
    rows = F.array(*(F.struct(F.lit(name).alias("stage"), F.col(f"n{k}").alias("n_before"), F.col(f"n{k + 1}").alias("n_after")) for k, name in enumerate(stages)))
    out = samples.agg(*sums).select(F.inline(rows))
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("n_after"), F.col("n_before")), F.lit(0.0)), 6))


class StageCounts(StreamingQueryListener):
    """Counts rows before and after conditions that are applied one after another, in the job that applies them: use `filtered` in a batch plan or a stream, and read `summary` once it ran.

    A stream must have this as a listener (spark.streams.addListener); its batches add up."""

    def __init__(self, stages: dict[str, Column], name: str | None = None) -> None:
        self.stages, self.name, self._batch = stages, name or f"stages-{uuid.uuid4().hex[:8]}", Observation()
        self._counts = [0] * (len(stages) + 1)

    def filtered(self, rows: DataFrame) -> DataFrame:
        keep, sums = F.lit(True), [F.count(F.lit(1)).alias("n0")]
        for k, cond in enumerate(self.stages.values(), 1):
            keep = keep & F.coalesce(cond, F.lit(False))
            sums.append(F.count_if(keep).alias(f"n{k}"))
        return (rows.observe(self.name, *sums) if rows.isStreaming else rows.observe(self._batch, *sums)).where(keep)

    def summary(self, spark: SparkSession) -> DataFrame:
        """stage, n_before, n_after, rate."""
        n = self._counts if any(self._counts) else [self._batch.get[f"n{k}"] for k in range(len(self.stages) + 1)]
        rows = [(name, n[k], n[k + 1], round(n[k + 1] / n[k], 6) if n[k] else 0.0) for k, name in enumerate(self.stages)]
        return spark.createDataFrame(rows, "stage string, n_before long, n_after long, rate double")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if seen := event.progress.observedMetrics.get(self.name):
            self._counts = [a + (seen[f"n{k}"] or 0) for k, a in enumerate(self._counts)]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The frame itself if it has all columns; else an error that names those missing."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def prompt_filter(samples: DataFrame, n_tokens: Column, most: int, truths: str = "groundtruth_sqls") -> DataFrame:
    return samples.where((n_tokens <= most) & (F.size(F.coalesce(truths, F.array().cast("array<string>"))) > 0))


def correct_responses(pool: DataFrame, model: str, least: int = 50) -> DataFrame:
    """Responses of one model that succeeded, are execution-correct and long enough."""
    return pool.where(F.col("ok") & F.col("response").isNotNull() & F.col("is_execution_correct").eqNullSafe(F.lit(True)) & (F.col("model_name") == model) & (F.length("response") >= least))


def sample_key(*ids: Column, row: Column, faithful: bool = True) -> Column:
    """First id that is given; in faithful mode 0 and the empty string count as missing."""
    text = [i.cast("string") for i in ids]
    return F.coalesce(*(F.when(~t.isin("", "0"), t) if faithful else t for t in text), row.cast("string"))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def improvements(a: DataFrame, b: DataFrame, levels: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples that a fails and b solves, with their difficulty (unknown without one)."""
    joined = a.select(key, F.col("ok").alias("a_ok")).join(b.select(key, F.col("ok").alias("b_ok"), *[c for c in b.columns if c not in (key, "ok")]), key)
    return joined.where("NOT a_ok AND b_ok").join(levels, key, "left").withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown"))).drop("a_ok", "b_ok")


def noted(left: DataFrame, right: DataFrame, key: str, note: str) -> DataFrame:
    """Left join with a note on rows that found nothing."""
    return left.join(right.withColumn("__hit", F.lit(True)), key, "left").withColumn("note", F.when(F.col("__hit").isNull(), note)).drop("__hit")


def by_position(left: DataFrame, right: DataFrame, index: str = "index") -> DataFrame:
    """Pairs rows of equal index; both sides must have as many rows."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows against {m}")
    return left.join(right, index)


def dedup_sqls(rows: DataFrame, key: str = "sample_id", sql: str = "sql_text", order: str = "idx") -> DataFrame:
    """Of statements that are equal when normalised, the first of each sample."""
    normal = normalize_sql(F.col(sql))
    return rows.withColumn("normal_sql", normal).withColumn("__n", F.row_number().over(Window.partitionBy(key, "normal_sql").orderBy(order))).where("__n = 1").drop("__n")


def merge_sqls(truth: DataFrame, existing: DataFrame, new: DataFrame) -> DataFrame:
    """sample_id, normal_sql, source, position: the ground truth, then existing statements, then new ones, each statement once. Inputs: sample_id, sql_text, idx."""
    ranked = union_all(*(f.select("sample_id", normalize_sql(F.col("sql_text")).alias("normal_sql"), F.lit(k).alias("rank"), F.lit(name).alias("source"), "idx") for k, (f, name) in enumerate(((truth, "truth"), (existing, "existing"), (new, "new")))))
    first = Window.partitionBy("sample_id", "normal_sql").orderBy("rank", "idx")
    ranked = ranked.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return ranked.select("sample_id", "normal_sql", "source", F.row_number().over(Window.partitionBy("sample_id").orderBy("rank", "idx")).cast("long").alias("position"))


def correct_sqls(candidates: DataFrame) -> DataFrame:
    """sample_id and its correct candidates' SQL, in order."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "sql_text")))
    return candidates.where("correct").groupBy("sample_id").agg(F.transform(rows, lambda x: x["sql_text"]).alias("correct_sqls"))


def _last(rows: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    """One row a key: the last by `order`, or any where there is none."""
    if order is None:
        return rows.dropDuplicates(list(keys))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def update_by_key(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of target with the values of changes, null among them, where the key is found; nothing is inserted. Of several changes of a key the last by `order` holds."""
    new = [c for c in changes.columns if c not in keys and c != order]
    own = _last(changes, keys, order).select(*keys, *(F.col(c).alias(f"__{c}") for c in new), F.lit(True).alias("__found"))
    joined = target.join(own, list(keys), "left")
    return joined.select(*(F.when(F.col("__found"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new else c for c in target.columns))


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """New rows replace those of the same key; of several new rows of a key the last by `order` stays."""
    return _last(new, keys, order).unionByName(target.join(new.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def insert_ignore(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key target has are ignored, and all but one of new rows with one key."""
    return target.unionByName(_last(new, keys, None).join(target.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frame itself; an error if a key occurs twice."""
    if twice := df.groupBy(*keys).count().where("count > 1").head(1):
        raise ValueError(f"not unique: {twice[0]}")
    return df


def pending(samples: DataFrame, models: DataFrame, done: DataFrame, retry_failed: bool = False) -> DataFrame:
    """(model_name, sample_id) pairs still to be generated. With retry_failed, pairs that are done but not ok count as pending.

    Every sample meets every model, as the pairs are the answer. Up to MAX_MODELS distinct models are broadcast; more are left to the planner."""
    finished = done.where("ok") if retry_failed else done
    names = models.select("model_name").distinct()
    few = names.limit(MAX_MODELS + 1).count() <= MAX_MODELS
    pairs = samples.select("sample_id").distinct().crossJoin(F.broadcast(names) if few else names)
    return pairs.join(finished.select("model_name", "sample_id"), ["model_name", "sample_id"], "left_anti")


def complete(done: DataFrame, needed: Sequence[str]) -> DataFrame:
    """sample_id and whether all needed models are done for it."""
    return done.groupBy("sample_id").agg((F.size(F.array_except(F.array(*map(F.lit, needed)), F.collect_set("model_name"))) == 0).alias("complete"))


def main_models(pool: DataFrame, least: int) -> DataFrame:
    """model_name and rows of models with more than `least` rows; all models if none has."""
    counts = pool.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("__top", F.max("n").over(Window.partitionBy())).where((F.col("n") > least) | (F.col("__top") <= least)).drop("__top")


def stratified(pool: DataFrame, limit: int, order: Sequence[str], stratum: str = "model_name") -> DataFrame:
    """At most about `limit` rows, of each stratum its share (one at least), first rows first."""
    counts = pool.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    quota = F.least(F.col("__n"), F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(limit) / F.col("__total")))).cast("long")
    quotas = counts.join(F.broadcast(total)).select(stratum, quota.alias("__quota"))  # one row broadcast
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return pool.join(quotas, stratum).withColumn("__r", nth).where("__r <= __quota").drop("__r", "__quota")


def prompt_ids(rows: DataFrame, order: Sequence[str], per: int = 100_000) -> DataFrame:
    """prompt_000000, prompt_000001, ... in order. Positions are found by range: ranges are counted, and numbered within; no task gets all rows."""
    parts = max(1, -(-rows.count() // per))
    dealt = rows.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id())
    if parts > 1:  # ranges are found by sampling, so they are fixed before they are counted
        dealt = dealt.checkpoint()
    ahead = F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    counts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__c")).select("__p", ahead.alias("__ahead"))
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    numbered = dealt.withColumn("__nth", nth).join(counts, "__p")
    return numbered.withColumn("prompt_id", F.format_string("prompt_%06d", F.col("__ahead") + F.col("__nth") - 1)).drop("__p", "__nth", "__ahead")


def sft_rows(pool: DataFrame, order: Sequence[str]) -> DataFrame:
    """prompt_id, sample_id, messages with the answer appended, model_name; rows without response or messages go before numbering."""
    kept = pool.where(F.col("response").isNotNull() & F.col("messages").isNotNull())
    return prompt_ids(kept, order).select("prompt_id", "sample_id", append_answer(F.col("messages"), F.col("response")).alias("messages"), "model_name")


def verdicts_of(chosen: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("db_id",), sql: str = "sql_text", verdict: str = "verdict") -> DataFrame:
    """The chosen statements with the verdict on them, by keys and normalised SQL; where a statement was judged more than once, a 0 wins."""
    normal = normalize_sql(F.col(sql)).alias("normal_sql")
    least = verdicts.select(*keys, normal, verdict).groupBy(*keys, "normal_sql").agg(F.min(verdict).alias(verdict))
    return chosen.withColumn("normal_sql", normalize_sql(F.col(sql))).join(least, [*keys, "normal_sql"])


def columns_by_table(rows: DataFrame, key: str, columns: str) -> DataFrame:
    """key, table and its sorted columns, from arrays of `table.column`."""
    flat = rows.select(key, F.explode(columns).alias("__c")).where(F.contains("__c", F.lit(".")))
    flat = flat.select(key, F.split("__c", r"\.", 2).alias("__p")).select(key, F.get("__p", 0).alias("table"), F.get("__p", 1).alias("column"))
    return flat.groupBy(key, "table").agg(F.array_sort(F.collect_set("column")).alias("columns"))


def keep_larger(disk: DataFrame | None, fresh: DataFrame, most: int = 50_000) -> bool:
    """Whether the fresh cache replaces the one on disk: it must be larger, and no larger than may be saved."""
    n = fresh.limit(most + 1).count()
    return n <= most and (disk is None or disk.count() < n)


def merge_stats(merged: DataFrame) -> DataFrame:
    per = merged.groupBy("sample_id").agg(F.count_if(F.col("source") == "new").alias("new"), F.count_if(F.col("source") != "truth").alias("correct"), F.count(F.lit(1)).alias("all"))
    return per.agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col("correct") > 0).alias("n_with_correct"), F.count_if(F.col("new") > 0).alias("n_with_updates"), F.sum("all").alias("n_sqls"))
