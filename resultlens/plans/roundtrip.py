"""Sources, sinks and caches by round trip: what is written comes back. Files go to the shared folder of the cluster. With them, the identifiers and the filter of responses that go into the files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mapped_name, model_name, path_id
from ..operators import etl
from ..sources import readers, sinks
from ..streaming import memory
from .bindings import CAND, GT_CACHE, POOL, cand, gt_cache, pool, t
from .catalogue import query

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, else (off a cluster) in one of our own, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.master.startswith("local"):
        if "" not in _own:
            _own[""] = tempfile.mkdtemp(prefix="resultlens-")
            atexit.register(shutil.rmtree, _own[""], ignore_errors=True)
        base = f"file://{_own['']}"
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/roundtrip/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)  # when the application ends
    return path


@query("read_datasets", "SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, NULL FROM customer")
def _(spark, d):
    at, o = folder(spark), t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    o.where("state = 'F'").write.parquet(f"{at}/one/train")
    o.where("state <> 'F'").write.parquet(f"{at}/one/test")
    t(spark, d, "customer").select(F.col("c_custkey").alias("id")).write.parquet(f"{at}/two")
    return readers.datasets(spark, [f"{at}/one", f"{at}/two"])


@query("read_json_array", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    at, n = folder(spark), t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(at)
    return readers.json_rows(spark, at, n.schema)


@query("read_gold_lines", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS sample_idx, 'SELECT ' || n_nationkey AS sql, n_name AS db FROM nation")
def _(spark, d):
    at, n = folder(spark), t(spark, d, "nation")
    n.coalesce(1).sortWithinPartitions("n_nationkey").select(F.concat(F.lit("SELECT "), F.col("n_nationkey").cast("string"), F.lit("\t"), "n_name").alias("value")).write.mode("overwrite").text(at)
    return readers.gold_lines(spark, at)


@query("read_find", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(spark, d):
    return readers.find(t(spark, d, "orders"), F.col("o_totalprice") > 100000, ["o_orderkey", "o_totalprice"], 50, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("read_scraped_log", "SELECT event_type AS found, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    at, e = folder(spark), t(spark, d, "events")
    e.select(F.explode(F.array(F.lit("noise"), F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" type: "), "event_type"))).alias("value")).write.mode("overwrite").text(at)
    return readers.scrape(spark, at, r"type: (\w+)").groupBy("found").agg(F.count(F.lit(1)).alias("n"))


@query("read_first_rows", "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 3")
def _(spark, d):
    return readers.first_rows(t(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderkey", 3, "o_orderpriority")


@query("read_candidate_rows", f"WITH {CAND} SELECT sample_id, idx, sql_text, ok FROM cand")
def _(spark, d):
    lists = cand(spark, d).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("idx", "sql_text", "ok"))).alias("x"))  # the candidates of a sample
    return readers.candidate_rows(lists.select("sample_id", F.col("x.sql_text").alias("sql_text"), F.col("x.ok").alias("ok")), ["sql_text", "ok"])


@query("read_cached_results", f"WITH {CAND} SELECT sample_id, idx AS place, idx AS index, result_id FROM cand")
def _(spark, d):
    at, c = folder(spark), cand(spark, d).select("sample_id", F.struct(F.col("idx").alias("index"), "result_id").alias("c"))
    c.groupBy("sample_id").agg(F.reverse(F.sort_array(F.collect_list("c"))).alias("candidates")).write.mode("overwrite").parquet(at)
    return readers.cached_results(spark, at).select("sample_id", F.posexplode("candidates").alias("place", "c")).select("sample_id", F.col("place").cast("long").alias("place"), "c.*")


@query("sink_json", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    at, e = folder(spark), t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    sinks.write_json(e, at)
    return spark.read.schema(e.schema).json(at)


@query("sink_failed", f"WITH {CAND} SELECT sample_id, idx, error FROM cand WHERE NOT ok")
def _(spark, d):
    at, c = folder(spark), cand(spark, d)
    sinks.write_failed(c, at)
    return spark.read.schema(c.schema).json(at).select("sample_id", "idx", "error")


@query("sink_summary", f"WITH {CAND} SELECT ok, count(*) AS n FROM cand GROUP BY ok")
def _(spark, d):
    at, s = folder(spark), cand(spark, d).groupBy("ok").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_summary(s, at)
    return spark.read.schema(s.schema).option("header", "true").csv(at)


@query("sink_timeouts", f"WITH {GT_CACHE} SELECT 'set' || chr(9) || 'db' || chr(9) || 'SELECT ' || result_id || chr(9) || 'late' AS value FROM gt_cache WHERE status = 'timeout'")
def _(spark, d):
    at, sql = folder(spark), F.concat(F.lit("SELECT "), F.col("result_id").cast("string"))
    sinks.write_timeouts(gt_cache(spark, d).select("status", F.lit("set").alias("dataset"), F.lit("db").alias("db"), sql.alias("sql"), F.lit("late").alias("error")), at)
    return spark.read.text(at)


@query("sink_per_sample", "SELECT c_mktsegment AS instance_id, c_custkey, c_nationkey FROM customer")
def _(spark, d):
    at, c = folder(spark), t(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("instance_id"))
    sinks.write_per_sample(c, at)
    return spark.read.schema(c.schema).option("header", "true").csv(at)


@query("sink_train_test", "SELECT 'train' AS split, o_orderkey FROM orders UNION ALL SELECT 'test', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10)")
def _(spark, d):
    at = folder(spark)
    sinks.train_test(t(spark, d, "orders").select("o_orderkey"), at, "o_orderkey")
    return spark.read.parquet(f"{at}/train_sft").select(F.lit("train").alias("split"), "o_orderkey").unionByName(spark.read.parquet(f"{at}/test_sft").select(F.lit("test").alias("split"), "o_orderkey"))


@query("sink_keep_larger", "SELECT true AS first, false AS smaller, false AS too_large, o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def _(spark, d):
    at, o = folder(spark), t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    part = o.where("o_orderstatus <> 'P'").select("o_orderkey")
    wrote = (sinks.write_cache(part, at, 1 << 30), sinks.write_cache(o.where("o_orderstatus = 'P'").select("o_orderkey"), at, 1 << 30), sinks.write_cache(o.select("o_orderkey"), at, 1))
    return spark.read.parquet(at).select(*(F.lit(w).alias(n) for w, n in zip(wrote, ("first", "smaller", "too_large"), strict=True)), "o_orderkey")


@query("sink_lines", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line, o_orderkey AS sample_id FROM orders")
def _(spark, d):
    at, key = folder(spark), F.col("o_orderkey").cast("string")
    sinks.write_lines(t(spark, d, "orders").select(key.alias("sample_id"), F.concat(F.lit("SELECT\n "), key).alias("sql")), at)
    return spark.read.schema("line long, sample_id long").option("header", "true").csv(f"{at}/mapping")


@query("stream_fill_cache", "SELECT DISTINCT o_custkey, 'rows' AS status FROM orders")
def _(spark, d):
    """A cache filled by a stream in several batches, all of which run once more."""
    at, o = folder(spark), t(spark, d, "orders").select("o_custkey")
    o.repartition(3).write.parquet(f"{at}/in")
    for again in range(2):
        stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        memory.fill_cache(stream, f"{at}/cache", f"{at}/state{again}", ["o_custkey"], lambda df: df.withColumn("status", F.lit("rows"))).awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/cache").select("o_custkey", "status")


@query("cache_merge_successes", f"""WITH {CAND}, old AS (SELECT result_id, 'old' AS status FROM cand WHERE idx = 0)
SELECT result_id, status FROM old UNION ALL SELECT result_id, 'new' FROM cand WHERE ok AND idx % 5 <> 4 AND result_id NOT IN (SELECT result_id FROM old)""")  # fmt: skip
def _(spark, d) -> DataFrame:
    c = cand(spark, d)
    new = c.select("result_id", F.lit("new").alias("status"), "ok", (F.col("idx") % 5 == 4).alias("timed_out"))
    return memory.merge_successes(c.where("idx = 0").select("result_id", F.lit("old").alias("status")), new, ["result_id"]).select("result_id", "status")


@query("composed_ids", f"""WITH {POOL} SELECT sample_id, turn, concat_ws('_', 'reasoning', sample_id, model_name) AS path, CASE model_name WHEN 'user' THEN 'person' ELSE model_name END AS mapped,
CASE WHEN turn % 2 = 0 THEN model_name || '--low' ELSE model_name END AS named FROM pool""")  # fmt: skip
def _(spark, d):
    name, effort = F.col("model_name"), F.when(F.col("turn") % 2 == 0, "low").otherwise("none")
    return pool(spark, d).select("sample_id", "turn", path_id(F.col("sample_id"), name).alias("path"), mapped_name(name, {"user": "person"}).alias("mapped"), model_name(name, effort).alias("named"))


@query("correct_responses", f"WITH {POOL} SELECT sample_id, turn, response FROM pool WHERE ok AND response IS NOT NULL AND sample_id % 3 = 0 AND model_name = 'assistant' AND length(response) >= 50")
def _(spark, d):
    third = F.col("sample_id") % 3
    found = pool(spark, d).withColumn("is_execution_correct", F.when(third == 0, True).when(third == 1, False))
    return etl.correct_responses(found, "assistant").select("sample_id", "turn", "response")
