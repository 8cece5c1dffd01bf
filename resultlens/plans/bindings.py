"""Test shapes built from the star schema: candidates, their result rows, caches, thoughts, completions, memory, runs, ratios, pools. Each has its DataFrame and, for the
independent engine, its SQL as a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: the errors of candidates, by key modulo 5
ERRORS = ("no such column: capital", "near FROM: syntax error", "interrupted", "HTTP 504: timed out", "no such table: t1")


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cand(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    ok = F.col("o_orderstatus") != "P"
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(
        F.col("o_custkey").alias("sample_id"), (nth - 1).cast("long").alias("idx"), F.col("o_orderkey").alias("result_id"), ok.alias("ok"),
        F.when(~ok, F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("error"),
        F.concat(F.lit(" SELECT  * FROM t"), (F.col("o_orderkey") % 50).cast("string"), F.lit(" ;")).alias("sql_text"),
    )


CAND = f"""cand AS (SELECT o_custkey AS sample_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, o_orderkey AS result_id, o_orderstatus <> 'P' AS ok,
  CASE WHEN o_orderstatus = 'P' THEN ({list(ERRORS)})[o_orderkey % 5 + 1] END AS error, ' SELECT  * FROM t' || (o_orderkey % 50) || ' ;' AS sql_text FROM orders)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """result_id, pos, c1, c2, c3."""
    li = t(spark, d, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return li.select(F.col("l_orderkey").alias("result_id"), pos.cast("long").alias("pos"), F.col("l_returnflag").alias("c1"), F.col("l_linestatus").alias("c2"), F.floor(F.col("l_discount") * 20).cast("long").alias("c3"))


def bag(spark: SparkSession, d: str) -> DataFrame:
    """The cells without positions, where order plays no part."""
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("result_id"), F.col("l_returnflag").alias("c1"), F.col("l_linestatus").alias("c2"), F.floor(F.col("l_discount") * 20).cast("long").alias("c3"))


CELLS = """cells AS (SELECT l_orderkey AS result_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos,
  l_returnflag AS c1, l_linestatus AS c2, CAST(floor(l_discount * 20) AS BIGINT) AS c3 FROM lineitem)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, idx, pred_id, gold_id: candidates that ran, against the sample's first candidate if that ran."""
    c = cand(spark, d).where("ok")
    gold = c.where("idx = 0").select("sample_id", F.col("result_id").alias("gold_id"))
    return c.select("sample_id", "idx", F.col("result_id").alias("pred_id")).join(gold, "sample_id")


PAIRS = "pairs AS (SELECT c.sample_id, c.idx, c.result_id AS pred_id, g.result_id AS gold_id FROM cand c JOIN cand g ON c.sample_id = g.sample_id AND g.idx = 0 WHERE c.ok AND g.ok)"


def gt_cache(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, "timeout").when(k % 11 == 0, "failed").otherwise("rows")
    n = bag(spark, d).groupBy("result_id").agg(F.count(F.lit(1)).alias("n_rows"))
    o = t(spark, d, "orders").where(k % 3 != 0).select(k.alias("result_id"), status.alias("status"))
    return o.join(n, "result_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


GT_CACHE = """gt_cache AS (SELECT o_orderkey AS result_id, CASE WHEN o_orderkey % 7 = 0 THEN 'timeout' WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'rows' END AS status,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_rows FROM orders WHERE o_orderkey % 3 <> 0)"""


def thoughts(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    word = lambda k: F.regexp_replace(F.lower(F.coalesce(F.get(F.split(F.trim("text"), r"[ \t\n]+"), k), F.lit(""))), "[^a-z0-9_]", "")
    out = docs.select("doc_id", F.col("source").alias("db_id"), "text", word(0).alias("w1"), word(1).alias("w2"))
    return out.withColumn("prompt", F.concat(F.lit("t."), "w1", F.lit(" : x t."), "w2", F.lit(" : y")))


THOUGHTS = r"""thoughts AS (SELECT *, 't.' || w1 || ' : x t.' || w2 || ' : y' AS prompt FROM (SELECT doc_id, source AS db_id, text,
  regexp_replace(lower(coalesce(string_split_regex(trim(text), '[ \t\n]+')[1], '')), '[^a-z0-9_]', '', 'g') AS w1,
  regexp_replace(lower(coalesce(string_split_regex(trim(text), '[ \t\n]+')[2], '')), '[^a-z0-9_]', '', 'g') AS w2 FROM documents))"""


def completions(spark: SparkSession, d: str) -> DataFrame:
    th = thoughts(spark, d).select("doc_id", "text")
    k = F.col("doc_id") % 5
    body = F.replace(F.col("text"), F.lit("<"), F.lit(" "))
    text = (
        F.when(k == 0, F.concat(F.lit("so <think>"), body, F.lit("</think> SELECT 1")))
        .when(k == 1, F.concat(F.lit("<think>"), body, F.lit(" SELECT 1")))
        .when(k == 2, F.concat(F.lit("<think>"), body, F.lit("</think>  ")))
        .when(k == 3, F.lit("<think>short</think> SELECT 1"))
        .otherwise(F.concat(F.lit(" <think>"), body, F.lit("</think>\n SELECT  2 ;")))
    )
    return th.select("doc_id", text.alias("completion"))


COMPLETIONS = """completions AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'so <think>' || body || '</think> SELECT 1' WHEN 1 THEN '<think>' || body || ' SELECT 1' WHEN 2 THEN '<think>' || body || '</think>  '
  WHEN 3 THEN '<think>short</think> SELECT 1' ELSE ' <think>' || body || '</think>' || chr(10) || ' SELECT  2 ;' END AS completion FROM (SELECT doc_id, replace(text, '<', ' ') AS body FROM documents))"""


def memory(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("db_id"), "embedding", (F.col("vec_id") % 4 != 0).alias("is_correct"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    return memory(spark, d).where("id % 100 = 0").select("id", "db_id", "embedding")


MEMORY = "memory AS (SELECT vec_id AS id, label AS db_id, CAST(embedding AS DOUBLE[]) AS embedding, vec_id % 4 <> 0 AS is_correct FROM embeddings), probes AS (SELECT * FROM memory WHERE id % 100 = 0)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id")
    level = F.element_at(F.array(F.lit("simple"), F.lit("moderate"), F.lit("challenging"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    return j.select(F.col("doc_id").alias("sample_id"), (F.col("toxic") == 1).alias("cp0_ok"), (F.col("quality") == 1).alias("cpn_ok"), level.alias("difficulty"), F.length("text").cast("long").alias("n_chars"))


RUNS = "runs AS (SELECT doc_id AS sample_id, toxic = 1 AS cp0_ok, quality = 1 AS cpn_ok, (['simple', 'moderate', 'challenging', NULL])[doc_id % 4 + 1] AS difficulty, length(text) AS n_chars FROM labels JOIN documents USING (doc_id))"


def ratios(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("user_id").alias("sql_idx"), F.col("event_type").alias("difficulty"), F.col("value").alias("ratio"))


RATIOS = "ratios AS (SELECT user_id AS sql_idx, event_type AS difficulty, value AS ratio FROM events)"


def pool(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("sample_id"), "turn", F.col("role").alias("model_name"), F.col("text").alias("response"), ((F.col("conv_id") + F.col("turn")) % 7 != 0).alias("ok"))


POOL = "pool AS (SELECT conv_id AS sample_id, turn, role AS model_name, text AS response, (conv_id + turn) % 7 <> 0 AS ok FROM conversations)"
