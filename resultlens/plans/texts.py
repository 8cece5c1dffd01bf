"""Queries over smaller text functions, column gates and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import compare, text
from ..operators import etl, metrics
from . import bindings as b
from .catalogue import query
from .evaluation import INFRA

_TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


@query("schema_prompt", "SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'Database Schema: ' || text END AS prompt FROM conversations")
def _(spark, d):
    c = b.t(spark, d, "conversations")
    content = F.concat(F.when(F.col("turn") % 3 == 0, "Database Schema: ").otherwise(""), "text")
    talk = F.array(F.struct(F.lit("system").alias("role"), F.lit("Database Schema: of no user").alias("content")), F.struct("role", content.alias("content")))
    return c.select("conv_id", "turn", text.schema_prompt(talk).alias("prompt"))


@query("truncate_tokens", f"SELECT doc_id, array_to_string({_TOKENS}[1:50], ' ') AS cut FROM documents")
def _(spark, d):
    return b.t(spark, d, "documents").select("doc_id", text.truncate_tokens(F.col("text"), 50).alias("cut"))


@query("reasoning_id", "SELECT doc_id, 'reasoning_' || source || '_' || substr(sha1('set' || chr(0) || source || chr(0) || text), 1, 16) AS id FROM documents")
def _(spark, d):
    return b.t(spark, d, "documents").select("doc_id", text.reasoning_id(F.lit("set"), F.col("source"), F.col("text")).alias("id"))


@query("extract_think_lenient", rf"""WITH {b.COMPLETIONS} SELECT doc_id, CASE WHEN contains(completion, '</think>') THEN nullif(regexp_replace(regexp_replace(string_split(completion, '</think>')[1], '^.*?<think>', '', 's'), '^\s+|\s+$', '', 'g'), '') END AS thought FROM completions""")
def _(spark, d):
    return b.completions(spark, d).select("doc_id", text.extract_thought_lenient(F.col("completion")).alias("thought"))


@query("moments", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events")
def _(spark, d):
    """Moments of the table are of no zone, and taken as of UTC."""
    return b.t(spark, d, "events").select("event_id", text.utc_text(F.to_utc_timestamp(F.col("ts").cast("timestamp_ltz"), "UTC")).alias("at"))


@query("preferred_order", """SELECT difficulty, row_number() OVER (ORDER BY CASE difficulty WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'overall' THEN 3 ELSE 2 END, difficulty) AS place
FROM (SELECT DISTINCT event_type AS difficulty FROM events UNION ALL SELECT 'overall')""")  # fmt: skip
def _(spark, d):
    levels = metrics.by_level(b.ratios(spark, d), "difficulty", F.count(F.lit(1)).alias("n"))
    return levels.select("difficulty", F.row_number().over(Window.orderBy(*metrics.preferred_order(first=("view", "click")))).cast("long").alias("place"))  # a row a level


@query("sample_key", """SELECT conv_id, turn, coalesce(nullif(nullif(CAST(turn AS VARCHAR), '0'), ''), nullif(role, ''), CAST(conv_id AS VARCHAR)) AS faithful, CAST(turn AS VARCHAR) AS first FROM conversations""")
def _(spark, d):
    c, ids = b.t(spark, d, "conversations"), (F.col("turn"), F.col("role"))
    return c.select("conv_id", "turn", etl.sample_key(*ids, row=F.col("conv_id")).alias("faithful"), etl.sample_key(*ids, row=F.col("conv_id"), faithful=False).alias("first"))


@query("same_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    """A result in the order of its ground truth's columns, which another set of names would not get."""
    c = b.t(spark, d, "customer")
    gold = etl.require(c, "c_custkey", "c_name", "c_acctbal").select("c_custkey", "c_name", "c_acctbal")
    assert compare.same_columns(c, gold) is None
    return compare.same_columns(c.select("c_acctbal", "c_custkey", "c_name"), gold)


_CLASS = f"CASE WHEN idx % 11 = 10 THEN 'empty' WHEN status IS NULL THEN 'no result' WHEN idx % 9 = 8 THEN 'bad format' WHEN ok THEN 'success' WHEN {INFRA} OR contains(lower(error), 'connection') THEN 'infrastructure' ELSE 'syntax' END"


@query("result_taxonomy", f"WITH {b.CAND}, {b.GT_CACHE} SELECT {_CLASS} AS class, count(*) AS n FROM cand LEFT JOIN gt_cache USING (result_id) GROUP BY ALL")
def _(spark, d):
    """Candidates by what became of them; some have no SQL, some no envelope, and some one that is broken."""
    rows = etl.with_cache(b.cand(spark, d), b.gt_cache(spark, d), ["result_id"])
    envelope = F.when(F.col("idx") % 9 == 8, F.lit("<html>")).otherwise(F.to_json(F.struct("ok", "error")))
    sql = F.when(F.col("idx") % 11 == 10, " \n").otherwise(F.col("sql_text"))
    return rows.groupBy(text.result_taxonomy(sql, F.col("status").isNotNull(), envelope).alias("class")).agg(F.count(F.lit(1)).alias("n"))
