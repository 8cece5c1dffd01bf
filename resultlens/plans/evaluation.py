"""Queries over execution, comparison, voting and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare, text
from ..operators import etl, execute, metrics, vote
from . import bindings as b
from .catalogue import query
from .sqlsurface import database

#: The text row of a result: its values sorted, joined.
ROWSTR = "array_to_string(list_sort([c1, c2, CAST(c3 AS VARCHAR)]), '|')"
#: Signatures of one-column results (c3), which the value-aware vote needs.
SIGNED = f"""{b.CAND}, {b.CELLS}, keys AS (SELECT result_id, string_agg(k, ';' ORDER BY k) AS v FROM (SELECT DISTINCT result_id, CAST(c3 AS VARCHAR) AS k FROM cells) GROUP BY result_id),
signed AS (SELECT c.*, CASE WHEN ok THEN 'SUCCESS_VALUES:' || substring(coalesce(v, ''), 1, 200) ELSE 'ERROR: ' || error END AS signature FROM cand c LEFT JOIN keys USING (result_id)),
grouped AS (SELECT sample_id, signature, count(*) AS size, min(idx) AS min_idx FROM signed WHERE ok GROUP BY ALL),
judged AS (SELECT *, substring(signature, 16) AS v FROM grouped),
useful AS (SELECT *, trim(v) <> '' AND NOT (len(list_filter(string_split(v, ';'), lambda x: regexp_full_match(x, '[0-9]+'))) > 0 AND len(list_filter(string_split(v, ';'), lambda x: regexp_full_match(x, '[0-9]+') AND x <> '0')) = 0) AS keep FROM judged),
vav AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY keep DESC, size DESC, signature DESC) AS place FROM useful),
majority AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY size DESC, min_idx) AS place FROM grouped),
samples AS (SELECT DISTINCT sample_id FROM cand),
chosen AS (SELECT sample_id, coalesce(signature, 'NO_RESULTS') AS signature, coalesce(size, 0) AS size, coalesce(min_idx, -1) AS selected_idx FROM samples LEFT JOIN (SELECT * FROM vav WHERE place = 1) USING (sample_id)),
gold AS (SELECT sample_id, signature AS gold_signature FROM signed WHERE idx = 0)"""
INFRA = "regexp_matches(lower(error), 'timeout|network|http|request|api|server|service unavailable|timed out|connection refused|connection timeout|database connection|connection pool')"


def signed(spark: SparkSession, d: str) -> DataFrame:
    return compare.signatures(b.cand(spark, d), b.bag(spark, d).select("result_id", "c3"), ["c3"])


def gold(s: DataFrame) -> DataFrame:
    return s.where("idx = 0").select("sample_id", F.col("signature").alias("gold_signature"))


@query("scan_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    catalog, db = database(d)
    return execute.plan(spark.newSession(), catalog, "set", db, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")


@query("classify_statement", f"WITH {b.CAND} SELECT result_id, upper(string_split_regex(trim(sql_text), '\\s+')[1]) AS kind, regexp_matches(lower(ltrim(sql_text)), '^(select|with|explain)') AS is_select, 'read_only' AS mode FROM cand")
def _(spark, d):
    s = F.col("sql_text")
    return b.cand(spark, d).select("result_id", text.statement_type(s).alias("kind"), text.is_select(s).alias("is_select"), text.execution_mode(s).alias("mode"))


_STATEMENTS = "CASE o_orderkey % 4 WHEN 0 THEN ' insert into t values (1)' WHEN 1 THEN 'SELECT 1' WHEN 2 THEN 'Drop table t' ELSE '' END"


@query("reject_writes", f"SELECT o_orderkey, regexp_matches(upper(trim(s)), '^({'|'.join(text.WRITE_PREFIXES)})') AS rejected, CASE WHEN s = '' THEN 'UNKNOWN' ELSE upper(string_split(trim(s), ' ')[1]) END AS kind FROM (SELECT o_orderkey, {_STATEMENTS} AS s FROM orders)")
def _(spark, d):
    s = b.t(spark, d, "orders").select("o_orderkey", F.expr(_STATEMENTS).alias("s"))
    return s.select("o_orderkey", text.is_write(F.col("s")).alias("rejected"), text.statement_type(F.col("s")).alias("kind"))


def _equality(name: str, mode: str, key: str) -> None:
    sql = f"""WITH {b.CAND}, {b.CELLS}, {b.PAIRS}, sets AS (SELECT result_id, list_sort(list(DISTINCT {key})) AS keys FROM cells GROUP BY result_id)
    SELECT p.sample_id, p.idx, coalesce(x.keys, []) = coalesce(y.keys, []) AS equal FROM pairs p LEFT JOIN sets x ON x.result_id = pred_id LEFT JOIN sets y ON y.result_id = gold_id"""

    @query(name, sql)
    def _(spark, d):
        return compare.compare_sets(b.pairs(spark, d), b.bag(spark, d), ["c2", "c1", "c3"], mode).select("sample_id", "idx", "equal")


_equality("result_eq_positional", "positional", "c2 || '|' || c1 || '|' || c3")
_equality("result_eq_agnostic", "agnostic", ROWSTR)
_equality("result_eq_named", "named", "c1 || '|' || c2 || '|' || c3")
_equality("result_eq_raw", "raw", "c2 || '|' || c1 || '|' || c3")


@query("result_eq_with_bars", f"""WITH {b.CAND}, {b.PAIRS}, texts AS (SELECT l_orderkey AS result_id, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || '|s' || l_linestatus ELSE l_returnflag END AS c1, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate::DATE::VARCHAR ELSE l_linestatus || '|s' || l_shipdate::DATE END AS c2, l_discount AS c3 FROM lineitem),
sets AS (SELECT result_id, list_sort(list(DISTINCT {{'a': c1, 'b': c2, 'c': c3}})) AS keys FROM texts GROUP BY result_id)
SELECT p.sample_id, p.idx, coalesce(x.keys, []) = coalesce(y.keys, []) AS equal FROM pairs p LEFT JOIN sets x ON x.result_id = pred_id LEFT JOIN sets y ON y.result_id = gold_id""")
def _(spark, d):
    li = b.t(spark, d, "lineitem")
    even, day = F.col("l_linenumber") % 2 == 0, F.col("l_shipdate").cast("date").cast("string")
    cells = li.select(
        F.col("l_orderkey").alias("result_id"), F.when(even, F.concat("l_returnflag", F.lit("|s"), "l_linestatus")).otherwise(F.col("l_returnflag")).alias("c1"),
        F.when(even, day).otherwise(F.concat("l_linestatus", F.lit("|s"), day)).alias("c2"), F.col("l_discount").alias("c3"),
    )
    return compare.compare_sets(b.pairs(spark, d), cells, ["c1", "c2", "c3"], "positional").select("sample_id", "idx", "equal")


@query("verdict_join", f"""WITH {b.CAND}, v AS (SELECT sample_id, regexp_replace(trim(regexp_replace(sql_text, '[;\\s]+$', '')), '\\s+', ' ', 'g') AS normal_sql, min(result_id % 2) AS verdict FROM cand WHERE ok GROUP BY ALL)
SELECT c.result_id, v.normal_sql, CAST(v.verdict AS BIGINT) AS verdict FROM cand c JOIN v ON v.sample_id = c.sample_id AND v.normal_sql = regexp_replace(trim(regexp_replace(c.sql_text, '[;\\s]+$', '')), '\\s+', ' ', 'g')""")
def _(spark, d):
    c = b.cand(spark, d)
    judged = c.where("ok").select("sample_id", "sql_text", (F.col("result_id") % 2).alias("verdict"))
    return etl.verdicts_of(c, judged, ["sample_id"]).select("result_id", "normal_sql", "verdict")


@query("result_signature", f"""WITH {b.CAND}, {b.CELLS}, keys AS (SELECT result_id, string_agg(k, ';' ORDER BY k) AS v FROM (SELECT DISTINCT result_id, {ROWSTR} AS k FROM cells) GROUP BY result_id)
SELECT result_id, CASE WHEN ok THEN 'SUCCESS_VALUES:' || substring(coalesce(v, ''), 1, 200) ELSE 'ERROR: ' || error END AS signature FROM cand LEFT JOIN keys USING (result_id)""")
def _(spark, d):
    return compare.signatures(b.cand(spark, d), b.bag(spark, d), ["c1", "c2", "c3"]).select("result_id", "signature")


@query("result_groups", f"WITH {SIGNED} SELECT sample_id, signature, size, min_idx FROM grouped")
def _(spark, d):
    return vote.groups(signed(spark, d))


_GRADED = f"""{b.CAND}, {b.CELLS}, {b.PAIRS}, keyed AS (SELECT result_id, pos, lower(c1) || '|' || lower(c2) || '|' || c3 AS key FROM cells),
ranked AS (SELECT result_id, key, row_number() OVER (PARTITION BY result_id, key ORDER BY pos) AS nth, row_number() OVER (PARTITION BY result_id ORDER BY pos) AS rank FROM keyed),
sizes AS (SELECT result_id, count(*) AS n FROM keyed GROUP BY result_id),
common AS (SELECT p.sample_id, p.idx, count(*) AS k, sum((x.rank - y.rank) * (x.rank - y.rank)) AS d2, sum(abs(x.rank - y.rank)) AS d1 FROM pairs p JOIN ranked x ON x.result_id = pred_id JOIN ranked y ON y.result_id = gold_id AND x.key = y.key AND x.nth = y.nth GROUP BY ALL),
parts AS (SELECT p.sample_id, p.idx, CAST(coalesce(k, 0) AS DOUBLE) / greatest(coalesce(a.n, 0), coalesce(z.n, 0), 1) AS coverage, coalesce(k, 0) AS k, CAST(d1 AS DOUBLE) AS d1, CAST(d2 AS DOUBLE) AS d2
  FROM pairs p LEFT JOIN common c ON c.sample_id = p.sample_id AND c.idx = p.idx LEFT JOIN sizes a ON a.result_id = pred_id LEFT JOIN sizes z ON z.result_id = gold_id),
ordered AS (SELECT *, CASE WHEN k <= 1 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (2 - 6 * d2 / (CAST(k AS DOUBLE) * (k * k - 1))) / 2)) END AS spearman, CASE WHEN k <= 1 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - d1 / floor(k * k / 2))) END AS footrule FROM parts)"""


def _graded(spark, d, mode="rankcorr"):
    return compare.graded(b.pairs(spark, d), b.cells(spark, d), ["c1", "c2", "c3"], "pos", mode)


@query("graded_coverage", f"WITH {_GRADED} SELECT sample_id, idx, round(coverage, 6) AS coverage FROM ordered")
def _(spark, d):
    return _graded(spark, d).select("sample_id", "idx", F.round("coverage", 6).alias("coverage"))


@query("graded_spearman", f"WITH {_GRADED} SELECT sample_id, idx, round(spearman, 6) AS order_score FROM ordered")
def _(spark, d):
    return _graded(spark, d).select("sample_id", "idx", F.round("order_score", 6).alias("order_score"))


@query("graded_footrule", f"WITH {_GRADED} SELECT sample_id, idx, round(footrule, 6) AS order_score FROM ordered")
def _(spark, d):
    return _graded(spark, d, "footrule").select("sample_id", "idx", F.round("order_score", 6).alias("order_score"))


@query("graded_score", f"WITH {_GRADED} SELECT sample_id, idx, round(pow(coverage, 1.2::DOUBLE) * (0.5::DOUBLE * spearman + 0.5::DOUBLE), 6) AS score FROM ordered")
def _(spark, d):
    return _graded(spark, d).select("sample_id", "idx", F.round("score", 6).alias("score"))


@query("error_class", f"""WITH {b.CAND} SELECT result_id, CASE WHEN {INFRA} THEN 'infrastructure' ELSE 'syntax' END AS class, CASE WHEN regexp_matches(lower(error), 'timeout|timed out') THEN 'timeout' WHEN {INFRA} THEN 'infrastructure' END AS tag FROM cand WHERE NOT ok""")
def _(spark, d):
    e = F.col("error")
    return b.cand(spark, d).where("NOT ok").select("result_id", text.error_class(e).alias("class"), text.infra_tag(e).alias("tag"))


@query("error_breakdown_topk", f"""WITH {b.CAND}, n AS (SELECT CASE WHEN {INFRA} THEN 'infrastructure' ELSE 'syntax' END AS error_class, substring(lower(error), 1, 100) AS message, count(*) AS n FROM cand WHERE NOT ok GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY error_class ORDER BY n DESC, message) AS place FROM n) WHERE place <= 20""")
def _(spark, d):
    return metrics.top_errors(b.cand(spark, d))


@query("error_taxonomy", f"""WITH {b.CAND} SELECT CASE WHEN error IS NULL THEN 'none' WHEN {INFRA} OR contains(lower(error), 'connection') THEN 'infrastructure' ELSE 'syntax' END AS class, count(*) AS n FROM cand GROUP BY ALL""")
def _(spark, d):
    return b.cand(spark, d).groupBy(text.error_taxonomy(F.col("error"), F.col("sql_text")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("infra_reason_hist", f"WITH {b.CAND} SELECT substring(error, 1, 120) AS reason, count(*) AS n FROM cand WHERE NOT ok AND {INFRA} GROUP BY ALL")
def _(spark, d):
    return vote.infra_reasons(b.cand(spark, d))


@query("vote_majority", f"WITH {SIGNED} SELECT sample_id, coalesce(signature, 'NO_RESULTS') AS signature, coalesce(size, 0) AS size, coalesce(min_idx, -1) AS selected_idx FROM samples LEFT JOIN (SELECT * FROM majority WHERE place = 1) USING (sample_id)")
def _(spark, d):
    return vote.vote(signed(spark, d), "majority")


@query("vote_value_aware", f"WITH {SIGNED} SELECT * FROM chosen")
def _(spark, d):
    return vote.vote(signed(spark, d))


_RECORD = f"""{SIGNED}, counts AS (SELECT sample_id, count(*) AS n_candidates, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok AND {INFRA}) AS n_infra, count(*) FILTER (NOT ok AND NOT {INFRA}) AS n_syntax FROM cand GROUP BY ALL),
sums AS (SELECT sample_id, count(*) AS n_groups, CAST(sum(size) AS BIGINT) AS n_grouped FROM grouped GROUP BY ALL),
records AS (SELECT c.*, n_candidates, n_ok, n_infra, n_syntax, coalesce(n_groups, 0) AS n_groups, coalesce(n_grouped, 0) AS n_grouped, coalesce(c.signature = gold_signature AND selected_idx >= 0, false) AS is_correct FROM chosen c JOIN counts USING (sample_id) LEFT JOIN sums USING (sample_id) LEFT JOIN gold USING (sample_id))"""


@query("vote_record", f"WITH {_RECORD} SELECT sample_id, signature, size, selected_idx, n_candidates, n_ok, n_infra, n_syntax, n_groups, n_grouped, is_correct FROM records")
def _(spark, d):
    s = signed(spark, d)
    return vote.record(s, gold(s)).drop("gold_signature")


@query("vote_accuracy", f"WITH {_RECORD} SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct, round(avg(CAST(is_correct AS INT)), 6) AS accuracy FROM records")
def _(spark, d):
    s = signed(spark, d)
    return metrics.accuracy(vote.record(s, gold(s)))


@query("vote_summary", f"""WITH {_RECORD} SELECT count(*) AS n_samples, round(avg(CAST(selected_idx >= 0 AS INT)), 6) AS voted_rate, round(avg(CAST(n_ok > 0 AS INT)), 6) AS success_rate, CAST(sum(n_syntax) AS BIGINT) AS syntax_errors,
CAST(sum(n_infra) AS BIGINT) AS infra_errors, round(sum(n_syntax) / sum(n_candidates), 6) AS syntax_rate FROM records""")
def _(spark, d):
    s = signed(spark, d)
    return metrics.vote_summary(vote.record(s, gold(s)))


@query("vote_result_map", f"""WITH {SIGNED} SELECT sample_id, signature, size, place = 1 AS is_majority, coalesce(signature = gold_signature, false) AS is_correct, size AS n_sqls FROM vav LEFT JOIN gold USING (sample_id)""")
def _(spark, d):
    s = signed(spark, d)
    maps = vote.result_groups(s, gold(s)).select("sample_id", F.explode("result_groups").alias("signature", "g"))
    return maps.select("sample_id", "signature", "g.size", "g.is_majority", "g.is_correct", F.size("g.sqls").cast("long").alias("n_sqls"))


_CORRECT = f"""{SIGNED}, results AS (SELECT c.sample_id, c.idx, c.ok, c.sql_text, coalesce(v, '') AS v FROM cand c LEFT JOIN keys USING (result_id)),
candidates AS (SELECT r.*, r.ok AND g.ok AND r.v = g.v AS correct FROM results r JOIN results g ON r.sample_id = g.sample_id AND g.idx = 0)"""


def _candidates(spark, d):
    """Candidates with `correct`: whether they and the ground truth ran, and their results are equal by value."""
    c = b.cand(spark, d)
    gold = c.where("idx = 0").select("sample_id", F.when(F.col("ok"), F.col("result_id")).alias("gold_id"))
    pairs = c.join(gold, "sample_id").withColumn("pred_id", F.when(F.col("ok"), F.col("result_id")))
    return compare.compare_sets(pairs, b.bag(spark, d), ["c3"], "positional").withColumnRenamed("equal", "correct")


@query("any_variant", f"""WITH {b.CAND}, {b.CELLS}, sets AS (SELECT result_id, list_sort(list(DISTINCT {ROWSTR})) AS keys FROM cells GROUP BY result_id),
variants AS (SELECT sample_id, result_id AS gold_id FROM cand WHERE ok AND idx < 3)
SELECT c.sample_id, c.idx, bool_or(coalesce(x.keys, []) = coalesce(y.keys, [])) AS equal FROM cand c JOIN variants USING (sample_id) LEFT JOIN sets x ON x.result_id = c.result_id LEFT JOIN sets y ON y.result_id = gold_id WHERE c.ok GROUP BY ALL""")
def _(spark, d):
    c = b.cand(spark, d).where("ok")
    variants = c.where("idx < 3").select("sample_id", F.col("result_id").alias("gold_id"))
    pairs = c.select("sample_id", "idx", F.col("result_id").alias("pred_id")).join(variants, "sample_id")
    return compare.any_variant(pairs, b.bag(spark, d), ["c1", "c2", "c3"])


@query("recall_at_n", f"""WITH {_CORRECT}, per AS (SELECT sample_id, bool_or(correct) AS c, bool_or(trim(sql_text) <> '') AS s FROM candidates GROUP BY ALL)
SELECT round(avg(CAST(c AS INT)), 6) AS recall, round(avg(CAST(s AS INT)), 6) AS has_sql_rate, count(*) AS n_samples, count(*) FILTER (NOT c) AS n_failed FROM per""")
def _(spark, d):
    return metrics.recall_at_n(_candidates(spark, d))


@query("first_correct", f"WITH {_CORRECT} SELECT sample_id, coalesce(min(idx) FILTER (correct), -1) AS first_correct FROM candidates GROUP BY ALL")
def _(spark, d):
    return metrics.first_correct(_candidates(spark, d))


@query("failed_samples", f"WITH {_CORRECT} SELECT sample_id, count(*) AS n_candidates FROM candidates GROUP BY ALL HAVING NOT bool_or(correct)")
def _(spark, d):
    return metrics.failed_samples(_candidates(spark, d))


@query("recall_at_1_2", f"""WITH {SIGNED}, per AS (SELECT sample_id, bool_or(place <= 1 AND signature = gold_signature) AS a, bool_or(place <= 2 AND signature = gold_signature) AS b FROM vav JOIN gold USING (sample_id) GROUP BY ALL)
SELECT count(*) AS n_samples, round(avg(CAST(a AS INT)), 6) AS recall_at_1, round(avg(CAST(b AS INT)), 6) AS recall_at_2 FROM per""")
def _(spark, d):
    s = signed(spark, d)
    top = vote.top_groups(s, 2).join(gold(s), "sample_id")
    return metrics.recall_top(top.withColumn("correct", F.col("signature") == F.col("gold_signature")))


@query("ex_by_difficulty", f"""WITH {b.RUNS} SELECT CASE WHEN grouping(level) = 1 THEN 'overall' ELSE level END AS difficulty, count(*) AS n, round(avg(CAST(cpn_ok AS INT)) * 100, 4) AS accuracy
FROM (SELECT *, coalesce(difficulty, 'simple') AS level FROM runs) GROUP BY ROLLUP (level)""")
def _(spark, d):
    return metrics.ex_by_level(b.runs(spark, d), correct="cpn_ok")


@query("ves_by_difficulty", f"""WITH {b.RATIOS} SELECT CASE WHEN grouping(difficulty) = 1 THEN 'overall' ELSE difficulty END AS difficulty, count(*) AS n, round(sum(sqrt(abs(ratio))) * 100 / count(*), 4) AS ves FROM ratios GROUP BY ROLLUP (difficulty)""")
def _(spark, d):
    return metrics.ves_by_level(b.ratios(spark, d).withColumn("ratio", F.abs("ratio")))


@query("outlier_trim", f"""WITH {b.RATIOS}, s AS (SELECT *, avg(ratio) OVER w AS m, stddev_pop(ratio) OVER w AS s FROM ratios WINDOW w AS (PARTITION BY sql_idx))
SELECT sql_idx, count(*) FILTER (ratio > m - 3 * s AND ratio < m + 3 * s) AS n_kept, round(coalesce(avg(ratio) FILTER (ratio > m - 3 * s AND ratio < m + 3 * s), 0), 6) AS trimmed_mean FROM s GROUP BY sql_idx""")
def _(spark, d):
    return metrics.trimmed_mean(b.ratios(spark, d), "sql_idx", "ratio")


@query("time_ratio", "SELECT event_type AS sql_idx, round(avg(CASE WHEN user_id <> 0 THEN value / user_id END), 6) AS ratio FROM events GROUP BY event_type")
def _(spark, d):
    return metrics.time_ratio(b.t(spark, d, "events").withColumnRenamed("event_type", "sql_idx"), "sql_idx", "value", "user_id").withColumn("ratio", F.round("ratio", 6))


_SETS = """sets AS (SELECT result_id, count(*) AS n, string_agg(DISTINCT c1 || ':' || c2 || ':' || c3, ';' ORDER BY c1 || ':' || c2 || ':' || c3) AS v FROM cells GROUP BY result_id)"""


def _compared(spark, d):
    """Candidates with the sample's ground truth, whether it ran, and whether both results are equal sets of rows."""
    c = b.cand(spark, d)
    g = c.where("idx = 0").select("sample_id", F.col("result_id").alias("gold_id"), F.col("ok").alias("gold_ok"), F.col("sql_text").alias("gold_sql"))
    rows = c.join(g, "sample_id")
    same = compare.compare_sets(rows.select(F.col("result_id").alias("pred_id"), "gold_id"), b.bag(spark, d), ["c1", "c2", "c3"], "positional")
    return rows.join(same.withColumnRenamed("pred_id", "result_id"), ["result_id", "gold_id"]).withColumns({"pred_ok": F.col("ok"), "pred_error": F.col("error")})


@query("pair_quality", f"""WITH {b.CAND}, {b.CELLS}, {_SETS}, g AS (SELECT sample_id, result_id AS gold_id, ok AS gold_ok FROM cand WHERE idx = 0)
SELECT c.result_id, c.ok AND coalesce(gold_ok, false) AND p.v IS NOT DISTINCT FROM q.v AS execution_correct, CASE WHEN c.ok THEN '' ELSE error END AS pred_error, CASE WHEN c.ok THEN coalesce(p.n, 0) ELSE 0 END AS pred_rows, CASE WHEN gold_ok THEN coalesce(q.n, 0) ELSE 0 END AS gold_rows
FROM cand c JOIN g USING (sample_id) LEFT JOIN sets p ON p.result_id = c.result_id LEFT JOIN sets q ON q.result_id = gold_id""")
def _(spark, d):
    n = b.bag(spark, d).groupBy("result_id").agg(F.count(F.lit(1)).alias("n"))
    rows = _compared(spark, d).join(n.withColumnRenamed("n", "pred_rows"), "result_id", "left").join(n.select(F.col("result_id").alias("gold_id"), F.col("n").alias("gold_rows")), "gold_id", "left")
    return metrics.pair_quality(rows).select("result_id", "execution_correct", "pred_error", "pred_rows", "gold_rows")


@query("verdict_chain", f"""WITH {b.CAND}, {b.CELLS}, {_SETS}, {b.GT_CACHE}, g AS (SELECT sample_id, result_id AS gold_id, ok AS gold_ok FROM cand WHERE idx = 0)
SELECT c.result_id, CASE WHEN c_custkey IS NULL THEN 'missing dataset or db' WHEN sample_id IS NULL THEN 'missing predicted sql' WHEN status IS NULL THEN 'missing ground truth' WHEN NOT ok THEN 'prediction failed'
WHEN NOT (gold_ok AND status = 'rows') THEN 'ground truth failed' WHEN p.v IS DISTINCT FROM q.v THEN 'results differ' ELSE '' END AS reason, reason = '' AS verdict_ok
FROM cand c JOIN g USING (sample_id) LEFT JOIN sets p ON p.result_id = c.result_id LEFT JOIN sets q ON q.result_id = gold_id LEFT JOIN gt_cache t ON t.result_id = gold_id LEFT JOIN customer ON c_custkey = sample_id AND c_acctbal >= 0""")
def _(spark, d):
    """The database of a sample is that of its customer, where the account is not overdrawn; its ground truth is that of the cache."""
    known = b.gt_cache(spark, d).select(F.col("result_id").alias("gold_id"), "status")
    dbs = b.t(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("sample_id"), F.lit("db").alias("db_id"))
    rows = _compared(spark, d).join(known, "gold_id", "left").join(dbs, "sample_id", "left")
    rows = rows.withColumns({"pred_sql": F.col("sql_text"), "gold_sql": F.when(F.col("status").isNotNull(), F.col("gold_sql")), "gold_ok": F.col("gold_ok") & (F.col("status") == "rows")})
    return metrics.verdict(rows).select("result_id", "reason", "verdict_ok")


@query("verdict_dedup", "SELECT o_custkey, CAST(min(o_orderkey % 2) AS BIGINT) AS verdict FROM orders GROUP BY ALL")
def _(spark, d):
    return metrics.least_verdict(b.t(spark, d, "orders").withColumn("verdict", F.col("o_orderkey") % 2), "o_custkey")
