"""Queries over text, vectors, caches, merges, runs, pools and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import etl, metrics, reward, sqlops, vectors
from . import bindings as b
from .catalogue import query

WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"
_TH = rf"""{b.THOUGHTS}, words AS (SELECT *, {WORDS} AS n_words, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS toks, list_distinct([w1, w2]) AS cols FROM thoughts)"""


@query("extract_sql", rf"""WITH {b.COMPLETIONS} SELECT doc_id, CASE WHEN contains(completion, '</think>') THEN nullif(regexp_replace(list_last(string_split(completion, '</think>')), '^\s+|\s+$', '', 'g'), '') END AS sql FROM completions""")
def _(spark, d):
    return b.completions(spark, d).select("doc_id", text.extract_sql(F.col("completion")).alias("sql"))


@query("extract_think", rf"""WITH {b.COMPLETIONS} SELECT doc_id, nullif(regexp_replace(regexp_extract(completion, '<think>(.*?)</think>', 1, 's'), '^\s+|\s+$', '', 'g'), '') AS thought FROM completions""")
def _(spark, d):
    return b.completions(spark, d).select("doc_id", text.extract_thought(F.col("completion")).alias("thought"))


_GATE = r"""gate AS (SELECT doc_id, completion, nullif(regexp_replace(regexp_extract(completion, '<think>(.*?)</think>', 1, 's'), '^\s+|\s+$', '', 'g'), '') AS thought, len(string_split(completion, '<think>')) = 2 AND len(string_split(completion, '</think>')) = 2
  AND trim(string_split(completion, '<think>')[1]) = '' AND coalesce(length(nullif(regexp_replace(regexp_extract(completion, '<think>(.*?)</think>', 1, 's'), '^\s+|\s+$', '', 'g'), '')), 0) > 100 AND regexp_replace(list_last(string_split(completion, '</think>')), '^\s+|\s+$', '', 'g') <> '' AS formatted FROM completions)"""


@query("format_gate", f"WITH {b.COMPLETIONS}, {_GATE} SELECT doc_id, formatted FROM gate")
def _(spark, d):
    return b.completions(spark, d).select("doc_id", text.format_gate(F.col("completion")).alias("formatted"))


@query("normalize_sql", rf"WITH {b.CAND} SELECT result_id, regexp_replace(trim(regexp_replace(sql_text, '[;\s]+$', '')), '\s+', ' ', 'g') AS normal_sql FROM cand")
def _(spark, d):
    return b.cand(spark, d).select("result_id", text.normalize_sql(F.col("sql_text")).alias("normal_sql"))


@query("prompt_columns", f"WITH {b.THOUGHTS} SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS columns FROM (SELECT doc_id, CASE WHEN w1 = w2 THEN [w1] ELSE [w1, w2] END AS l, list_filter(l, lambda x: x <> '') AS list_distinct_ordered FROM thoughts)")
def _(spark, d):
    return b.thoughts(spark, d).select("doc_id", F.array_join(text.prompt_columns(F.col("prompt")), ",").alias("columns"))


@query("word_stats", f"WITH {_TH} SELECT doc_id, CAST(n_words AS BIGINT) AS n_words FROM words")
def _(spark, d):
    return b.thoughts(spark, d).select("doc_id", text.word_count(F.col("text")).alias("n_words"))


_TTR = "CASE WHEN len(toks) < 2 THEN 0.0::DOUBLE ELSE CAST(len(list_distinct(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))) AS DOUBLE) / (len(toks) - 1) END"


@query("bigram_ttr", f"WITH {_TH} SELECT doc_id, round({_TTR}, 6) AS ttr FROM words")
def _(spark, d):
    return b.thoughts(spark, d).select("doc_id", F.round(text.bigram_ttr(F.col("text")), 6).alias("ttr"))


_HITS = "list_sum(list_transform(list_filter(cols, lambda c: c <> ''), lambda c: len(regexp_extract_all(' ' || regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_]', '  ', 'g'), '^|$', ' ', 'g') || ' ', ' ' || c || ' '))))"


@query("quality_gate", f"""WITH {_TH}, g AS (SELECT doc_id, n_words, coalesce({_HITS}, 0) AS hits, {_TTR} AS ttr, len(list_filter(cols, lambda c: c <> '')) AS n_cols FROM words),
s AS (SELECT *, hits / CAST(greatest(n_words, 1) AS DOUBLE) AS density, n_words BETWEEN 30 AND 2000 AND n_cols > 0 AS possible FROM g)
SELECT doc_id, round(CASE WHEN possible THEN CAST(0.33 AS DOUBLE) * (CASE WHEN n_words < 50 THEN 0 ELSE 1 END) + CAST(0.33 AS DOUBLE) * least(1.0, 10 * density) + CAST(0.34 AS DOUBLE) * ttr ELSE 0 END, 6) AS score, possible AND hits >= 2 AND density >= 0.05 AND ttr >= 0.6 AS accepted FROM s""")
def _(spark, d):
    return text.quality_gate(b.thoughts(spark, d), "text", text.prompt_columns(F.col("prompt"))).select("doc_id", F.round("score", 6).alias("score"), "accepted")


@query("content_id_sha1", f"WITH {b.THOUGHTS} SELECT doc_id, 'mem_' || sha1('set' || chr(0) || db_id || chr(0) || text) AS id FROM thoughts")
def _(spark, d):
    return b.thoughts(spark, d).select("doc_id", text.content_id(F.lit("set"), F.col("db_id"), F.col("text")).alias("id"))


_D2 = "list_sum(list_transform(list_zip(m.embedding, p.embedding), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


def _near(cond: str, source: str = "memory", k: int = 5) -> str:
    return f"(SELECT probe_id, id, db_id, probe_db, e, p, distance, place FROM (SELECT p.id AS probe_id, m.id, m.db_id, p.db_id AS probe_db, m.embedding AS e, p.embedding AS p, {_D2} AS distance, row_number() OVER (PARTITION BY p.id ORDER BY {_D2}, m.id) AS place FROM {source} m, probes p WHERE {cond}) WHERE place <= {k})"


def _topk(name: str, scope: str, cond: str) -> None:
    @query(name, f"WITH {b.MEMORY} SELECT probe_id, id, round(distance, 6) AS distance, place FROM {_near(cond)}")
    def _(spark, d):
        return vectors.nearest(b.probes(spark, d), b.memory(spark, d), 5, scope).withColumn("distance", F.round("distance", 6))


_topk("topk_other_db", "other", "m.db_id <> p.db_id")
_topk("topk_same_db", "same", "m.db_id = p.db_id")
_topk("topk_any_db", "any", "true")


@query("topk_failed_postfilter", f"WITH {b.MEMORY}, failed AS (SELECT * FROM memory WHERE NOT is_correct) SELECT probe_id, id, round(distance, 6) AS distance, place FROM {_near('true', 'failed')} WHERE db_id <> probe_db")
def _(spark, d):
    return vectors.nearest(b.probes(spark, d), b.memory(spark, d).where("NOT is_correct"), 5, "any", True).withColumn("distance", F.round("distance", 6))


@query("centroid", "SELECT label AS db_id, pos - 1 AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def _(spark, d):
    return vectors.centroid(b.memory(spark, d), "db_id").select("db_id", F.posexplode("centroid").alias("pos", "x")).select("db_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("mean"))


_MEAN = f"""near AS {_near("m.db_id <> p.db_id")}, flat AS (SELECT probe_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM near), means AS (SELECT probe_id, list(x ORDER BY pos) AS c FROM (SELECT probe_id, pos, avg(x) AS x FROM flat GROUP BY ALL) GROUP BY probe_id),
thought AS (SELECT p.id AS probe_id, coalesce({_COS.format("p.embedding", "c")}, 0) AS reward FROM probes p LEFT JOIN means ON probe_id = p.id)"""


@query("thought_reward", f"WITH {b.MEMORY}, {_MEAN} SELECT probe_id, round(reward, 6) AS reward FROM thought")
def _(spark, d):
    return vectors.thought_reward(b.probes(spark, d), b.memory(spark, d), 5).withColumn("reward", F.round("reward", 6))


@query("intrinsic_reward", f"WITH {b.MEMORY}, {_MEAN} SELECT probe_id, round(CAST(0.5 AS DOUBLE) * (reward + 1) / 2 + CAST(0.5 AS DOUBLE), 6) AS reward FROM thought")
def _(spark, d):
    return vectors.thought_reward(b.probes(spark, d), b.memory(spark, d), 5).select("probe_id", F.round(vectors.intrinsic(F.col("reward")), 6).alias("reward"))


@query("contrastive_reward", f"""WITH {b.MEMORY}, correct AS (SELECT * FROM memory WHERE is_correct), failed AS (SELECT * FROM memory WHERE NOT is_correct),
good AS (SELECT probe_id, max({_COS.format("e", "p")}) AS g FROM {_near("m.db_id <> p.db_id", "correct")} GROUP BY ALL), bad AS (SELECT probe_id, max({_COS.format("e", "p")}) AS f FROM {_near("true", "failed")} WHERE db_id <> probe_db GROUP BY ALL)
SELECT probes.id AS probe_id, round(greatest(-1, least(1, coalesce(g, 0) - coalesce(f, 0))), 6) AS reward FROM probes LEFT JOIN good ON good.probe_id = id LEFT JOIN bad ON bad.probe_id = id""")
def _(spark, d):
    m = b.memory(spark, d)
    return vectors.contrastive(b.probes(spark, d), m.where("is_correct"), m.where("NOT is_correct")).withColumn("reward", F.round("reward", 6))


@query("exploit_explore", f"""WITH {b.MEMORY}, c AS (SELECT list(x ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM memory WHERE is_correct) GROUP BY pos)),
f AS (SELECT p.id, max({_COS.format("m.embedding", "p.embedding")}) AS best FROM memory m, probes p WHERE NOT m.is_correct GROUP BY p.id)
SELECT p.id AS probe_id, round(-list_distance(p.embedding, c.c), 6) AS exploit, round(greatest(CAST(0 AS DOUBLE), 1 - best), 6) AS explore FROM probes p JOIN f USING (id), c""")
def _(spark, d):
    return vectors.exploit_explore(b.probes(spark, d), b.memory(spark, d)).select("probe_id", F.round("exploit", 6).alias("exploit"), F.round("explore", 6).alias("explore"))


@query("near_dup_candidates", f"""WITH {b.MEMORY}, old AS (SELECT * FROM memory WHERE id % 100 <> 0), near AS {_near("true", "old", 1)} SELECT probe_id AS id, id AS nearest_id, {_COS.format("e", "p")} < 0.9 AS is_new, round({_COS.format("e", "p")}, 6) AS similarity FROM near""")
def _(spark, d):
    return vectors.near_duplicates(b.probes(spark, d), b.memory(spark, d).where("id % 100 != 0")).select("id", "nearest_id", "is_new", F.round("similarity", 6).alias("similarity"))


@query("insert_if_absent", "SELECT vec_id AS id FROM embeddings UNION SELECT doc_id FROM documents")
def _(spark, d):
    return vectors.insert_if_absent(b.memory(spark, d).select("id"), b.t(spark, d, "documents").select(F.col("doc_id").alias("id")))


@query("gt_cache_join", f"WITH {b.CAND}, {b.GT_CACHE} SELECT c.result_id, sample_id, status, n_rows FROM cand c LEFT JOIN gt_cache USING (result_id)")
def _(spark, d):
    return etl.with_cache(b.cand(spark, d), b.gt_cache(spark, d), ["result_id"]).select("result_id", "sample_id", "status", "n_rows")


@query("execution_cache_hits", f"WITH {b.CAND}, {b.GT_CACHE} SELECT c.result_id, CASE WHEN status = 'rows' THEN n_rows END AS n_rows FROM cand c LEFT JOIN gt_cache USING (result_id)")
def _(spark, d):
    cache = b.gt_cache(spark, d).select("result_id", "n_rows", (F.col("status") != "failed").alias("ok"), (F.col("status") == "timeout").alias("timed_out"))
    return etl.cached_hits(b.cand(spark, d).drop("ok"), cache, ["result_id"]).select("result_id", "n_rows")


@query("cache_misses", f"WITH {b.CAND}, {b.GT_CACHE} SELECT result_id FROM cand WHERE result_id NOT IN (SELECT result_id FROM gt_cache)")
def _(spark, d):
    return etl.misses(b.cand(spark, d), b.gt_cache(spark, d), ["result_id"]).select("result_id")


@query("filter_timeouts", f"WITH {b.CAND}, {b.GT_CACHE} SELECT result_id FROM cand WHERE result_id NOT IN (SELECT result_id FROM gt_cache WHERE status = 'timeout')")
def _(spark, d):
    return etl.drop_timeouts(b.cand(spark, d), b.gt_cache(spark, d), ["result_id"]).select("result_id")


@query("filter_empty_gt", f"WITH {b.CAND}, {b.GT_CACHE} SELECT c.result_id FROM cand c LEFT JOIN gt_cache USING (result_id) WHERE status IS NULL OR status = 'timeout' OR n_rows > 0")
def _(spark, d):
    return etl.drop_empty_truth(b.cand(spark, d), b.gt_cache(spark, d), ["result_id"]).select("result_id")


@query("filter_summary", f"""WITH {b.CAND}, {b.GT_CACHE}, x AS (SELECT count(*) AS n0, count(*) FILTER (coalesce(status, '') <> 'timeout') AS n1, count(*) FILTER (coalesce(status, '') <> 'timeout' AND (status IS NULL OR n_rows > 0)) AS n2 FROM cand LEFT JOIN gt_cache USING (result_id))
SELECT 'timeouts' AS stage, n0 AS n_before, n1 AS n_after, round(n1 / n0, 6) AS rate FROM x UNION ALL SELECT 'empty', n1, n2, round(n2 / n1, 6) FROM x""")
def _(spark, d):
    rows = etl.with_cache(b.cand(spark, d), b.gt_cache(spark, d), ["result_id"])
    return etl.filter_summary(rows, {"timeouts": F.coalesce("status", F.lit("")) != "timeout", "empty": F.col("status").isNull() | (F.col("n_rows") > 0)})


@query("prompt_length_filter", "SELECT conv_id, turn FROM conversations WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) <= 40")
def _(spark, d):
    rows = b.t(spark, d, "conversations").withColumn("groundtruth_sqls", F.array("role"))
    return etl.prompt_filter(rows, text.word_count(F.col("text")), 40).select("conv_id", "turn")


_NORMAL = r"regexp_replace(trim(regexp_replace(sql_text, '[;\s]+$', '')), '\s+', ' ', 'g')"


@query("merge_correct_sqls", f"""WITH {b.CAND}, every AS (SELECT sample_id, {_NORMAL} AS normal_sql, CASE WHEN idx = 0 THEN 0 WHEN idx % 2 = 0 THEN 1 ELSE 2 END AS rank, idx FROM cand WHERE ok OR idx = 0),
one AS (SELECT *, row_number() OVER (PARTITION BY sample_id, normal_sql ORDER BY rank, idx) AS n FROM every)
SELECT sample_id, normal_sql, (['truth', 'existing', 'new'])[rank + 1] AS source, row_number() OVER (PARTITION BY sample_id ORDER BY rank, idx) AS position FROM one WHERE n = 1""")
def _(spark, d):
    c = b.cand(spark, d)
    return etl.merge_sqls(c.where("idx = 0"), c.where("ok AND idx > 0 AND idx % 2 = 0"), c.where("ok AND idx % 2 = 1"))


@query("merge_stats", f"""WITH {b.CAND}, every AS (SELECT sample_id, {_NORMAL} AS s, CASE WHEN idx = 0 THEN 0 WHEN idx % 2 = 0 THEN 1 ELSE 2 END AS rank FROM cand WHERE ok OR idx = 0), one AS (SELECT sample_id, s, min(rank) AS rank FROM every GROUP BY ALL),
per AS (SELECT sample_id, count(*) FILTER (rank = 2) AS n, count(*) FILTER (rank > 0) AS c, count(*) AS a FROM one GROUP BY sample_id) SELECT count(*) AS n_entries, count(*) FILTER (c > 0) AS n_with_correct, count(*) FILTER (n > 0) AS n_with_updates, CAST(sum(a) AS BIGINT) AS n_sqls FROM per""")
def _(spark, d):
    c = b.cand(spark, d)
    return etl.merge_stats(etl.merge_sqls(c.where("idx = 0"), c.where("ok AND idx > 0 AND idx % 2 = 0"), c.where("ok AND idx % 2 = 1")))


@query("dedup_sqls", f"WITH {b.CAND}, r AS (SELECT *, {_NORMAL} AS normal_sql FROM cand) SELECT sample_id, normal_sql, min(idx) AS idx FROM r GROUP BY ALL")
def _(spark, d):
    return etl.dedup_sqls(b.cand(spark, d)).select("sample_id", "normal_sql", "idx")


@query("collect_correct_sqls", f"WITH {b.CAND} SELECT sample_id, string_agg(sql_text, '|' ORDER BY idx) AS sqls FROM cand WHERE ok GROUP BY sample_id")
def _(spark, d):
    return etl.correct_sqls(b.cand(spark, d).withColumn("correct", F.col("ok"))).select("sample_id", F.array_join("correct_sqls", "|").alias("sqls"))


@query("update_by_key", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, d):
    o = b.t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return etl.update_by_key(o, o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("upsert_replace", "SELECT o_orderkey AS k, o_orderstatus AS v FROM orders UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, d):
    o, c = b.t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")), b.t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return etl.upsert(c, o, ["k"])


@query("insert_ignore", "SELECT c_custkey AS k, c_mktsegment AS v FROM customer UNION ALL SELECT DISTINCT -1 - o_custkey, 'new' FROM orders")
def _(spark, d):
    c, o = b.t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), b.t(spark, d, "orders")
    new = o.select(F.col("o_custkey").alias("k"), F.lit("ignored").alias("v")).unionByName(o.select((-1 - F.col("o_custkey")).alias("k"), F.lit("new").alias("v")))
    return etl.insert_ignore(c, new, ["k"])


@query("ckpt_improvements", f"WITH {b.RUNS} SELECT sample_id, coalesce(difficulty, 'unknown') AS difficulty, n_chars FROM runs WHERE NOT cp0_ok AND cpn_ok")
def _(spark, d):
    r = b.runs(spark, d)
    a, z = r.select("sample_id", F.col("cp0_ok").alias("ok")), r.select("sample_id", F.col("cpn_ok").alias("ok"), "n_chars")
    return etl.improvements(a, z, r.select("sample_id", "difficulty")).select("sample_id", "difficulty", "n_chars")


@query("ckpt_length_stats", f"""WITH {b.RUNS} SELECT CASE WHEN grouping(level) = 1 THEN 'overall' ELSE level END AS difficulty, count(*) AS n, round(avg(n_chars), 4) AS mean_length FROM (SELECT *, coalesce(difficulty, 'unknown') AS level FROM runs) GROUP BY ROLLUP (level)""")
def _(spark, d):
    return metrics.by_level(b.runs(spark, d), "difficulty", F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_length"), missing="unknown")


_Q = ", ".join(f"round(quantile_cont(CAST(n_chars AS DOUBLE), {q}), 4) AS q{k}" for k, q in ((1, 0.25), (2, 0.5), (3, 0.75)))


@query("length_quartiles", f"""WITH {b.RUNS} SELECT CASE WHEN grouping(level) = 1 THEN 'overall' ELSE level END AS difficulty, count(*) AS n, CAST(min(n_chars) AS DOUBLE) AS low, {_Q}, CAST(max(n_chars) AS DOUBLE) AS high FROM (SELECT *, coalesce(difficulty, 'unknown') AS level FROM runs) GROUP BY ROLLUP (level)""")
def _(spark, d):
    return metrics.quartiles(b.runs(spark, d), "difficulty", "n_chars")


@query("main_models_having", f"WITH {b.POOL} SELECT model_name, n FROM (SELECT model_name, count(*) AS n, max(count(*)) OVER () AS top FROM pool GROUP BY model_name) WHERE n > 100 OR top <= 100")
def _(spark, d):
    return etl.main_models(b.pool(spark, d), 100)


@query("model_counts", f"WITH {b.POOL} SELECT count(DISTINCT sample_id) AS n_samples, count(DISTINCT model_name) AS n_models, CAST(sum(len(list_filter(string_split_regex(response, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS n_tokens FROM pool")
def _(spark, d):
    return b.pool(spark, d).agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("model_name").alias("n_models"), F.sum(text.word_count(F.col("response"))).alias("n_tokens"))


@query("stratified_limit", f"""WITH {b.POOL}, c AS (SELECT model_name, count(*) AS n, sum(count(*)) OVER () AS total FROM pool GROUP BY model_name), r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY sample_id, turn) AS k FROM pool)
SELECT sample_id, turn, model_name FROM r JOIN c USING (model_name) WHERE k <= least(n, greatest(1, floor(n * 100 / total)))""")
def _(spark, d):
    return etl.stratified(b.pool(spark, d), 100, ["sample_id", "turn"]).select("sample_id", "turn", "model_name")


@query("sft_prompt_ids", f"WITH {b.POOL} SELECT printf('prompt_%06d', row_number() OVER (ORDER BY sample_id, turn, model_name) - 1) AS prompt_id, sample_id, turn FROM pool WHERE ok")
def _(spark, d):
    return etl.prompt_ids(b.pool(spark, d).where("ok"), ["sample_id", "turn", "model_name"]).select("prompt_id", "sample_id", "turn")


@query("sft_messages", f"WITH {b.POOL} SELECT printf('prompt_%06d', row_number() OVER (ORDER BY sample_id, turn, model_name) - 1) AS prompt_id, 'user:' || sample_id || '|assistant:' || response AS messages FROM pool WHERE ok")
def _(spark, d):
    p = b.pool(spark, d).where("ok").withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("sample_id").cast("string").alias("content"))))
    shown = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return etl.sft_rows(p, ["sample_id", "turn", "model_name"]).select("prompt_id", shown.alias("messages"))


@query("map_roles", "SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END, ',' ORDER BY turn) AS roles FROM conversations WHERE text <> '' GROUP BY conv_id")
def _(spark, d):
    c = b.t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", F.array_join(F.transform(text.map_roles(F.col("m")), lambda x: x["role"]), ",").alias("roles"))


@query("join_messages", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS joined FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def _(spark, d):
    c = b.t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", text.join_messages(F.col("m")).alias("joined"))


@query("pending_model_pairs", f"WITH {b.POOL} SELECT s.sample_id, m.model_name FROM (SELECT DISTINCT sample_id FROM pool) s, (SELECT DISTINCT model_name FROM pool) m WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.sample_id = s.sample_id AND p.model_name = m.model_name AND p.ok)")
def _(spark, d):
    p = b.pool(spark, d)
    return etl.pending(p, p, p, retry_failed=True).select("sample_id", "model_name")


@query("models_complete", f"WITH {b.POOL} SELECT sample_id, bool_or(model_name = 'user') AND bool_or(model_name = 'assistant') AS complete FROM pool GROUP BY ALL")
def _(spark, d):
    return etl.complete(b.pool(spark, d), ["user", "assistant"])


@query("group_columns_by_table", f"WITH {b.THOUGHTS} SELECT doc_id, db_id AS \"table\", array_to_string(list_sort(list_distinct([w1, w2])), ',') AS columns FROM thoughts")
def _(spark, d):
    rows = b.thoughts(spark, d).select("doc_id", F.array(F.concat_ws(".", "db_id", "w1"), F.concat_ws(".", "db_id", "w2")).alias("c"))
    return etl.columns_by_table(rows, "doc_id", "c").select("doc_id", "table", F.array_join("columns", ",").alias("columns"))


@query("export_lines", rf"WITH {b.CAND} SELECT result_id, regexp_replace(trim(CASE WHEN idx = 0 THEN 'SELECT 1' ELSE sql_text END), '\s+', ' ', 'g') AS line FROM cand")
def _(spark, d):
    return b.cand(spark, d).select("result_id", text.export_line(F.when(F.col("idx") > 0, F.col("sql_text"))).alias("line"))


@query("parse_pairs", f"WITH {b.CAND} SELECT result_id, CASE WHEN idx = 0 THEN ' ' ELSE sql_text END AS sql, CASE WHEN idx = 0 THEN 'financial' ELSE 'db' || sample_id END AS db FROM cand")
def _(spark, d):
    value = F.when(F.col("idx") > 0, text.export_pair(F.col("sql_text"), F.concat(F.lit("db"), F.col("sample_id").cast("string"))))
    return b.cand(spark, d).select("result_id", text.parse_pair(value).alias("p")).select("result_id", "p.sql", "p.db")


@query("positional_pairs", "SELECT o_orderkey, o_orderstatus AS pred, o_orderpriority AS gold FROM orders")
def _(spark, d):
    o = b.t(spark, d, "orders").withColumnRenamed("o_orderkey", "index")
    return etl.by_position(o.select("index", F.col("o_orderstatus").alias("pred")), o.select("index", F.col("o_orderpriority").alias("gold"))).withColumnRenamed("index", "o_orderkey")


@query("noted_join", f"WITH {b.CAND}, {b.GT_CACHE} SELECT c.result_id, CASE WHEN g.result_id IS NULL THEN 'no entry' END AS note FROM cand c LEFT JOIN gt_cache g USING (result_id)")
def _(spark, d):
    return etl.noted(b.cand(spark, d), b.gt_cache(spark, d), "result_id", "no entry").select("result_id", "note")


@query("union_by_name", "SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _(spark, d):
    c, s = b.t(spark, d, "customer"), b.t(spark, d, "supplier")
    return etl.union_all(c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")), s.select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k")))


_OPS = {0: "SELECT a FROM t", 1: "SELECT a, b FROM t WHERE a > 1", 2: "SELECT COUNT(*) FROM t GROUP BY b", 3: "SELECT a FROM t WHERE b = 2 ORDER BY a LIMIT 3"}
#: Their operations, written by hand.
_OPS_LISTS = {
    0: ["FROM(t as T1)", "SELECT_COL(a)"],
    1: ["FROM(t as T1)", "SELECT_COL(a)", "SELECT_COL(b)", "WHERE_PRED(GT, a, VALUE(1))"],
    2: ["FROM(t as T1)", "SELECT_AGG(COUNT, *)", "GROUP_BY(b)"],
    3: ["FROM(t as T1)", "SELECT_COL(a)", "WHERE_PRED(EQ, b, VALUE(2))", "ORDER_BY(a, ASC)", "LIMIT(3)"],
}
#: Statements and their operations, written by hand; `#` is the key that each row puts in.
_DECOMPOSED = {
    "SELECT x.a, COUNT(DISTINCT y.b) AS n FROM t x INNER JOIN u AS y ON x.id = y.id AND y.c > # GROUP BY x.a HAVING COUNT(DISTINCT y.b) < 5": ["FROM(t as T1)", "JOIN(u, INNER)", "ON_EQ(T1.id, T2.id)", "ON_PRED(GT, T2.c, VALUE(#))", "SELECT_COL(a)", "SELECT_AGG(COUNT, DISTINCT b)", "ALIAS(COLUMN, COUNT(DISTINCT b), n)", "GROUP_BY(a)", "HAVING_PRED(LT, COUNT(DISTINCT b), VALUE(5))"],
    "SELECT DISTINCT a FROM t WHERE a BETWEEN 1 AND # AND b LIKE 'x%' AND c IS NULL": ["FROM(t as T1)", "SELECT_COL(a)", "DISTINCT", "WHERE_PRED(BETWEEN, a, [VALUE(1), VALUE(#)])", "WHERE_PRED(LIKE, b, VALUE('x%'))", "WHERE_PRED(IS, c, VALUE(NULL))"],
    "SELECT a FROM t WHERE b = # OR c = 2": ["FROM(t as T1)", "SELECT_COL(a)", "WHERE_PRED_TREE(b = # OR c = 2)"],
    "SELECT a FROM t WHERE a NOT IN (#, 2)": ["FROM(t as T1)", "SELECT_COL(a)", "WHERE_PRED_TREE(NOT a IN (#, 2))"],
    "SELECT a FROM t WHERE a IN (SELECT b FROM u WHERE c = #)": ["FROM(t as T1)", "SELECT_COL(a)", "ENTER_SUBQUERY(WHERE_IN)", "FROM(u as T1)", "SELECT_COL(b)", "WHERE_PRED(EQ, c, VALUE(#))", "EXIT_SUBQUERY", "WHERE_PRED(IN_SUBQ, a, SUBQ_LAST)"],
    "SELECT a FROM t WHERE a > (SELECT AVG(b) FROM u) AND EXISTS (SELECT 1 FROM v WHERE v.k = #)": ["FROM(t as T1)", "SELECT_COL(a)", "ENTER_SUBQUERY(WHERE_EXISTS)", "FROM(v as T1)", "SELECT_EXPR(VALUE(1))", "WHERE_PRED(EQ, k, VALUE(#))", "EXIT_SUBQUERY", "WHERE_PRED(EXISTS_SUBQ, TRUE, SUBQ_LAST)",
        "ENTER_SUBQUERY(WHERE_SCALAR)", "FROM(u as T1)", "SELECT_AGG(AVG, b)", "EXIT_SUBQUERY", "WHERE_PRED(GT, a, SUBQ_LAST)"],
    "WITH c AS (SELECT a FROM t WHERE b = #) SELECT MAX(a) FROM c": ["WITH_CTE(c)", "ENTER_SUBQUERY(CTE)", "FROM(t as T1)", "SELECT_COL(a)", "WHERE_PRED(EQ, b, VALUE(#))", "EXIT_SUBQUERY", "FROM(c as T1)", "SELECT_AGG(MAX, a)"],
    "SELECT a, RANK() OVER (PARTITION BY b ORDER BY c DESC) AS r FROM t ORDER BY a DESC, r LIMIT #": ["FROM(t as T1)", "SELECT_COL(a)", "WINDOW(partition_by=[b], order_by=[c DESC])", "SELECT_WIN(RANK, )", "ALIAS(COLUMN, RANK(), r)", "ORDER_BY(a, DESC)", "ORDER_BY(r, ASC)", "LIMIT(#)"],
    "SELECT a FROM t UNION SELECT b FROM u WHERE c = #": ["FROM(t as T1)", "SELECT_COL(a)", "UNION", "ENTER_SUBQUERY(SET_RIGHT)", "FROM(u as T1)", "SELECT_COL(b)", "WHERE_PRED(EQ, c, VALUE(#))", "EXIT_SUBQUERY"],
    "SELECT CAST(a AS INT), UPPER(b) FROM (SELECT a, b FROM t WHERE c <> #) s": ["ENTER_SUBQUERY(FROM)", "FROM(t as T1)", "SELECT_COL(a)", "SELECT_COL(b)", "WHERE_PRED(NEQ, c, VALUE(#))", "EXIT_SUBQUERY", "FROM(SUBQUERY as T1)", "SELECT_EXPR(CAST(a AS INT))", "SELECT_EXPR(UPPER(b))"],
    "SELECT COUNT(*) FILTER (WHERE a > #) FROM t WHERE b GLOB 'x*'": ["FROM(t as T1)", "SELECT_EXPR(COUNT(*) FILTER(WHERE a > #))", "WHERE_PRED_TREE(b GLOB 'x*')"],
    "SELEC a FROM t WHERE #": [],
}


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DECOMPOSED_SQL = " UNION ALL ".join(f"SELECT {k} AS form, {n} AS pos, {_literal(op)} AS op" for k, ops in enumerate(_DECOMPOSED.values()) for n, op in enumerate(ops))


@query("ops_decompose", f"SELECT o_custkey, form, pos, replace(op, '#', CAST(o_custkey AS VARCHAR)) AS op FROM (SELECT DISTINCT o_custkey FROM orders) JOIN ({_DECOMPOSED_SQL}) ON form = o_custkey % {len(_DECOMPOSED)}")
def _(spark, d):
    """Operations of a statement of each customer, by their place."""
    k = F.col("o_custkey")
    forms = F.array(*map(F.lit, _DECOMPOSED))
    rows = b.t(spark, d, "orders").select(k).distinct().withColumn("form", (k % len(_DECOMPOSED)).cast("int")).withColumn("sql", F.replace(F.element_at(forms, F.col("form") + 1), F.lit("#"), k.cast("string")))
    return sqlops.with_ops(rows, "sql").select("o_custkey", "form", F.posexplode("ops").alias("pos", "op"))


_OPS_CASE = "CASE " + " ".join(f"WHEN {{0}} % 4 = {k} THEN {v!r}" for k, v in _OPS_LISTS.items()) + " END"
_OPS_SQL = f"ops AS (SELECT o_orderkey, {_OPS_CASE.format('o_orderkey')} AS p, {_OPS_CASE.format('o_custkey')} AS g FROM orders), j AS (SELECT o_orderkey, CAST(len(list_intersect(p, g)) AS DOUBLE) / len(list_distinct(list_concat(p, g))) AS s FROM ops)"


def _ops(spark, d):
    pick = lambda k: F.element_at(F.array(*map(F.lit, _OPS.values())), (F.col(k) % 4 + 1).cast("int"))
    rows = b.t(spark, d, "orders").select("o_orderkey", pick("o_orderkey").alias("p"), pick("o_custkey").alias("g"))
    return sqlops.with_ops(sqlops.with_ops(rows, "p", "p_ops"), "g", "g_ops")


@query("ops_jaccard", f"WITH {_OPS_SQL} SELECT o_orderkey, round(s, 6) AS similarity FROM j")
def _(spark, d):
    return _ops(spark, d).select("o_orderkey", F.round(sqlops.jaccard(F.col("p_ops"), F.col("g_ops")), 6).alias("similarity"))


@query("ops_shaped_best", f"WITH {_OPS_SQL} SELECT o_orderkey, round(CAST(0.3 AS DOUBLE) * s + CAST(0.7 AS DOUBLE) * CAST(0.71 AS DOUBLE) * pow(s, 5), 6) AS score FROM j")
def _(spark, d):
    return _ops(spark, d).select("o_orderkey", F.round(sqlops.best_shaped(F.col("p_ops"), F.array("g_ops")), 6).alias("score"))


_PARTS = "doc_id % 3 = 0 AS correct, doc_id % 3 = 1 AS ran, CAST(doc_id % 10 AS DOUBLE) / 10 AS atomic, CAST(doc_id % 7 AS DOUBLE) / 7 AS remembered"


@query("composite_reward", f"""WITH {b.COMPLETIONS}, {_GATE}, p AS (SELECT doc_id, formatted, coalesce(length(thought), 0) AS n, {_PARTS} FROM gate)
SELECT doc_id, round(CASE WHEN formatted THEN 1 + CASE WHEN correct THEN 2 WHEN ran THEN 1 + atomic ELSE 0 END + CASE WHEN correct THEN 1 WHEN n > 30 THEN remembered ELSE 0 END ELSE 0 END, 6) AS reward FROM p""")
def _(spark, d):
    c = b.completions(spark, d).withColumns({
        "correct": F.col("doc_id") % 3 == 0, "ran": F.col("doc_id") % 3 == 1, "atomic": (F.col("doc_id") % 10).cast("double") / 10, "remembered": (F.col("doc_id") % 7).cast("double") / 7,
    })
    length = F.coalesce(F.length(text.extract_thought(F.col("completion"))), F.lit(0))
    total = reward.composite(text.format_gate(F.col("completion")), F.col("correct"), F.col("ran"), F.col("atomic"), length, F.col("remembered"))
    return c.select("doc_id", F.round(total, 6).alias("reward"))
