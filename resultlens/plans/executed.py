"""Queries over statements that are truly run: the cache of results, lookups and verdicts from it, and the reward that puts them together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import result_cache, reward
from ..operators.result_cache import ResultCache
from . import bindings as b
from .catalogue import query
from .memory_text import _COS
from .roundtrip import folder
from .sqlsurface import database

#: Ways to ask for a segment's customers by nation; # is the segment. The first is the ground truth, the next two say the same, then columns swapped, no filter, a wrong column, and a write.
FORMS = (
    "SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_mktsegment = '#' GROUP BY c_nationkey",
    "  SELECT c_nationkey,  COUNT(*) AS n\nFROM customer WHERE c_mktsegment = '#'   GROUP BY c_nationkey ; ",
    "SELECT c_nationkey, SUM(1) AS m FROM customer WHERE '#' = c_mktsegment GROUP BY c_nationkey",
    "SELECT COUNT(*) AS n, c_nationkey FROM customer WHERE c_mktsegment = '#' GROUP BY c_nationkey",
    "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey",
    "SELECT c_nation, COUNT(*) AS n FROM customer WHERE c_mktsegment = '#' GROUP BY c_nation",
    "DROP TABLE customer",
)
#: Six billion combinations: too many for its time limit, and few enough to end soon where a running task doesn't heed the interrupt.
ENDLESS = "SELECT COUNT(*) AS n FROM nation a, nation b, nation c, nation d, nation e, nation f, region g, region h WHERE a.n_nationkey + b.n_nationkey + c.n_nationkey + d.n_nationkey + e.n_nationkey + f.n_nationkey + g.r_regionkey + h.r_regionkey > 150"


def segments(spark: SparkSession, d: str) -> DataFrame:
    return b.t(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()


def statements(spark: SparkSession, d: str) -> DataFrame:
    """segment, form, dataset, db, sql of all forms for all segments."""
    _, db = database(d)
    forms = F.posexplode(F.array(*map(F.lit, FORMS))).alias("form", "template")
    return segments(spark, d).select("segment", forms).select("segment", "form", F.lit("set").alias("dataset"), F.lit(db).alias("db"), F.replace("template", F.lit("#"), F.col("segment")).alias("sql"))


def cache(spark: SparkSession, d: str, **more) -> ResultCache:
    return ResultCache(spark, database(d)[0], f"{folder(spark)}/cache", **more)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_FORMS = " UNION ALL ".join(f"SELECT {k} AS form, {_sql_text(f)} AS template" for k, f in enumerate(FORMS))
#: The rows of each form, computed anew, and what becomes of it.
FORMS_SQL = f"""seg AS (SELECT DISTINCT c_mktsegment AS segment FROM customer), forms AS (SELECT segment, form, replace(template, '#', segment) AS sql FROM seg, ({_FORMS})),
per AS (SELECT c_mktsegment AS segment, c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL), whole AS (SELECT segment, c_nationkey AS k, count(*) AS n FROM customer, seg GROUP BY ALL),
res AS (SELECT segment, form, k AS a, n AS b FROM per, (SELECT unnest([0, 1, 2]) AS form) UNION ALL SELECT segment, 3, n, k FROM per UNION ALL SELECT segment, 4, k, n FROM whole),
eq AS (SELECT f.segment, f.form, f.form < 5 AS ran, f.form < 5 AND NOT EXISTS (SELECT a, b FROM res r WHERE r.segment = f.segment AND r.form = f.form EXCEPT SELECT a, b FROM res r WHERE r.segment = f.segment AND r.form = 0)
  AND NOT EXISTS (SELECT a, b FROM res r WHERE r.segment = f.segment AND r.form = 0 EXCEPT SELECT a, b FROM res r WHERE r.segment = f.segment AND r.form = f.form) AS correct FROM forms f)"""


@query("gt_cache_build", f"""WITH {FORMS_SQL}, normal AS (SELECT DISTINCT CASE WHEN form = 1 THEN 0 ELSE form END AS form, CASE WHEN form < 4 OR form = 5 THEN segment END AS segment, CASE form WHEN 1 THEN NULL ELSE sql END AS normal_sql FROM forms WHERE form <> 1),
j AS (SELECT normal_sql, CASE WHEN form < 5 THEN 'rows' ELSE 'failed' END AS status, n.form, n.segment FROM normal n),
rows AS (SELECT DISTINCT j.normal_sql, CASE form WHEN 3 THEN printf('{{"n":%d,"c_nationkey":%d}}', a, b) WHEN 2 THEN printf('{{"c_nationkey":%d,"m":%d}}', a, b) ELSE printf('{{"c_nationkey":%d,"n":%d}}', a, b) END AS row
  FROM j JOIN res r USING (form) WHERE coalesce(j.segment, r.segment) = r.segment)
SELECT normal_sql, status, CASE WHEN status = 'rows' THEN count(row) END AS row_count, coalesce(string_agg(row, ';' ORDER BY row), '') AS found, false AS timed_out FROM j LEFT JOIN rows USING (normal_sql) GROUP BY normal_sql, status
UNION ALL SELECT {_sql_text(ENDLESS)}, 'timeout', NULL, '', true""")  # fmt: skip
def _(spark, d):
    """Statements of a table run into a cache by chunks, one of them against its time limit; a second fill finds only the failures to do."""
    built, todo = cache(spark, d, every=8, concurrent=8), statements(spark, d).select("dataset", "db", "sql", F.lit(None).cast("long").alias("timeout_ms"))
    late = todo.limit(1).select("dataset", "db", F.lit(ENDLESS).alias("sql"), F.lit(1500).cast("long").alias("timeout_ms"))
    built.fill(todo.unionByName(late))
    rows = built.rows().groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("row")), ";").alias("found"))  # at most max_rows of a statement
    return built.envelopes().join(rows, "key", "left").select("normal_sql", "status", "row_count", F.coalesce("found", F.lit("")).alias("found"), "timed_out")


@query("exec_cache_lookup", f"""WITH {FORMS_SQL}, size AS (SELECT segment, form, count(*) AS n FROM res GROUP BY ALL)
SELECT o_orderkey, sql, form IN (0, 1, 2) AS hit, CASE WHEN form IN (0, 1, 2) THEN n END AS row_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN forms ON segment = c_mktsegment AND form = o_orderkey % {len(FORMS)} LEFT JOIN size USING (segment, form)""")  # fmt: skip
def _(spark, d):
    """Candidates of all orders against a cache of some statements, found by normalised SQL."""
    some, known = statements(spark, d), cache(spark, d)
    known.fill(some.where("form IN (0, 2, 5)"))
    o = b.t(spark, d, "orders").join(b.t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    candidates = o.select("o_orderkey", F.col("c_mktsegment").alias("segment"), (F.col("o_orderkey") % len(FORMS)).cast("int").alias("form")).join(some, ["segment", "form"])
    return result_cache.looked_up(candidates, known).select("o_orderkey", "sql", "hit", "row_count")


@query("exec_verdicts", f"WITH {FORMS_SQL} SELECT segment, form, ran, correct, NOT ran AS has_error FROM eq")
def _(spark, d):
    """Every form against the ground truth of its segment, by cached results."""
    all_of, known = statements(spark, d), cache(spark, d)
    known.fill(all_of)
    truth = all_of.where("form = 0").select("segment", F.col("sql").alias("truth"))
    return result_cache.judged(all_of.join(truth, "segment"), known).select("segment", "form", "ran", "correct", F.col("error").isNotNull().alias("has_error"))


def completions(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, dataset, db, db_id, truth, completion, embedding: the thought is a document's text, its SQL one of the forms for a segment; every eleventh lacks its opening tag. The vector is that of the document's number, where there is one."""
    all_of = statements(spark, d)
    places = segments(spark, d).select("segment", F.rank().over(b.Window.orderBy("segment")).alias("nth"))  # five or so
    docs = b.t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"), (F.col("doc_id") % 5 + 1).cast("int").alias("nth"), F.pmod(F.shiftright("doc_id", 1), F.lit(len(FORMS))).cast("int").alias("form"))
    truth = all_of.where("form = 0").select("segment", F.col("sql").alias("truth"))
    joined = docs.join(places, "nth").join(all_of, ["segment", "form"]).join(truth, "segment").join(b.t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("db_id")), "doc_id", "left")
    opening = F.when(F.col("doc_id") % 11 == 0, "").otherwise(text.OPEN)
    return joined.select("doc_id", "dataset", "db", "db_id", "truth", F.concat(opening, F.replace("body", F.lit("<"), F.lit(" ")), F.lit(text.CLOSE), F.lit("\n"), "sql").alias("completion"), "embedding")


# fixed values: the shaped overlap of each form's operations with those of the ground truth, of 6 operations: swapped columns share all, the unfiltered form 5
_ATOMIC = "CASE form WHEN 3 THEN 0.3 + 0.7 * 0.71 WHEN 4 THEN 0.3 * (5 / 6.0) + 0.7 * 0.71 * pow(5 / 6.0, 5) ELSE 0 END"


@query("reward_from_parts", rf"""WITH {FORMS_SQL}, places AS (SELECT segment, rank() OVER (ORDER BY segment) AS nth FROM seg),
c AS (SELECT doc_id, segment, (doc_id >> 1) % {len(FORMS)} AS form, regexp_replace(replace(coalesce(text, ''), '<', ' '), '^\s+|\s+$', '', 'g') AS thought FROM documents JOIN places ON nth = doc_id % 5 + 1),
v AS (SELECT doc_id, form, doc_id % 11 <> 0 AND length(thought) > 100 AS formatted, ran, correct FROM c JOIN eq USING (segment, form)),
memory AS (SELECT vec_id AS id, label AS db_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings), probes AS (SELECT m.* FROM memory m JOIN v ON id = doc_id WHERE formatted AND NOT correct), kept AS (SELECT * FROM memory WHERE id % 4 <> 0),
near AS (SELECT probe_id, e FROM (SELECT p.id AS probe_id, m.embedding AS e, row_number() OVER (PARTITION BY p.id ORDER BY list_sum(list_transform(list_zip(m.embedding, p.embedding), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), m.id) AS place FROM kept m, probes p WHERE m.db_id <> p.db_id) WHERE place <= 5),
means AS (SELECT probe_id, list(x ORDER BY pos) AS c FROM (SELECT probe_id, pos, avg(x) AS x FROM (SELECT probe_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM near) GROUP BY ALL) GROUP BY probe_id),
thought AS (SELECT p.id AS doc_id, coalesce({_COS.format("p.embedding", "c")}, 0) AS remembered FROM probes p LEFT JOIN means ON probe_id = p.id)
SELECT doc_id, formatted, coalesce(correct, false) AS correct, round(CAST(CASE WHEN formatted THEN 1 + CASE WHEN correct THEN 3 WHEN ran THEN 1 + {_ATOMIC} + coalesce(remembered, 0) ELSE coalesce(remembered, 0) END ELSE 0 END AS DOUBLE), 6) AS reward
FROM v LEFT JOIN thought USING (doc_id)""")  # fmt: skip
def _(spark, d):
    """No part is given: SQL and thought come from the completion, the verdict from executed statements, the overlap from their operations, the similarity from the memory."""
    known = cache(spark, d)
    known.fill(statements(spark, d))
    out = reward.rewarded(completions(spark, d), known, b.memory(spark, d).where("is_correct"))
    return out.select("doc_id", "formatted", "correct", F.round("reward", 6).alias("reward"))
