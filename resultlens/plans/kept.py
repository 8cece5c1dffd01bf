"""Queries over stored tables and files: keyed merges, lines by their place, results with headers of their own, counts in passing, summaries of quantiles, measured efficiency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import etl, metrics, result_cache
from ..sources import readers, sinks
from ..sources.stored import StoredTable
from . import bindings as b
from .catalogue import query
from .executed import FORMS, cache, statements
from .roundtrip import folder


@query("stored_merge", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS v, 'order' AS kind FROM orders
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT DISTINCT -1 - o_custkey, 'new', 'person' FROM orders""")  # fmt: skip
def _(spark, d):
    """A stored table of customers takes orders by upsert (twice, as a job that runs again), new keys by insert-or-ignore, and nulls by update."""
    c, o = b.t(spark, d, "customer"), b.t(spark, d, "orders")
    start = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.lit("customer").alias("kind"))
    table = StoredTable.create(spark, folder(spark), start.schema, ["k"], 8)
    table.merge(start)
    orders = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.lit("order").alias("kind"))
    for _ in range(2):
        table.merge(orders)
    table.merge(orders.withColumn("v", F.lit("ignored")).unionByName(o.select((-1 - F.col("o_custkey")).alias("k"), F.lit("new").alias("v"), F.lit("person").alias("kind"))), "insert")
    table.merge(table.read().where("k >= 0 AND k % 3 = 0").select("k", F.lit(None).cast("string").alias("v")), "update")
    return table.read()


@query("read_numbered_lines", "SELECT line, 'SELECT ' || o_orderkey || chr(9) || o_orderstatus AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS line FROM orders)")
def _(spark, d):
    """Files of lines, one for each priority, and the place of each line in its file."""
    at, o = folder(spark), b.t(spark, d, "orders")
    lines = o.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey")
    lines.select("o_orderpriority", F.concat(F.lit("SELECT "), F.col("o_orderkey").cast("string"), F.lit("\t"), "o_orderstatus").alias("value")).write.partitionBy("o_orderpriority").text(f"{at}/lines")
    return readers.numbered_lines(spark, f"{at}/lines/*").select("line", "value")


@query("read_predictions", "SELECT o_orderkey AS sample_idx, 'SELECT \"' || o_orderstatus || '\", 1' AS sql, o_orderpriority AS db FROM orders")
def _(spark, d):
    """An object of pairs, an entry a line, as exported."""
    at, o = folder(spark), b.t(spark, d, "orders")
    pair = F.to_json(F.array(F.concat(F.lit('SELECT "'), "o_orderstatus", F.lit('", 1\t----- bird -----\t'), "o_orderpriority")))
    entry = F.concat(F.lit('    "'), F.col("o_orderkey").cast("string"), F.lit('": '), F.regexp_replace(pair, r"^\[|\]$", ""), F.lit(","))
    o.select(entry.alias("value")).write.text(f"{at}/pairs")
    return readers.predictions(spark, f"{at}/pairs")


@query("read_csv_results", """SELECT 'segment' AS instance_id, 'a' AS variant, 'c_custkey=' || c_custkey || ';c_nationkey=' || c_nationkey AS cells FROM customer
UNION ALL SELECT 'segment', 'b', 'seg, ment=' || c_mktsegment || ';c_custkey=' || c_custkey FROM customer UNION ALL SELECT 'nation', NULL, 'n_name=' || n_name FROM nation""")  # fmt: skip
def _(spark, d):
    """Results with headers of their own, in variants; the plain file wins over its variant."""
    at, c, n = folder(spark), b.t(spark, d, "customer"), b.t(spark, d, "nation")
    write = lambda rows, name: sinks.write_csv(rows, f"{at}/{name}.csv")
    write(c.select("c_custkey", "c_nationkey"), "segment_a")
    write(c.select(F.col("c_mktsegment").alias("seg, ment"), "c_custkey"), "segment_b")
    write(n.select("n_name"), "nation")
    write(n.select("n_regionkey", "n_name"), "nation_a")
    cells = F.array_join(F.transform("cells", lambda x: F.concat_ws("=", x["name"], x["value"])), ";")
    return readers.csv_results(spark, at).select("instance_id", "variant", cells.alias("cells"))


@query("filter_observed", f"""WITH {b.CAND}, {b.GT_CACHE}, x AS (SELECT count(*) AS n0, count(*) FILTER (coalesce(status, '') <> 'timeout') AS n1, count(*) FILTER (coalesce(status, '') <> 'timeout' AND (status IS NULL OR n_rows > 0)) AS n2 FROM cand LEFT JOIN gt_cache USING (result_id))
SELECT 'timeouts' AS stage, n0 AS n_before, n1 AS n_after, round(n1 / n0, 6) AS rate FROM x UNION ALL SELECT 'empty', n1, n2, round(n2 / n1, 6) FROM x""")  # fmt: skip
def _(spark, d):
    """Counts that the job takes which writes the filtered rows."""
    counts = etl.StageCounts({"timeouts": F.coalesce("status", F.lit("")) != "timeout", "empty": F.col("status").isNull() | (F.col("n_rows") > 0)})
    counts.filtered(etl.with_cache(b.cand(spark, d), b.gt_cache(spark, d), ["result_id"])).write.parquet(f"{folder(spark)}/rows")
    return counts.summary(spark)


@query("length_quartiles_sketch", f"""WITH {b.RUNS} SELECT CASE WHEN grouping(level) = 1 THEN 'overall' ELSE level END AS difficulty, count(*) AS n, CAST(min(n_chars) AS DOUBLE) AS low, CAST(max(n_chars) AS DOUBLE) AS high, true AS within
FROM (SELECT *, coalesce(difficulty, 'unknown') AS level FROM runs) GROUP BY ROLLUP (level)""")  # fmt: skip
def _(spark, d):
    """Whether the summary's quartiles have ranks within its error of the exact ones, counted."""
    runs = b.runs(spark, d).withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown")))
    sketch = metrics.quartile_sketch(runs, "difficulty", "n_chars", 100)
    each = runs.unionByName(runs.withColumn("difficulty", F.lit("overall"))).select("difficulty", "n_chars").join(F.broadcast(sketch), "difficulty")  # a row a level
    off = [F.greatest(F.lit(0), F.count_if(F.col("n_chars") < F.col(f"q{k}")) - q * F.first("n"), q * F.first("n") - F.count_if(F.col("n_chars") <= F.col(f"q{k}"))) for k, q in ((1, 0.25), (2, 0.5), (3, 0.75))]
    within = F.greatest(*off) <= F.first("n") / 100 + 1
    return each.groupBy("difficulty").agg(F.first("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), within.alias("within"))


@query("ves_measured", f"SELECT form, count(*) * 3 AS n_ratios, true AS all_positive FROM (SELECT DISTINCT c_mktsegment FROM customer), (SELECT unnest({[k for k in range(len(FORMS)) if k < 5]}) AS form) GROUP BY form")
def _(spark, d):
    """Statements timed three times each against their ground truths: the times differ from run to run, their number and sign don't."""
    all_of, known = statements(spark, d), cache(spark, d)
    truth = all_of.where("form = 0").select("segment", F.col("sql").alias("truth"))
    ratios = result_cache.efficiency(all_of.join(truth, "segment"), known.time(all_of, 3))
    return ratios.groupBy("form").agg(F.count(F.lit(1)).alias("n_ratios"), F.bool_and(F.col("ratio") > 0).alias("all_positive"))
