"""Operator 3, mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of each source are shuffled by a hash and queued, pass after pass (up to ``PASSES``). The virtual finish time of
a document is the words of its source up to its end, over the source's target. All entries are ranged by that time
and taken up to the total budget (the words of all sources together).

Targets: sources in order of code point (null last) weigh ``WEIGHTS``, repeating, and share the budget; a target stops at
``PASSES`` times its source's size and the excess is shared again by weight until none is above (water filling).

Running sums go in two steps, so that no source is ordered in one task: rows are dealt to ranges of the shuffle hash (or of
virtual time), each range sums its own rows and gets the total of the ranges before it. Ranges hold about ``RANGE`` rows. The global order by virtual time is needed only where the budget ends: sums by ranges of time
narrow that place down, range within range, until at most ``LAST`` entries are sorted. The sources themselves (one row each) and the ranges of one source are put in order in one task.

Null or empty text has size 0 and is never taken. A source of no words has target 0. Ties in the hash go by doc_id, then size,
and repeated rows are interchangeable. Reruns and any partitioning give the same result. Columns other than
doc_id, text and source are left alone by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table, word_count

WEIGHTS, PASSES, RANGE, SLOTS, LAST = (5, 2, 1), 3, 4000, 4096, 20_000


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs, weight and target from rows of source and size."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("long"))
    # a source stops at its limit before those of larger limit / weight do
    ahead = Window.orderBy((PASSES * F.col("source_size")).cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    total = lambda c: F.sum(c).over(Window.partitionBy())
    passed = lambda c: F.coalesce(F.sum(c).over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (total("source_size") - passed(PASSES * F.col("source_size"))).cast("double") / (total("weight") - passed("weight"))  # running sums only, so this is linear in the sources
    by = by.withColumn("level", level)
    limit = (PASSES * F.col("source_size")).cast("double")
    whole = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level holds for the first source in this order that does not reach its limit, and for all after it
    rest = F.coalesce(F.first(F.when(limit > F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(whole), F.lit(0.0))
    return by.withColumn("target", F.least(limit, rest * F.col("weight"))).drop("level")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for each document."""
    held = docs.select("doc_id", "source", word_count(docs["text"]).alias("size"))
    return _mix(settle(held, "sizes"), seed).select("doc_id", "size", "source_size", "target", "taken")


def _mix(sizes: DataFrame, seed: str) -> DataFrame:
    """The rows of doc_id, source and size (and others) with source_size, target, copies and taken."""
    by = settle(targets(sizes), "targets")
    budget = F.lit(by.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)))
    rows = sizes.join(by.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("key", key)
    rows = rows.withColumn("part", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.ceil(F.col("n_docs") / RANGE)).cast("long"))
    rows = settle(rows, "queued")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.col("ahead") + F.sum("size").over(inside)).drop("ahead", "part", "n_docs", "weight")
    rows = settle(rows, "ends")
    # the virtual times of all passes, taken in order up to the budget
    entry = rows.where("size > 0 AND target > 0").select(
        "source", "key", "doc_id", "size", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("pass"), "end", "source_size", "target"
    ).withColumn("time", (F.col("pass") * F.col("source_size") + F.col("end")).cast("double") / F.col("target"))
    slot = lambda t: F.floor(F.least(t, F.lit(4.0)) * scale).cast("long")
    # the slot of virtual time that the budget ends in is divided again until few entries are left in it (scales are powers of two, so slots nest)
    scale, inside, ahead = SLOTS, entry, 0
    while True:
        slots = inside.groupBy(slot(F.col("time")).alias("slot")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        run = F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))  # 4 * SLOTS + 1 rows at most
        slots = slots.withColumn("run", run + F.lit(ahead))
        cut = slots.where(F.col("run") > budget).agg(F.min("slot").alias("slot"), F.min_by(F.col("run") - F.col("words"), "slot").alias("ahead"), F.min_by("n", "slot").alias("n")).first()
        if cut["slot"] is None or cut["n"] <= LAST or scale >= SLOTS**4:
            break
        inside, ahead = inside.where(slot(F.col("time")) == cut["slot"]), cut["ahead"]
        scale *= SLOTS
    if cut["slot"] is None:
        last = entry.where("false")
        whole = F.lit(1 << 62)
    else:  # the one slot that the budget ends in
        within = Window.orderBy("time", F.col("source").asc_nulls_last(), "pass", "key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        last = entry.where(slot(F.col("time")) == cut["slot"]).withColumn("run", F.lit(cut["ahead"]) + F.sum("size").over(within)).where(F.col("run") <= budget)
        whole = F.lit(cut["slot"])
    time = lambda p: (F.lit(p) * F.col("source_size") + F.col("end")).cast("double") / F.col("target")
    sure = sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & (slot(time(p)) < whole), 1).otherwise(0) for p in range(PASSES)), F.lit(0))
    more = last.groupBy(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("end").alias("e")).agg(F.count(F.lit(1)).alias("more"))
    out = rows.join(more, F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("end") == F.col("e")) & (F.col("size") > 0), "left").drop("s", "d", "e")
    out = out.withColumn("copies", (sure + F.coalesce("more", F.lit(0))).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents that the mix takes, each as often as taken, with all their columns."""
    tag = F.xxhash64("doc_id", "text", "source")
    sizes = settle(docs.select("doc_id", "source", word_count(docs["text"]).alias("size"), tag.alias("tag")), "sizes")
    # rows equal in doc_id, source and text share their copies
    counts = _mix(sizes, seed).groupBy("doc_id", "tag").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    named = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], docs["doc_id"].alias("d"), tag.alias("t"))
    joined = named.join(counts, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tag")))
    alike = Window.partitionBy("d", "t").orderBy(F.lit(1))
    alone = joined.where("n = 1").withColumn("times", F.col("copies"))
    shared = joined.where("n > 1").withColumn("nth", F.row_number().over(alike)).withColumn("times", F.expr("copies div n + if(nth <= copies % n, 1, 0)")).drop("nth")
    out = alone.unionByName(shared).where("times > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), r AS (
  SELECT *, first_value(CASE WHEN CAST(3 * source_size AS DOUBLE) > level * weight THEN level END IGNORE NULLS) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rest FROM l
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), coalesce(rest, 0.0) * weight) AS target FROM r
), q AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS fin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT doc_id, source, size, sum(size) OVER (ORDER BY CAST(pass * source_size + fin AS DOUBLE) / target, source NULLS LAST, pass, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
  FROM q, (VALUES (0), (1), (2)) p(pass) WHERE size > 0 AND target > 0
), k AS (
  SELECT doc_id, sum(size) AS taken FROM e WHERE run <= (SELECT sum(size) FROM d) GROUP BY doc_id
)
SELECT q.doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)
"""
