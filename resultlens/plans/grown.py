"""Queries over memories that grow and stored structures: the online memory of thoughts, the index of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vector_index, vectors
from ..streaming import memory
from . import bindings as b
from .catalogue import query
from .memory_text import _COS, _D2, _HITS, _TH, _TTR, _near
from .roundtrip import folder

#: The least hits, their density and the ratio of bigrams, as the gate of these thoughts asks for them.
GATE = {"hits": 1, "density": 0.004, "ttr": 0.5}


def thoughts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as thoughts, with the vector of their number, correct where their label says so."""
    th = b.thoughts(spark, d).select(F.col("doc_id").alias("arrival"), F.lit("set").alias("dataset"), F.col("db_id").alias("db"), "prompt", F.col("text").alias("thought"))
    own = b.t(spark, d, "embeddings").select(F.col("vec_id").alias("arrival"), "embedding")
    marks = b.t(spark, d, "labels").groupBy(F.col("doc_id").alias("arrival")).agg(F.max(F.col("quality") == 1).alias("correct"))
    return th.join(own, "arrival").join(marks, "arrival", "left")


@query("online_memory", f"""WITH RECURSIVE {_TH}, g AS (SELECT doc_id, db_id, text, n_words, coalesce({_HITS}, 0) AS hits, {_TTR} AS ttr, len(list_filter(cols, lambda c: c <> '')) AS n_cols FROM words),
marks AS (SELECT doc_id, max(quality) = 1 AS correct FROM labels GROUP BY doc_id),
good AS (SELECT doc_id, 'mem_' || sha1('set' || chr(0) || db_id || chr(0) || text) AS id, CASE WHEN correct THEN 'correct' ELSE 'failed' END AS collection, CAST(embedding AS DOUBLE[]) AS embedding
  FROM g JOIN embeddings ON vec_id = doc_id LEFT JOIN marks USING (doc_id) WHERE n_words BETWEEN 30 AND 2000 AND n_cols > 0 AND hits >= {GATE['hits']} AND hits / CAST(greatest(n_words, 1) AS DOUBLE) >= {GATE['density']} AND ttr >= {GATE['ttr']}),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS k, *, list(k0) OVER (PARTITION BY collection, id) AS same FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS k0 FROM good)),
n AS MATERIALIZED (SELECT p.k, list({{'j': m.k, 'c': {_COS.format("m.embedding", "p.embedding")}}} ORDER BY round({_D2}, 9), m.id) AS near FROM o m JOIN o p ON m.collection = p.collection AND m.k < p.k GROUP BY p.k),
s AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL
  SELECT o.k, CASE WHEN coalesce(list_filter(near, lambda x: list_contains(kept, x.j))[1].c < 0.9, true) AND NOT list_has_any(kept, same) THEN list_append(kept, o.k) ELSE kept END FROM s JOIN o ON o.k = s.k + 1 LEFT JOIN n ON n.k = o.k)
SELECT doc_id AS arrival, id, collection FROM o WHERE k IN (SELECT unnest(kept) FROM s WHERE k = (SELECT max(k) FROM s))""")  # fmt: skip
def _(spark, d):
    """Thoughts that arrive in four parts, and enter a memory that is empty at first."""
    at, rows = folder(spark), thoughts(spark, d)
    rows.write.parquet(f"{at}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{at}/rows")
    last = rows.agg(F.max("arrival")).first()[0] or 0
    for k in range(4):  # each part is taken in before the next arrives, by a stream that goes on where it stopped
        rows.where((F.col("arrival") * 4 >= k * (last + 1)) & (F.col("arrival") * 4 < (k + 1) * (last + 1))).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        memory.grow_thoughts(stream, f"{at}/memory", f"{at}/state", block=100, **GATE).awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/memory").select("arrival", "id", "collection")


def _index(name: str, scope: str, cond: str) -> None:
    @query(name, f"WITH {b.MEMORY} SELECT probe_id, id, round(distance, 6) AS distance, place FROM {_near(cond)}")
    def _(spark, d):
        """An index of all vectors, of which every list is looked at."""
        at = folder(spark)
        vector_index.build(b.memory(spark, d), at, lists=16)
        return vector_index.search(spark, at, b.probes(spark, d), 5, 16, scope).withColumn("distance", F.round("distance", 6))


_index("index_topk_any_db", "any", "true")
_index("index_topk_same_db", "same", "m.db_id = p.db_id")


@query("index_recall", "SELECT count(*) AS n_probes, true AS enough FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL")
def _(spark, d):
    """Whether as many of an index's lists as it asks for hold nine tenths of the five nearest of all probes."""
    at, m, p = folder(spark), b.memory(spark, d), b.probes(spark, d)
    vector_index.build(m, at, lists=16)
    found = vector_index.recall(vector_index.search(spark, at, p, 5, vector_index.lists_for(spark, at, 5, 0.95)), vectors.nearest(p, m, 5))
    return found.select("n_probes", (F.col("recall") >= 0.9).alias("enough"))
