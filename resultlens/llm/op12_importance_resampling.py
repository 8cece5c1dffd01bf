"""Operator 12, target-distribution importance resampling over partition-local word tries.

Features are the runs of 1 to ``longest`` words, hashed to buckets by the CRC-32 of their bytes. A task keeps a trie of the words it meets: a node stands for a feature and holds its count and the state of
the CRC after its bytes, so a longer feature costs one step more and no feature is spelled out. Counts are merged into bucket totals, which are as many numbers as there are buckets whatever the corpus; they give
each bucket a gain, the log-ratio of its smoothed shares in the target texts and in the corpus. The second pass walks each document's paths in a trie whose nodes carry the gains, and Gumbel noise
from the document's id turns the floored mean gain into a score whose order draws the sample.

A trie is emptied at ``NODES`` nodes, so a task's memory doesn't grow with its partition. The draw finds the least score from the counts of scores, sorts only rows from that score up by ranges, and ranks them
by their place in the sorted files: no task holds more than a range.

Null text has no words. Ties of score go to the smaller doc_id (null last), then to fewer features. A null doc_id draws its noise as an empty one. Repeated rows are drawn each. Empty tables give empty results, an empty
target leaves smoothed shares of nothing. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, settle, table

LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Nodes of a trie before it is emptied, and rows of a range of the sorted draw.
NODES, RANGE_ROWS = 200_000, 500_000
#: Bytes of words as they are, A-Z lower-cased; all others part words. Bytes from 128 on belong to other characters than ASCII.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Trie:
    """How a trie's nodes begin, and how many there are."""

    __slots__ = ("begin", "nodes")

    def __init__(self, begin: Callable[[int], int]) -> None:
        self.begin, self.nodes = begin, 0

    def root(self) -> Node:
        self.nodes = 0
        return Node(self, None)


class Node(dict):
    """A feature: its children by their last word, the CRC of its bytes, and its count or gain."""

    __slots__ = ("trie", "crc", "value")

    def __init__(self, trie: Trie, crc: int | None) -> None:
        self.trie, self.crc, self.value = trie, crc, 0 if crc is None else trie.begin(crc)

    def __missing__(self, word: bytes) -> Node:
        child = self[word] = Node(self.trie, crc32(word) if self.crc is None else crc32(word, crc32(b" ", self.crc)))
        self.trie.nodes += 1 + len(word) // 256
        return child


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def paths(root: Node, found: list[bytes], longest: int) -> Iterator[list[Node]]:
    """The nodes of all features of one word, of two words, and so on."""
    level = [root[w] for w in found]
    yield level
    for k in range(1, longest):
        level = [node[w] for node, w in zip(level, found[k:], strict=False)]
        yield level


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, [t or b"" for t in batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(lambda crc: 0), np.zeros(buckets, np.int64)
        root = trie.root()

        def merge() -> None:
            todo = [root]
            while todo:
                for node in todo.pop().values():
                    totals[node.crc % buckets] += node.value
                    if node:
                        todo.append(node)

        for _, texts in _texts(batches):
            for text in texts:
                for level in paths(root, words(text), longest):
                    for node in level:
                        node.value += 1
                if trie.nodes > NODES:
                    merge()
                    root = trie.root()
        merge()
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """The floored log-ratio of each bucket's smoothed shares, in thousandths."""
    size, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return [math.floor(1000 * math.log((t + 1.0) * (all_corpus + size) / ((s + 1.0) * (all_target + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def noise(doc_id: object, seed: int) -> int:
    """Gumbel noise of a document, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(lambda crc: gain[crc % len(gain)])
        root = trie.root()
        for batch, texts in _texts(batches):
            ids, out = batch.column("doc_id"), []
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                found, n, total = words(text), 0, 0
                for level in paths(root, found, longest):
                    n += len(level)
                    total += sum([node.value for node in level])
                weight = total // n if n else 0
                out.append((len(found), n, weight, weight + noise(doc_id, seed)))
                if trie.nodes > NODES:
                    root = trie.root()
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], ["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def drawn(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The settled rows of ``scored`` with their rank among those of enough words, null for rows that are not drawn."""
    fit = F.col("n_words") >= least_words
    counts = rows.where(fit).groupBy("score").count().orderBy(F.desc("score")).collect()  # whole thousandths of bounded logarithms: some 10**5 at most
    take, above, cut = sum(r["count"] for r in counts) * percent // 100, 0, None
    for r in counts:
        if above >= take:
            break
        above, cut = above + r["count"], r["score"]
    none = F.lit(None).cast("long")
    if cut is None:
        return rows.withColumn("rank", none)
    top = fit & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    spread = rows.where(top).withColumn("row", F.monotonically_increasing_id())  # rows equal in all else can still be parted
    ordered = settle(spread.repartitionByRange(partitions(rows, above, RANGE_ROWS), *order).sortWithinPartitions(*order).drop("row"), "ordered")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    placed = ordered.select("*", part.alias("part"), F.col("_metadata.row_index").alias("place"))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # a row for each range
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    ranked = placed.join(before, "part").withColumn("rank", F.when(rank <= take, rank)).drop("part", "place", "before")
    return ranked.unionByName(rows.where(~top).withColumn("rank", none))


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Each document's doc_id, n_words, n_features, weight, score and rank; rank is null where the document isn't drawn."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    return drawn(settle(scored(docs, gain, longest, seed), "scored"), least_words, percent)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_SPLIT = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents), b AS MATERIALIZED (SELECT {_SPLIT} AS w FROM benchmark),
steps AS MATERIALIZED (
  SELECT list_transform(range(256), lambda k: list_reduce(list_concat([k], range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
), v AS (SELECT DISTINCT w FROM (SELECT unnest(w) AS w FROM d UNION ALL SELECT unnest(w) FROM b)
), h AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS k FROM v, steps
), s AS (SELECT k, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) JOIN h USING (w) GROUP BY k
), t AS (SELECT k, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) JOIN h USING (w) GROUP BY k
), g AS MATERIALIZED (
  SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)
), e AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM (SELECT r, unnest(w) AS w FROM d) JOIN h USING (w) JOIN g USING (k) GROUP BY r
), o AS (
  SELECT r, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN e USING (r)
), p AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, count(*) OVER () AS n FROM o WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * n // 100 THEN k END AS rank FROM o LEFT JOIN p USING (r)
"""
