"""Operator 13, benchmark decontamination by winnowing, in DataFrame operations only.

Each K words in a row have a hash; of every ``size - K + 1`` hashes in a row the least one (ties: the first) is a fingerprint. Two equal spans of ``size`` words have the same hashes, so they pick the same
fingerprint at the same place: every shared span of ``size`` words or more holds a common one. Documents' fingerprints are tested against a broadcast Bloom filter of the test items' as they are made. A hit is extended to the windows
of ``size`` words that hold it, which meet the items' windows by SHA-256 of their words; a window that both sides have marks its words. Items shorter than a window are one window; for each such length
(at most ``size - 1`` of them) all hashes of so many words are fingerprints.

Texts never move: the one pass over them leaves a row's number, its count of words and its extended hits. Windows that the same items share form one class, and documents with the same
classes one signature, so that a passage all over the corpus or the test set is looked up once; what very many rows share meets them by broadcast (see ``join_unique``). The filter has at most ``SENT_WORDS``
words, whatever the test set; a fuller filter lets more hits through and changes no result.

Null text has no words, a document without words no hits. Repeated rows and ids are judged each by its text. Items of the same item_id are one item; a null item_id is an empty name. An empty test set contaminates nothing, empty
documents give an empty result. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SENT_WORDS, UPPER, bloom_bits, bloom_tested, bloom_words, join_unique, lower_ascii, settle, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window and of a fingerprint.
SIZE, K = 10, 5
#: Places fit 31 bits, as the elements of an array do.
PLACES = (1 << 31) - 1


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _at(xs: Column, place: Column, count: int) -> Column:
    """Hash of `count` hashes of words in a row from a place (from 0)."""
    return F.xxhash64(*[F.get(xs, place + k) for k in range(count)], F.lit(count))


def _starts(n: Column, size: int) -> Column:
    """0, 1, ... of the runs of `size` among n."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def with_fingerprints(rows: DataFrame, size: int, k: int) -> DataFrame:
    """Rows with `words` get `n`, `hashes` (of words) and `marks`, the places of their fingerprints."""
    rows = rows.withColumns({"n": F.size("words"), "hashes": F.transform("words", lambda w: F.xxhash64(w))})
    coded = F.transform(_starts(F.col("n"), k), lambda p: F.shiftleft(F.shiftrightunsigned(_at(F.col("hashes"), p, k), 33), 31).bitwiseOR(p.cast("long")))
    rows = rows.withColumn("coded", coded)
    span = size - k + 1
    least = F.transform(_starts(F.col("n"), size), lambda p: F.least(*[F.get("coded", p + j) for j in range(span)]) if span > 1 else F.get("coded", p))
    return rows.withColumn("marks", F.transform(F.array_distinct(least), lambda c: c.bitwiseAND(F.lit(PLACES)).cast("int"))).drop("coded")


def windows(starts: Column, size: int | Column) -> Column:
    """Structs of the place, number of words and SHA-256 of the words from each start."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.transform(starts, lambda s: F.struct(s.alias("at"), size.cast("int").alias("len"), F.unhex(F.sha2(F.array_join(F.slice("words", s + 1, size), " ").cast("binary"), 256)).alias("w")))


class Items:
    """The test items' windows by class, their members, the filter of their fingerprints, and the lengths of windows that short items make."""

    def __init__(self, items: DataFrame, size: int, k: int) -> None:
        rows = with_fingerprints(items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item"), words(items["text"]).alias("words")).where("size(words) > 0"), size, k)
        starts = F.when(F.col("n") >= size, _starts(F.col("n"), size)).otherwise(F.array(F.lit(0)))
        rows = settle(rows.select("item", "n", "hashes", "marks", windows(starts, F.least("n", F.lit(size))).alias("windows")), "items")
        self.short = [r["n"] for r in rows.where(F.col("n") < size).select("n").distinct().orderBy("n").collect()]  # fewer than `size` numbers
        keys = rows.where(F.col("n") >= size).select(F.explode(F.transform("marks", lambda p: _at(F.col("hashes"), p, k))).alias("key"))
        for m in self.short:
            keys = keys.unionByName(rows.where(F.col("n") == m).select(_at(F.col("hashes"), F.lit(0), m).alias("key")))
        keys = settle(keys.distinct(), "keys")
        self.bits = min(bloom_bits(keys.count()), 64 * SENT_WORDS)
        self.filter = settle(bloom_words(keys, self.bits), "filter")
        pairs = settle(rows.select("item", F.explode("windows.w").alias("w")).distinct(), "pairs")
        sums = [F.count(F.lit(1)), F.sum(F.xxhash64("item").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("item", F.lit(1)))]
        self.classes = settle(pairs.groupBy("w").agg(F.concat_ws(":", *[s.cast("string") for s in sums]).alias("class")), "classes")
        first = self.classes.groupBy("class").agg(F.min("w").alias("w"))
        self.members = settle(pairs.join(first, "w").select("class", "item"), "members")


def extended(docs: DataFrame, known: Items, size: int, k: int) -> DataFrame:
    """One pass over the texts. For each row of docs: row (its number), doc_id, n (its words) and a null p; and for each hit of the filter its place p and the windows that may hold it."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"], words(docs["text"]).alias("words"))
    rows = with_fingerprints(numbered, size, k)
    mark = lambda p, m: F.struct(p.alias("p"), F.lit(m).alias("len"), _at(F.col("hashes"), p, k if m == size else m).alias("key"))
    every = lambda m: F.transform(_starts(F.col("n"), m), lambda p: mark(p, m))
    marks = [F.transform("marks", lambda p: mark(p, size)), *map(every, known.short)]
    itself = F.array(F.struct(F.lit(None).cast("int").alias("p"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("key")))
    spread = rows.select("row", "doc_id", "n", "words", F.inline(F.concat(itself, *marks)))
    hits = bloom_tested(spread, "key", known.filter, known.bits).where("p IS NULL OR maybe")
    p, n = F.col("p"), F.col("n")
    around = F.when(p.isNull(), F.array().cast("array<int>")).when(F.col("len") == size, F.sequence(F.greatest(F.lit(0), p - (size - k)), F.least(p, n - size))).otherwise(F.array(p))
    return hits.select("row", "doc_id", "n", "p", windows(around, F.col("len")).alias("windows"))


def judged(docs: DataFrame, items: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs."""
    known = Items(items, size, k)
    found = settle(extended(docs, known, size, k), "found")
    spots = found.where("p IS NOT NULL").select("row", F.inline("windows"))
    shared = settle(spots.groupBy("w").agg(F.count(F.lit(1)).alias("spots")).join(known.classes, "w"), "shared")
    hits = join_unique(spots, shared, ["w"], "spots").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end")))).alias("spans"), F.sort_array(F.collect_set("class")).alias("classes"))
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate("spans", begin, lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["at"]))).alias("sum")), lambda a: a["sum"])
    hits = settle(hits.select("row", covered.alias("n_hit"), "classes", F.sha2(F.array_join("classes", ",").cast("binary"), 256).alias("signature")), "hits")

    signatures = settle(hits.groupBy("signature").agg(F.count(F.lit(1)).alias("rows"), F.any_value("classes").alias("classes")), "signatures")
    named = signatures.select("signature", F.explode("classes").alias("class")).join(known.members, "class").groupBy("signature").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = named.select("signature", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    named = settle(signatures.select("signature", "rows").join(named, "signature"), "named")
    by_row = join_unique(hits.drop("classes"), named, ["signature"], "rows").drop("signature", "rows")

    out = found.where("p IS NULL").select("row", "doc_id", F.col("n").cast("long").alias("n_words")).join(by_row, "row", "left")
    n_hit, empty = F.coalesce("n_hit", F.lit(0).cast("long")), F.sha2(F.lit("").cast("binary"), 256)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", empty).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents
), b AS MATERIALIZED (SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(len(w), {SIZE}) AS m FROM (SELECT item_id, {_SPLIT} AS w FROM benchmark) WHERE len(w) > 0
), i AS MATERIALIZED (SELECT DISTINCT item, m, w[p + 1 : p + m] AS g FROM (SELECT item, w, m, unnest(range(len(w) - m + 1)) AS p FROM b)
), h AS MATERIALIZED (
  SELECT DISTINCT r, p, m, g FROM (SELECT r, m, p, w[p + 1 : p + m] AS g FROM (SELECT r, w, m, unnest(range(len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)) SEMI JOIN i USING (m, g)
), c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM h) GROUP BY r
), n AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h JOIN i USING (m, g)) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)
"""
