"""Operator 8, exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one sets, for the hash of each normalised text, two bits of one word of a Bloom filter, and keeps the bits that were set
twice or more (equal bits meet map-side, so a hot text moves a few rows only). Pass two tests each hash
against that filter: where not both bits were set twice, the text is surely unique and its row passes straight on;
only the possibly repeated hashes shuffle, whole SHA-256, which decides. What Bloom errors let through is found
unique there, so the result is exact.

The filter has 16 bits a row or more at every size. Up to ``SENT_WORDS`` words (4 million rows) it is broadcast at once; a larger one is broadcast slice by slice, each to the settled hashes that fall
in it, so that unique rows do not move at any size. Where texts are to be returned (``drop_copies``), a second filter of the hashes that truly repeat lets the rows of all others pass where they are; it
stays within ``SENT_WORDS`` words, so from 4 million repeated texts on it lets more rows through to the join (about a fifth of them at 16 million). A hash of very many rows is no task's burden: it meets
its group by broadcast (see ``join_unique``).

Null text counts as empty. Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
largest doc_id stays; of rows that also share that doc_id, one. A null doc_id is the smallest. Empty tables give
empty results. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import bloom_bits, bloom_mask, bloom_place, bloom_slices, bloom_tested, bloom_words, join_unique, lower_ascii, settle, settle_all, table


def text_key(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def possibly_repeated(hashed: DataFrame) -> DataFrame:
    """The settled rows with a boolean column `maybe`: false where their sha surely occurs once."""
    bits = bloom_bits(hashed.count())
    word, *places = bloom_place(F.col("sha"), bits)
    ones = hashed.select(word.alias("word"), F.explode(F.array_distinct(F.array(*places))).alias("place"))
    twice = ones.groupBy("word", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = twice.groupBy("word").agg(F.bit_or(bloom_mask(F.col("place"))).alias("set"))
    if 0 < common.SENT_WORDS < bits // 64:
        return settle_all(bloom_slices(hashed, "sha", words, bits), "tested")
    return bloom_tested(hashed, "sha", settle(words, "filter"), bits)


def decide(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = settle(docs.select("doc_id", text_key(docs["text"]).alias("sha")), "hashes")
    tested = possibly_repeated(hashed)
    unique = tested.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    maybe = settle(tested.where("maybe").select("doc_id", "sha", F.monotonically_increasing_id().alias("row")), "maybe")  # a row's number is fixed once written
    groups = settle(maybe.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size")), "groups")
    found = join_unique(maybe, groups, ["sha"], "group_size").select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "sha")
    return unique.unionByName(found).withColumnRenamed("sha", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Rows of texts that surely are unique do not move."""
    added = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], docs["doc_id"].alias("id"), text_key(docs["text"]).alias("sha"))
    hashed = settle(added.select("id", "sha"), "hashes")
    per_id = possibly_repeated(hashed).where("maybe").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
    groups = per_id.groupBy("sha").agg(F.max(F.struct("id", "n")).alias("top"), F.sum("n").alias("size")).where("size > 1")
    groups = settle(groups.select("sha", F.col("top.id").alias("keep_id"), F.col("top.n").alias("n_top"), "size"), "groups")
    bits = min(bloom_bits(groups.count()), 64 * common.SENT_WORDS)
    if bits:
        tested = bloom_tested(added, "sha", bloom_words(groups.select("sha"), bits), bits)
    else:
        tested = added.withColumn("maybe", F.lit(True))
    found = join_unique(tested.where("maybe").drop("maybe"), groups, ["sha"], "size", "left").where(F.col("size").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    stay = tested.where("NOT maybe").drop("maybe")
    one, several = found.where("n_top IS NULL OR n_top = 1"), found.where("n_top > 1").dropDuplicates(["sha"])
    names = [f"c{i}" for i in range(len(docs.columns))]
    return stay.select(*names).unionByName(one.select(*names)).unionByName(several.select(*names)).toDF(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
