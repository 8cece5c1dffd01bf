"""What the operators of this subpackage share: tables in the shared folder, reading inputs, row keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of other characters than space and \t\n\v\f\r.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more rows than this, and than 1 / HOT_KEYS of all, is joined by broadcast.
HOT_ROWS, HOT_KEYS = 2000, 1 << 16
#: Bloom filters: least size, and the most words (16 bytes each) that are broadcast.
MIN_BITS, SENT_WORDS = 1 << 16, 1 << 20
_own: dict[str, str] = {}
_scratch: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, else (off a cluster) a folder of our own, else the warehouse."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="resultlens-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def scratch(spark: SparkSession) -> str:
    """This application's folder in the shared one; the driver deletes it when it ends."""
    path = f"{shared_dir(spark).rstrip('/')}/resultlens/{spark.sparkContext.applicationId}"
    if path not in _scratch:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _scratch.add(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it from there: a lost executor costs no recomputation, and no later plan repeats it."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; pure ASCII takes the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_unique(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to a settled table that has each key once, and in `count` how many of the rows have it.

    Rows of a key that is too frequent for one task meet it by broadcast: there are fewer than HOT_KEYS such keys, as each has more than 1 / HOT_KEYS of all rows."""
    total, most = table.agg(F.sum(count), F.max(count)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= least:
        return rows.join(table, keys, how)
    often = F.col(count) > least
    hot = table.where(often)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(~often), keys, how))


def bloom_bits(n: int) -> int:
    """Bits of a filter of n keys: a power of two, 16 a key at least."""
    return max(MIN_BITS, 1 << (16 * n - 1).bit_length()) if n else MIN_BITS


def bloom_place(key: Column, bits: int) -> tuple[Column, Column, Column]:
    """The word of the filter that a key belongs to, and the numbers of its two bits there."""
    h = F.xxhash64(key, F.lit(2))
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits // 64)), *(F.pmod(F.shiftright(h, k), F.lit(64)).cast("int") for k in (0, 8))


def bloom_mask(*places: Column) -> Column:
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]
    return one[0] if len(one) == 1 else one[0].bitwiseOR(one[1])


def bloom_words(keys: DataFrame, bits: int) -> DataFrame:
    """The filter's words that are not zero: word, set. keys: one column."""
    word, *places = bloom_place(F.col(keys.columns[0]), bits)
    return keys.select(word.alias("word"), bloom_mask(*places).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("set"))


def bloom_tested(rows: DataFrame, key: str, words: DataFrame, bits: int, slices: int = 1) -> DataFrame:
    """The rows with a boolean column `maybe`: false where the key surely is not in the filter. The words, or those of one of so many slices, are broadcast; more than SENT_WORDS of them are joined by shuffling the rows."""
    word, *places = bloom_place(F.col(key), bits)
    found = rows.withColumns({"__word": word, "__mask": bloom_mask(*places)})
    words = words.select(F.col("word").alias("__word"), F.col("set").alias("__set"))
    found = found.join(F.broadcast(words) if bits // 64 <= slices * SENT_WORDS else words, "__word", "left")
    return found.withColumn("maybe", F.coalesce(F.col("__set").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))).drop("__word", "__mask", "__set")


def bloom_slices(rows: DataFrame, key: str, words: DataFrame, bits: int) -> list[DataFrame]:
    """`bloom_tested` of settled rows for a filter of any size, one frame a slice of the filter: up to SENT_WORDS words, broadcast, and the rows that fall there. No row moves. Rows and words are written in the order of their
    slices within each partition, so a slice reads its own pages only."""
    slices = -(-(bits // 64) // SENT_WORDS)
    of = F.pmod(bloom_place(F.col(key), bits)[0], F.lit(slices))
    sliced = settle(rows.withColumn("__slice", of).sortWithinPartitions("__slice"), "sliced_rows")
    words = settle(words.withColumn("__slice", F.pmod("word", F.lit(slices))).sortWithinPartitions("__slice"), "sliced_words")
    return [bloom_tested(sliced.where(F.col("__slice") == k).drop("__slice"), key, words.where(F.col("__slice") == k), bits, slices) for k in range(slices)]


def settle_all(parts: list[DataFrame], name: str) -> DataFrame:
    """The parts, of one schema, written one after another, as one table in the shared folder. What a part broadcasts is let go before the next."""
    path, spark = f"{scratch(parts[0].sparkSession)}/{name}-{uuid.uuid4().hex}", parts[0].sparkSession
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def perhaps_among(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose key may be among the n keys (one column), by a broadcast Bloom filter of up to SENT_WORDS words; beyond 16 bits a key in as many words, it lets more of the others through. A join decides afterwards."""
    bits = min(bloom_bits(n), 64 * SENT_WORDS)
    return bloom_tested(rows, key, bloom_words(keys, bits), bits).where("maybe").drop("maybe") if bits else rows


def partitions(df: DataFrame, rows: int, per: int) -> int:
    """Partitions of about `per` rows each, at least as many as the session deals out."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))
