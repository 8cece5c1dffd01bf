"""Sources: directories of datasets, result files in several formats, caches, and bounded or seeded prefixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_pair

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
SAMPLE = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("dataset_name", T.StringType()), T.StructField("db_id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("groundtruth_sqls", T.ArrayType(T.StringType())), T.StructField("messages", MESSAGES)])


def datasets(spark: SparkSession, paths: Sequence[str], split: str = "train", fmt: str = "parquet") -> DataFrame:
    """The datasets at the paths, by name; where a dataset has splits (folders named for them), the preferred one. Files are listed, not scanned, to find out which."""
    frames = []
    for path in paths:
        df = spark.read.format(fmt).option("recursiveFileLookup", "true").load(path)
        preferred = any(f"/{split}/" in f for f in df.inputFiles())
        frames.append(df.where(F.contains("_metadata.file_path", F.lit(f"/{split}/"))) if preferred else df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def json_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON array, or objects, over several lines."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0) and value of the lines of text files, which are read in splits. A split's lines are counted first; a line's number is what the splits before it in its file hold, and its place in its own split.

    Both passes read the same splits, as they are made from the same files in the same way. The counts are a row a split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    counts = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))  # rows of a split are numbered in a row
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("file", "start", "first", ahead.alias("ahead"))
    return lines.join(before, ["file", "start"]).select("file", (F.col("ahead") + F.col("row") - F.col("first")).alias("line"), "value")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """sample_idx, sql, db of exported prediction pairs: an object of index to pair, with an entry a line or all on one."""
    body = F.regexp_replace(F.regexp_replace(F.trim("value"), r"^\{", ""), r"(?<=[\"\]\w])\s*,?\s*\}?$", "")  # without the braces of the object and the comma after an entry
    entries = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), "map<string,string>")
    keyed = spark.read.text(path).where(~F.trim("value").isin("{", "}", "")).select(F.explode(entries).alias("k", "v"))
    return keyed.select(F.col("k").cast("long").alias("sample_idx"), parse_pair(F.col("v")).alias("p")).select("sample_idx", "p.*")


def gold_lines(spark: SparkSession, path: str) -> DataFrame:
    """sample_idx, sql, db of a file of `sql TAB db` lines. The index is the line's place in its file."""
    parts = F.split(F.trim("value"), "\t")
    return numbered_lines(spark, path).select(F.col("line").alias("sample_idx"), F.get(parts, 0).alias("sql"), F.get(parts, 1).alias("db"))


def csv_results(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of gold CSV results as instance_id, variant, pos and cells (an array of name and value), whatever columns a file has. `id.csv` wins over its variants `id_a.csv`, `id_b.csv`.

    All files are read in one scan, as wide as the widest header; a file's first row names its columns. A file is read in one piece, as quoted values may hold line ends."""
    texts = spark.read.option("pathGlobFilter", "*.csv").text(folder).where(F.col("_metadata.file_block_start") == 0)
    width = texts.select(F.size(F.split("value", ",")).alias("n")).agg(F.max("n")).first()[0] or 1  # quoted commas only make it wider
    names = [f"c{k}" for k in range(width)]
    read = spark.read.schema(", ".join(f"{n} string" for n in names)).option("multiLine", "true").option("pathGlobFilter", "*.csv").csv(folder)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), F.array(*names).alias("values"))
    heads = rows.groupBy("file").agg(F.min_by("values", "row").alias("head"), F.min("row").alias("first"))  # a row a file
    stem = F.regexp_extract("file", r"([^/]+)\.csv$", 1)
    marked = heads.select("file", "first", F.filter("head", lambda h: h.isNotNull()).alias("head"), stem.alias("stem"), F.regexp_extract(stem, r"^(.*)_([a-z])$", 1).alias("base"), F.nullif(F.regexp_extract(stem, r"^(.*)_([a-z])$", 2), F.lit("")).alias("letter"))
    plain = marked.select(F.col("stem").alias("base"), F.lit(True).alias("has_plain"))
    chosen = marked.join(plain, "base", "left").where("has_plain IS NULL")
    chosen = chosen.select("file", "first", "head", F.when(F.col("base") == "", F.col("stem")).otherwise(F.col("base")).alias("instance_id"), F.when(F.col("base") != "", F.col("letter")).alias("variant"))
    cells = F.transform("head", lambda h, k: F.struct(h.alias("name"), F.get("values", k).alias("value")))
    return rows.join(chosen, "file").where("row > first").select("instance_id", "variant", (F.col("row") - F.col("first") - 1).alias("pos"), cells.alias("cells"))


def find(df: DataFrame, where: Column | None = None, columns: Sequence[str] | None = None, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Predicate, projection and limit (in a stated order) of a document collection."""
    out = df.where(where) if where is not None else df
    if limit is not None:
        out = out.orderBy(*order).limit(limit)
    return out.select(*columns) if columns else out


def scrape(spark: SparkSession, path: str, pattern: str, group: int = 1) -> DataFrame:
    """What a pattern finds on the lines of a log."""
    found = F.regexp_extract("value", pattern, group)
    return spark.read.text(path).select(found.alias("found")).where("found != ''")


def seeded_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows, the same ones every time: those whose key hashes lowest."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k)


def first_rows(df: DataFrame, order: str, n: int, per: str | None = None) -> DataFrame:
    """The first n rows, or the first n of each group."""
    if per is None:
        return df.orderBy(order).limit(n)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(per).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def candidate_rows(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays in long form: one row a candidate, with its idx."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("idx", "__x")).select(*rest, F.col("idx").cast("long"), *(F.col("__x")[a].alias(a) for a in arrays))


def cached_results(spark: SparkSession, path: str, order: str = "index") -> DataFrame:
    """A cache of samples with their candidates, those sorted by their index."""
    return spark.read.parquet(path).withColumn("candidates", F.array_sort("candidates", lambda a, b: (a[order] - b[order]).cast("int")))
