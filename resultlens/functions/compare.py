"""Comparing result sets: one canonical row key with a mode, and the equalities, signatures and graded scores that derive from it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

MODES = ("positional", "agnostic", "named", "raw", "graded")
#: Rows from which a result is ranked by ranges, and into how many.
LARGE_RESULT, RANGES = 1_000_000, 64
#: Rows that a task tells apart at a time, and the most tasks for which rows are dealt (up to which Spark's shuffle writes them as they come and holds none).
TASK_ROWS, MOST_TASKS = 250_000, 200
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def float_text(c: Column) -> Column:
    """One spelling of a number for all engines, to six places; null stays null."""
    return F.when(c.isNotNull(), F.format_string("%.6f", c.cast("double")))


def number_text(c: Column, kind: T.DataType) -> Column:
    """The spelling that equal numbers share whatever their type: whole numbers as such, others by the shortest spelling of the double. No number meets another: 2**53 and 2**53 + 1 differ, 1e-7 is not 0,
    0.0 and -0.0 are equal. NaN, like null, has none."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        whole = d.try_cast("decimal(38,0)")  # exact for whole doubles, null where it does not fit
        text = F.when((F.abs(d) < 1e18) & (d == F.floor(d)), whole.cast("string")).otherwise((d + F.lit(0.0)).cast("string"))
        return F.when(~F.isnan(d), text)
    if isinstance(kind, T.DecimalType):
        return F.when(c == F.floor(c), F.floor(c).cast("decimal(38,0)").cast("string")).otherwise(c.cast("double").cast("string"))
    return c.cast("string")


def _part(*values: Column) -> Column:
    """Texts as one from which each can be told: every one with its length before it."""
    return F.concat(*(x for v in values for x in (F.length(v).cast("string"), F.lit(":"), v)))


def _typed(c: Column, kind: T.DataType) -> Column:
    """Numbers by value (1 equals 1.0), tagged apart from text; null and NaN as the empty string."""
    if isinstance(kind, NUMERIC):
        return F.coalesce(F.concat(F.lit("n"), number_text(c, kind)), F.lit("s"))
    return F.concat(F.lit("s"), F.coalesce(c.cast("string"), F.lit("")))


def _text(c: Column, kind: T.DataType) -> Column:
    """As text; null and NaN are empty."""
    value = F.when(~F.isnan(c), c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c
    return F.coalesce(value.cast("string"), F.lit(""))


def graded_value(c: Column, eps: float = 1e-6) -> Column:
    """Rounded where it is a number or looks like one, else stripped and lower-cased."""
    digits = min(9, max(0, round(-log10(eps)))) if eps > 0 else 6
    text = strip(c.cast("string"))
    number = F.bround(text.try_cast("double"), digits) + F.lit(0.0)
    return F.coalesce(F.when(number.isNotNull(), F.format_string(f"%.{max(digits, 1)}f", number)), F.lower(text))


def row_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """The row as signatures spell it: values as text, sorted in the row, joined by bars."""
    return F.array_join(F.array_sort(F.array(*(_text(df[c], df.schema[c].dataType) for c in columns))), "|")


def row_key(df: DataFrame, columns: Sequence[str], mode: str) -> Column:
    """The key by which rows of a result are compared; different rows have different keys. positional: column order, numbers by value. agnostic: values as text, sorted in the row.
    named: positional in the order of column names. raw: as positional, null stays null. graded: rounded values."""
    kinds = {c: df.schema[c].dataType for c in columns}
    if mode == "agnostic":
        return F.array_join(F.transform(F.array_sort(F.array(*(_text(df[c], kinds[c]) for c in columns))), lambda v: _part(v)), "")
    if mode == "named":
        columns = sorted(columns)
    if mode == "raw":
        return _part(*(F.when(df[c].isNull(), F.lit("0")).otherwise(_typed(df[c], kinds[c])) for c in columns))
    if mode == "graded":
        return _part(*(F.coalesce(graded_value(df[c]), F.lit("")) for c in columns))
    return _part(*(_typed(df[c], kinds[c]) for c in columns))


def result_digests(cells: DataFrame, result: str, columns: Sequence[str], mode: str) -> DataFrame:
    """One row a result: n_rows (distinct rows), and the sum and the exclusive or of 64-bit hashes of its distinct row keys (192 bits that equal sets share). Rows are dealt by their hashes; no task holds a whole result."""
    return key_digests(cells.select(result, row_key(cells, columns, mode).alias("key")), result)


def once_a_batch(rows: DataFrame) -> DataFrame:
    """Rows without their repeats in an Arrow batch, so of a very common row few copies are moved; memory is that of a batch."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from pa.Table.from_batches([b]).group_by(b.schema.names, use_threads=False).aggregate([]).to_batches()

    return rows.mapInArrow(firsts, rows.schema)


def key_digests(keyed: DataFrame, result: str) -> DataFrame:
    """The digests of results whose row keys (`key`) are at hand."""
    half = lambda k: F.conv(F.substring(F.sha2("key", 256), 1 + 15 * k, 15), 16, 10).cast("long")
    names = ["__h0", "__h1", "__h2"]
    hashed = keyed.select(result, *(half(k).alias(n) for k, n in enumerate(names)))
    tasks = min(MOST_TASKS, max(1, -(-keyed.count() // TASK_ROWS)))
    rows = once_a_batch(hashed).repartition(tasks, result, *names).distinct()  # dealt first: what is read is not gathered, however much of it one task reads
    return rows.groupBy(result).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("__h0").cast("decimal(38,0)")).alias("d1"), F.bit_xor("__h1").alias("d2"), F.bit_xor("__h2").alias("d3"))


def compare_sets(pairs: DataFrame, cells: DataFrame, columns: Sequence[str], mode: str, left: str = "pred_id", right: str = "gold_id", result: str = "result_id") -> DataFrame:
    """The pairs with `equal`: whether both results have the same set of rows. A pair with a null side is unequal; two empty results are equal. mode: one of MODES, or a registered name."""
    digests = result_digests(cells, result, columns, COMPARATORS.get(mode, mode))
    one, two = (digests.select(F.col(result).alias(k), F.struct("n_rows", "d1", "d2", "d3").alias(n)) for k, n in ((left, "__p"), (right, "__g")))
    joined = pairs.join(one, left, "left").join(two, right, "left")
    equal = F.col(left).isNotNull() & F.col(right).isNotNull() & F.col("__p").eqNullSafe(F.col("__g"))
    return joined.withColumn("equal", equal).drop("__p", "__g")


def any_variant(pairs: DataFrame, cells: DataFrame, columns: Sequence[str], mode: str = "agnostic", keys: Sequence[str] = ("sample_id", "idx"), left: str = "pred_id", right: str = "gold_id") -> DataFrame:
    """keys and `equal`: whether the candidate's result equals that of any variant of the ground truth. pairs: one row for each candidate and variant."""
    return compare_sets(pairs, cells, columns, mode, left, right).groupBy(*keys).agg(F.bool_or("equal").alias("equal"))


COMPARATORS = {"positional": "positional", "agnostic": "agnostic", "named": "named", "raw": "raw"}


def register_comparator(name: str, mode: str) -> None:
    """Make a comparison mode known under a name of one's own, by which compare_sets then finds it."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    COMPARATORS[name] = mode


def signatures(results: DataFrame, cells: DataFrame, columns: Sequence[str], result: str = "result_id", most: int = 200, error_most: int | None = None) -> DataFrame:
    """The results (with ok, error, and n_rows where rows are not at hand) with `signature`: ERROR, SUCCESS_ROWS_COUNT or SUCCESS_VALUES, the values cut to `most` characters.

    No more than the first `most` of a result's sorted rows can show, so no more are gathered."""
    keyed = cells.select(result, row_text(cells, columns).alias("key")).distinct()
    nth = F.row_number().over(Window.partitionBy(result).orderBy("key"))
    firsts = keyed.withColumn("__n", nth).where(F.col("__n") <= most + 1)
    sets = firsts.groupBy(result).agg(F.array_join(F.array_sort(F.collect_list("key")), ";").alias("__v"))
    error = F.coalesce("error", F.lit("None"))
    error = F.substring(error, 1, error_most) if error_most else error
    value = F.concat(F.lit("SUCCESS_VALUES:"), F.substring(F.coalesce("__v", F.lit("")), 1, most))
    if "rows_known" in results.columns:
        value = F.when(F.col("rows_known"), value).otherwise(F.concat(F.lit("SUCCESS_ROWS_COUNT:"), F.coalesce(F.col("n_rows").cast("string"), F.lit("None"))))
    return results.join(sets, result, "left").withColumn("signature", F.when(F.col("ok"), value).otherwise(F.concat(F.lit("ERROR: "), error))).drop("__v")


def ranked_rows(keyed: DataFrame, result: str, order: str) -> DataFrame:
    """The rows (result, order, key) with `nth`, the place among rows of the same key, and `rank`, the place in the result, both by `order`.

    A result of more than ``LARGE_RESULT`` rows is dealt to ranges of `order`: ranges are counted, and rows numbered within theirs, so no task sorts a whole result. Results that small need no counts."""
    place = lambda *by: F.row_number().over(Window.partitionBy(result, *by).orderBy(order))
    sizes = keyed.groupBy(result).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(order, F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), F.lit(20 * RANGES)).alias("bounds"))
    large = keyed.groupBy(result).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_RESULT).select(result)
    whole = lambda rows: rows.select(result, "key", place("key").alias("nth"), place().alias("rank"))
    if large.isEmpty():
        return whole(keyed)
    bounds = F.broadcast(sizes.join(large, result, "left_semi").select(result, "bounds"))  # fewer than one row in LARGE_RESULT
    dealt = keyed.join(bounds, result).withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col(order)))).drop("bounds")

    def ahead(*by: str) -> DataFrame:
        """How many rows the ranges before each range have."""
        counts = dealt.groupBy(result, *by, "range").agg(F.count(F.lit(1)).alias("__n"))
        return counts.withColumn("__n", F.sum("__n").over(Window.partitionBy(result, *by).orderBy("range")) - F.col("__n"))

    inside = dealt.withColumns({"__nth": place("key", "range"), "__rank": place("range")})
    numbered = inside.join(ahead("key").withColumnRenamed("__n", "__k"), [result, "key", "range"]).join(ahead().withColumnRenamed("__n", "__r"), [result, "range"])
    numbered = numbered.select(result, "key", (F.col("__nth") + F.col("__k")).alias("nth"), (F.col("__rank") + F.col("__r")).alias("rank"))
    return whole(keyed.join(F.broadcast(large), result, "left_anti")).unionByName(numbered)


def graded(pairs: DataFrame, cells: DataFrame, columns: Sequence[str], order: str, mode: str = "rankcorr", alpha: float = 0.5, gamma: float = 1.2, left: str = "pred_id", right: str = "gold_id", result: str = "result_id") -> DataFrame:
    """The pairs with coverage, order_score and score in [0, 1].

    coverage: multiset overlap of rows over the larger count; order: ranks (in the full results) of the common row tokens, by Spearman (``rankcorr``) or footrule;
    score: coverage ** gamma * (alpha * order + 1 - alpha). Two empty results score 0."""
    if mode not in ("rankcorr", "footrule"):
        raise ValueError(f"no such mode: {mode}")
    keyed = cells.select(result, order, row_key(cells, columns, "graded").alias("key"))
    ranked = ranked_rows(keyed, result, order)
    size = ranked.groupBy(result).agg(F.count(F.lit(1)).alias("n"))
    pred = pairs.select(left, right).distinct()
    common = (
        pred.join(ranked.select(F.col(result).alias(left), "key", "nth", F.col("rank").alias("ra")), left)
        .join(ranked.select(F.col(result).alias(right), "key", "nth", F.col("rank").alias("rb")), [right, "key", "nth"])
        .groupBy(left, right)
        .agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("ra") - F.col("rb")) ** 2).alias("d2"), F.sum(F.abs(F.col("ra") - F.col("rb"))).cast("double").alias("d1"))
    )
    k = F.coalesce("k", F.lit(0)).cast("double")
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    if mode == "rankcorr":
        raw = clip((1 - F.try_divide(6 * F.col("d2"), k * (k * k - 1)) + 1) / 2)
    else:
        raw = clip(1 - F.try_divide(F.col("d1"), F.floor(k * k / 2).cast("double")))
    out = pairs.join(common, [left, right], "left")
    for side, name in ((left, "__np"), (right, "__ng")):
        out = out.join(size.select(F.col(result).alias(side), F.col("n").alias(name)), side, "left")
    n_p, n_g = F.coalesce("__np", F.lit(0)), F.coalesce("__ng", F.lit(0))
    out = out.withColumn("coverage", k / F.greatest(n_p, n_g, F.lit(1)))
    out = out.withColumn("order_score", F.when(k <= 1, 1.0).otherwise(raw))
    score = F.pow("coverage", F.lit(gamma)) * (alpha * F.col("order_score") + (1 - alpha))
    return out.withColumn("score", clip(score)).drop("__np", "__ng", "k", "d1", "d2")


def same_columns(pred: DataFrame, gold: DataFrame) -> DataFrame | None:
    """The column gate of graded comparison: the prediction in the order of the ground truth's columns; None if the names differ."""
    return pred.select(*gold.columns) if set(pred.columns) == set(gold.columns) else None


def keep_last_names(df: DataFrame) -> DataFrame:
    """Of columns of one name the last stays, in the place of the first."""
    last = {c: k for k, c in enumerate(df.columns)}
    if len(last) == len(df.columns):
        return df
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).select(*(F.col(f"c{k}").alias(c) for c, k in last.items()))
