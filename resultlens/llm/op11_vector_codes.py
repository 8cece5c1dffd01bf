"""Operator 11, vector code compression (product quantisation) with annular norm pruning.

Vectors of whole numbers are cut into equal parts; each part position has a codebook, refined in rounds of nearest-entry assignment and componentwise means. An assignment sorts the
codebook by norm. As | |x| - |c| | <= |x - c|, an entry can only be as near as the best one so far if its norm lies within that distance of |x|: a binary search gives this annulus, and all of it, borders
included, is evaluated exactly in whole numbers (ties go to the lower index). Vectors are taken in runs of similar norm, whose annuli nearly coincide; a run evaluates their union at once.

Spark holds the vectors; a codebook (``parts`` x ``entries`` x width numbers, bounded by parameters) travels with the tasks, and each task returns one partial sum an entry, so neither a hot vector nor
a hot entry gathers rows anywhere. The cleaned vectors are written once, so that all rounds see the same rows.

Vectors that are null, or hold a null or a component that is not finite, are dropped. Of vectors of several lengths those of the most frequent length stay (ties: the longer). A length that the parts don't
divide leaves its remainder to the last part. Whole numbers beyond 2**24 count as that bound, so that distances fit a long (up to 8191 components). Repeated rows count each; rows of equal vec_id start the
codebook in the order of their vectors; a null vec_id comes last. Fewer vectors than entries give shorter codebooks, empty tables an empty result. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, settle, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest whole number of a component.
BOUND = 1 << 24
#: Vectors of similar norm that are evaluated at once, and the entries that give them a first distance.
RUN, FIRST = 256, 8


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as longs; null for a vector that is null or has a null or a component that is not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))  # NaN is the largest number to Spark
    return F.when(fine, F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("long")))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry of the book, and the squared distance; rows and entries of whole numbers (int64)."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * largest**2 < 1 << 53 else np.int64  # both are exact; doubles multiply faster
    x, book = x.astype(kind), book.astype(kind)
    square, norms2 = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", book, book)
    order = np.argsort(norms2, kind="stable")
    book, norms2 = book[order], norms2[order]
    norms, norm = np.sqrt(norms2), np.sqrt(square)
    slack = 1e-9 * (1 + max(norms.max(initial=0), norm.max(initial=0)))  # for the rounding of roots
    index, least = np.zeros(len(x), np.int64), np.zeros(len(x), kind)
    by_norm = np.argsort(norm, kind="stable")
    for k in range(0, len(x), RUN):
        run = by_norm[k : k + RUN]
        rows, own = x[run], norm[run]
        exact = lambda a, b: square[run][:, None] + norms2[a:b] - 2 * (rows @ book[a:b].T)  # noqa: B023, E731
        mid = int(np.searchsorted(norms, own[len(run) // 2]))
        a, b = max(0, mid - FIRST), max(1, min(len(book), mid + FIRST))
        radius = np.sqrt(exact(min(a, b - 1), b).min(axis=1)) + slack
        lo = int(np.searchsorted(norms, (own - radius).min(), "left"))
        hi = int(np.searchsorted(norms, (own + radius).max(), "right"))
        distance = exact(lo, hi)
        least[run] = best = distance.min(axis=1)
        index[run] = np.where(distance == best[:, None], order[lo:hi], len(order)).min(axis=1)
    return index, least.astype(np.int64)


def cuts(length: int, parts: int) -> list[slice]:
    """Where the parts of a vector lie; the last one takes what the others leave."""
    width = length // parts
    return [slice(p * width, (p + 1) * width if p < parts - 1 else length) for p in range(parts)]


def _rows(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, length)


def refined(vectors: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry is the floored mean of the parts that are nearest to it; unused entries stay."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            x = _rows(batch, length)
            for p, cut in enumerate(cuts(length, len(books))):
                index, _ = nearest(x[:, cut], books[p])
                counts[p] += np.bincount(index, minlength=len(books[p]))
                np.add.at(sums[p], index, x[:, cut])
        for p, n in enumerate(counts):
            used = np.flatnonzero(n)
            if len(used):
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(used), p, np.int32)), "entry": pa.array(used.astype(np.int32)), "n": pa.array(n[used]), "total": pa.array(sums[p][used].tolist(), pa.list_(pa.int64()))})

    sums = vectors.select("v").mapInArrow(add_up, "part int, entry int, n long, total array<long>")
    each = sums.select("part", "entry", "n", F.posexplode_outer("total").alias("place", "x"))
    new = [b.copy() for b in books]
    for r in each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # parts x entries x width rows
        if r["place"] is not None:
            new[r["part"]][r["entry"], r["place"]] = int(r["x"]) // r["n"]
    return new


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes array<int>, error long) of the vectors (vec_id, embedding, label) that are whole, and the codebooks of the parts."""
    kept = vectors.select("vec_id", "label", whole(vectors["embedding"], scale).alias("v")).where("v IS NOT NULL")
    kept = settle(kept, "vectors")
    kind = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, codes array<int>, error long"
    usual = kept.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], kind), [np.zeros((0, 0), np.int64)] * parts
    length = usual["length"]
    kept = kept.where(F.size("v") == length)
    first = [r["v"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    first = np.array(first, np.int64).reshape(len(first), length)
    books = [first[:, cut] for cut in cuts(length, parts)]
    for _ in range(rounds):
        books = refined(kept, books, length)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, length)
            found = [nearest(x[:, cut], book) for cut, book in zip(cuts(length, parts), books, strict=True)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.int32)
            codes = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, parts, dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(sum(d for _, d in found))], ["vec_id", "label", "codes", "error"])

    return kept.mapInArrow(assign, kind), books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the sum of the errors of all rows of the same label, null labels together."""
    keyed = coded.withColumns({"__label": F.coalesce(F.col("label").cast("string"), F.lit("")), "__none": F.col("label").isNull()})
    totals = settle(keyed.groupBy("__label", "__none").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n")), "label_errors")
    return join_unique(keyed, totals, ["__label", "__none"], "__n").drop("__label", "__none", "__n")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    out = with_label_error(settle(coded, "codes"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other; components are rows."""
    steps = [
        f"""k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c AS MATERIALIZED (SELECT r, i // (len(v) // {PARTS}) AS part, i % (len(v) // {PARTS}) AS place, v[i + 1] AS x FROM k, (SELECT unnest(range(1024)) AS i) WHERE i < len(v))",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, place, x FROM c WHERE r <= {ENTRIES})",
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"d{t} AS MATERIALIZED (SELECT c.r, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM c JOIN b{t} b USING (part, place) GROUP BY ALL)")
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, part, min(d) AS d, arg_min(entry, d * {ENTRIES} + entry) AS entry FROM d{t} GROUP BY ALL)")
        if t < ROUNDS:
            mean = "SELECT part, entry, place, floor(sum(x) / count(*))::BIGINT AS x FROM c JOIN a{0} USING (r, part) GROUP BY ALL".format(t)
            steps.append(f"b{t + 1} AS MATERIALIZED (SELECT part, entry, place, coalesce(m.x, b.x) AS x FROM b{t} b LEFT JOIN ({mean}) m USING (part, entry, place))")
    return f"""
WITH {', '.join(steps)}, s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{ROUNDS}
), e AS (SELECT r, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN k USING (r), s
"""


OP11_SQL = _sql()
