"""Operator 10, quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words is shared by all grades; ordered thresholds cut its score:
P(grade > k) = sigmoid(score - threshold_k). From that come the expected grade and the tail probability by which
documents are selected.

Grades: 0 rated toxic, 1 rated of low quality, 2 rated good. The fit takes at most ``max_fit`` rated documents that are there, with at most ``max_features`` features in all (those of
lowest hash; a bounded sample, so its features fit the driver at any input size); of rows that share a doc_id it takes one. All documents are scored, whole.
Null text counts as empty. An empty text has only the style features. Ratings that are null are left out; where a document is
rated more than once, its lowest rating counts. Without ratings, or with one grade only, every document is kept with
the highest grade. Repeated rows are scored one by one; other columns are passed by (``score``) or kept (``select_good``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table
from .textbytes import TO_LOWER, blocks, mix, owners, prefix_hash, runs, span_hash

BITS, LEVELS, GRADES, MAX_FIT, MAX_FEATURES, TAIL = 18, 10, 3, 6000, 20_000_000, 0.5
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_classes = {"upper": range(65, 91), "digit": range(48, 58), "bang": b"!?", "bar": b"|", "symbol": b"#*$%&<>@^~\\", "line": b"\n", "stop": b".,;:"}
CLASS = np.zeros((len(_classes), 256), bool)
for _k, _v in enumerate(_classes.values()):
    CLASS[_k, list(_v)] = True
STYLES = len(_classes) + 3
SIZE = (1 << BITS) + STYLES * LEVELS


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the words present and of the style levels, by text."""
    n = len(at) - 1
    starts, ends = runs(LETTER[data], at)
    h = span_hash(prefix_hash(TO_LOWER[data]), starts, ends)
    owner = owners(starts, at)
    count = np.bincount(owner, minlength=n)
    key = np.unique((owner.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    text, feature = key >> BITS, key & ((1 << BITS) - 1)
    size = np.maximum(np.diff(at), 1)
    style = []
    for k in range(len(CLASS)):
        total = np.concatenate([[0], np.cumsum(CLASS[k][data], dtype=np.int64)])
        style.append(np.minimum(LEVELS - 1, np.sqrt((total[at[1:]] - total[at[:-1]]) / size) * LEVELS * 1.5))
    style.append(np.minimum(LEVELS - 1, np.log2(count + 1.0) * 0.6))
    style.append(LEVELS * 0.999 * np.bincount(text, minlength=n) / np.maximum(count, 1))
    style.append(np.minimum(LEVELS - 1, np.bincount(owner, ends - starts, n) / np.maximum(count, 1)))
    level = np.stack(style, 1).astype(np.int64) + np.arange(STYLES) * LEVELS + (1 << BITS)
    text = np.concatenate([text, np.repeat(np.arange(n), STYLES)])
    return text, np.concatenate([feature, level.ravel()])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def thresholds(p: np.ndarray) -> np.ndarray:
    """From the first threshold and the logarithms of the steps between them."""
    return p[0] + np.concatenate([[0], np.cumsum(np.exp(p[1:]))])


def loss(p: np.ndarray, text: np.ndarray, column: np.ndarray, grade: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the cumulative-link model with a normal prior on the weights, and its gradient. p: weights, then what thresholds() takes."""
    n, levels = len(grade), GRADES - 1
    used = len(p) - levels
    score = np.bincount(text, p[:used][column], n)
    above = np.concatenate([np.ones((n, 1)), sigmoid(score[:, None] - thresholds(p[used:])), np.zeros((n, 1))], 1)
    slope = above * (1 - above)
    row = np.arange(n)
    likely = np.maximum(above[row, grade] - above[row, grade + 1], 1e-9)
    d_low, d_high = slope[row, grade] / likely, slope[row, grade + 1] / likely
    g = np.empty_like(p)
    g[:used] = -np.bincount(column, (d_low - d_high)[text], used) / n + decay * p[:used]
    d_cut = np.array([(d_low[grade == k + 1]).sum() - (d_high[grade == k]).sum() for k in range(levels)]) / n
    g[used] = d_cut.sum()
    for k in range(1, levels):
        g[used + k] = d_cut[k:].sum() * np.exp(p[used + k])
    return float(-np.log(likely).mean() + 0.5 * decay * (p[:used] ** 2).sum()), g


def fit(text: np.ndarray, feature: np.ndarray, grade: np.ndarray, rounds: int = 150, rate: float = 0.1, prior: float = 3.0, least: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the likelihood of the cumulative-link model; features of fewer than `least` texts (one in a hundred, where texts are few) get no weight."""
    common = np.bincount(feature, minlength=SIZE) >= min(least, 1 + len(grade) // 100)
    text, feature = text[common[feature]], feature[common[feature]]
    used, column = np.unique(feature, return_inverse=True)
    share = np.array([(grade > k).mean() for k in range(GRADES - 1)]).clip(0.01, 0.99)
    cut = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(used)), cut[:1], np.log(np.maximum(np.diff(cut), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        g = loss(p, text, column, grade, prior / len(grade))[1]  # a prior of one strength whatever the sample
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(SIZE, np.float32)
    weights[used] = p[: len(used)]
    return weights, thresholds(p[len(used) :])


def predict(text: np.ndarray, feature: np.ndarray, n: int, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade > k) by text, for k below the highest grade."""
    return sigmoid(np.bincount(text, weights[feature], n)[:, None] - cuts)


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on at most max_fit rated documents and max_features of their features; None if there are no two grades."""
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)).cast("long").alias("__grade")
    )
    rated = rated.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)  # max_fit rows bound the broadcast

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in blocks(b.column("text")):
                text, feature = features(data, at)
                order = np.argsort(text, kind="stable")
                cut = np.searchsorted(text[order], np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("__grade").slice(i, j - i), lists], ["doc_id", "grade", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").mapInArrow(part, f"doc_id {kind}, grade long, feature array<int>")
    rows = rows.groupBy("doc_id", "grade").agg(F.min("feature").alias("feature"))  # one text of a doc_id; max_fit rows at most
    rows = settle(rows.where("size(feature) > 0"), "features")
    upto = F.sum(F.size("feature")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over max_fit rows at most
    fits = rows.select("doc_id", upto.alias("upto")).where(F.col("upto") <= max_features)
    rows = rows.join(F.broadcast(fits.select("doc_id")), "doc_id", "left_semi").select("grade", "feature").toArrow()
    grade = np.asarray(rows["grade"].combine_chunks()) if rows.num_rows else np.zeros(0, np.int64)
    if len(np.unique(grade)) < 2:
        return None
    lists = rows["feature"].combine_chunks()
    size = np.asarray(lists.value_lengths())
    feature = np.asarray(lists.flatten()).astype(np.int64)
    order = np.lexsort((mix(np.add.reduceat(mix(feature.astype(np.uint64)), np.concatenate([[0], np.cumsum(size)[:-1]]))), grade))  # as rows come in any order
    starts = np.concatenate([[0], np.cumsum(size)])
    feature = np.concatenate([feature[starts[k] : starts[k + 1]] for k in order])
    return fit(np.repeat(np.arange(len(grade)), size[order]), feature, grade[order])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, tail: float = TAIL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, then expected_grade, p_low and p_tail (probabilities of the lowest and the highest grade) and kept."""
    named = [(f"__{k}", c) for k, c in enumerate(keep)]
    held = docs.select(*[docs[c].alias(a) for a, c in named], docs["text"].alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            parts = [np.ones((0, GRADES - 1))]
            for i, j, data, at in blocks(b.column("__text")):
                parts.append(np.ones((j - i, GRADES - 1)) if known is None else predict(*features(data, at), j - i, *known))
            p = np.concatenate(parts)
            out = [p.sum(1), 1 - p[:, 0], p[:, -1], p[:, -1] >= tail]
            yield pa.RecordBatch.from_arrays([*(b.column(a) for a, _ in named), *map(pa.array, out)], [*(a for a, _ in named), *"wxyz"])

    schema = ", ".join([*(f"{a} {docs.schema[c].dataType.simpleString()}" for a, c in named), "w double, x double, y double, z boolean"])
    return held.mapInArrow(part, schema).toDF(*keep, "expected_grade", "p_low", "p_tail", "kept")


def select_good(docs: DataFrame, labels: DataFrame, tail: float = TAIL, max_fit: int = MAX_FIT) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    scored = score(docs, train(docs, labels, max_fit), tail, tuple(docs.columns))
    return scored.where("kept").select(*docs.columns)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", F.round("expected_grade", 4).alias("expected_grade"), F.round("p_tail", 4).alias("p_tail"), "kept"
    )
