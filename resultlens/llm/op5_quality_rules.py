"""Operator 5, quality rules: line sequence labelling by a linear-chain conditional random field.

Each line with a word is described by levelled features (words, symbols, capitals, digits, bars, ending, repeats, place). A CRF of two labels,
content and boilerplate, gives emission and transition scores; Viterbi decoding finds each text's best labelling, and the share
of words in content lines decides: at least ``SHARE`` stays. Base counts (repeated windows, repeated lines, symbols) fail a text beforehand.

The CRF is fit on the lines of at most ``max_fit`` rated documents (those of lowest hash; a bounded sample), each text as chains of up to ``CHAIN`` lines. They give ``max_lines`` lines in all at most: where they have more, the
longest give their first lines, as many each as fit, so that one very long document displaces no other. Lines of
documents rated bad are boilerplate; so is a line of a good one that recurs all over the corpus: over all documents it stands in ``CONTEXTS`` contexts (lines before and after) or more, none of which makes up more than
``ONE_CONTEXT`` of its places (so copies of a text do not make its lines boilerplate). Other lines of good documents are content. So labels change within a text, and the scores of label pairs
are learnt from that. Every document is decoded, whole. Without ratings of both kinds every line is content; if only the bound leaves lines of one kind, a warning says so.

Null counts as no text: no words, so base_failed. Lines end at \\n; lines without a word are left out. Repeated rows come out repeated; other columns are left alone.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .textbytes import U, blocks, mix, owners, prefix_hash, runs, span_hash, words

SHARE, MAX_FIT, MAX_LINES, CHAIN, LEVELS = 0.5, 3000, 300_000, 200, 8
CONTEXTS, ONE_CONTEXT = 3, 0.4
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOL, CAPITAL, DIGIT, BAR, BANG, STOP = (np.zeros(256, bool) for _ in range(6))
SYMBOL[list(b"#*$%&|<>")] = True
CAPITAL[65:91] = True
DIGIT[48:58] = True
BAR[list(b"|")] = True
BANG[list(b"!")] = True
STOP[list(b".!?:;,\"')")] = True
FEATURES = 10


def lines(data: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of words of the lines with a word (words start at `starts`)."""
    begin, end = runs(data != 10, at)
    count = np.searchsorted(starts, end) - np.searchsorted(starts, begin)
    return begin[count > 0], end[count > 0], count[count > 0]


def line_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and context (hash of the lines before and after, in the text) of the lines with a word, and each text's first line (n + 1)."""
    begin, end, _ = lines(data, at, words(data, at)[0])
    h = span_hash(prefix_hash(data), begin, end)
    first = np.searchsorted(begin, at)
    before, after = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    text = owners(begin, at)
    inside = text[1:] == text[:-1]
    before[1:][inside], after[:-1][inside] = h[:-1][inside], h[1:][inside]
    return h, mix(before + U(1)) + U(3) * mix(after + U(2)), first


def base(data: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts by text; starts of the lines with a word, their words, and the level of each feature by line. Lines and windows are compared by hash, lines that agree in it by their bytes."""
    n = len(at) - 1
    starts, ends, first = words(data, at)
    prefix = prefix_hash(data)
    h = span_hash(prefix, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))

    def total(mask: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])

    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    chars = total((np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((data & 0xC0) != 0x80))
    symbols = total(SYMBOL[data])
    # windows found twice or more in a text
    m = max(0, len(h) - WINDOW + 1)
    repeated = np.zeros(len(h), bool)
    if m:
        whole = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
        key = mix(mix(mix(h[whole]) + h[whole + 1]) + h[whole + 2]) ^ mix(owner[whole].astype(np.uint64) + U(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for k in range(WINDOW):
            repeated[whole[twice] + k] = True
    # lines
    begin, end, count = lines(data, at, starts)
    text = owners(begin, at)
    key = span_hash(prefix, begin, end) ^ mix(text.astype(np.uint64) + U(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    earlier = np.zeros(len(key), bool)
    for x, y in zip(order[:-1][same].tolist(), order[1:][same].tolist(), strict=True):
        earlier[y] = data[begin[x] : end[x]].tobytes() == data[begin[y] : end[y]].tobytes()
    counts = {
        "n_words": np.diff(first),
        "word_chars": chars[at[1:]] - chars[at[:-1]],
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": np.bincount(text[earlier], minlength=n),
        "n_repeat_words": np.bincount(owner[repeated], minlength=n),
    }
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    again, rep, size = total(again), total(repeated), (end - begin).astype(float)
    w0 = np.searchsorted(starts, begin)
    level = lambda x, scale: np.minimum(LEVELS - 1, np.asarray(x) * scale).astype(np.int64)
    part = lambda mask: (lambda c: (c[end] - c[begin]) / size)(total(mask))
    columns = [
        level(np.log2(count + 1.0), 1),
        level(np.sqrt(part(SYMBOL[data])), LEVELS * 1.5),
        level(np.sqrt(part(CAPITAL[data])), LEVELS),
        level(np.sqrt(part(DIGIT[data])), LEVELS * 1.5),
        level(np.sqrt(part(BAR[data])), LEVELS * 2),
        level(np.sqrt(part(BANG[data])), LEVELS * 2),
        level((again[w0 + count] - again[w0]) / count, LEVELS),
        level((rep[w0 + count] - rep[w0]) / count, LEVELS - 0.001),
        earlier * 1 + STOP[data[end - 1]] * 2,
        level(np.log2(size / count), 1.5),
    ]
    return counts, begin, count, np.stack(columns, 1) + np.arange(FEATURES) * LEVELS


def fit(chains: list[np.ndarray], labels: list[np.ndarray], rounds: int = 60, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights of content over boilerplate, and scores of label pairs, by Adam on the CRF's likelihood (forward-backward over all chains at once)."""
    order = np.argsort([-len(x) for x in chains], kind="stable")
    chains, labels = [chains[k] for k in order], [labels[k] for k in order]
    size = np.array([len(x) for x in chains])
    n, longest = len(chains), int(size.max())
    index = np.zeros((n, longest, FEATURES), np.int16)
    good = np.zeros((n, longest), np.int8)
    mask = np.arange(longest) < size[:, None]
    index[mask], good[mask] = np.concatenate(chains), np.concatenate(labels)
    p, m, v = np.zeros(FEATURES * LEVELS + 4), 0.0, 0.0
    mean = np.array([x.mean() for x in labels])
    share = max(0.01, min(0.99, mean.mean()))
    balance = (mean * 0.5 / share + (1 - mean) * 0.5 / (1 - share)) / size  # both labels weigh alike, and each chain
    true = np.zeros((2, 2))
    for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
        true[x, y] = (((good[:, :-1] == x) & (good[:, 1:] == y) & mask[:, 1:]).sum(1) * balance).sum()
    for t in range(1, rounds + 1):
        emit = np.zeros((n, longest, 2))
        emit[..., 1] = p[: FEATURES * LEVELS][index].sum(-1)
        pair = p[-4:].reshape(2, 2)
        fore, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fore[:, 0] = emit[:, 0]
        for k in range(1, longest):
            live = size > k
            fore[live, k] = np.logaddexp(fore[live, k - 1, :1] + pair[0], fore[live, k - 1, 1:] + pair[1]) + emit[live, k]
        norm = np.logaddexp(*fore[np.arange(n), size - 1].T)
        seen = np.zeros((2, 2))
        for k in range(longest - 2, -1, -1):
            live = size > k + 1
            ahead = emit[live, k + 1] + back[live, k + 1]
            back[live, k] = np.logaddexp(pair[:, 0] + ahead[:, :1], pair[:, 1] + ahead[:, 1:])
            both = np.exp(fore[live, k][:, :, None] + pair + ahead[:, None, :] - norm[live, None, None])
            seen += (both * balance[live, None, None]).sum(0)
        likely = np.exp(fore[..., 1] + back[..., 1] - norm[:, None])
        miss = np.where(mask, (good - likely) * balance[:, None], 0)
        g = np.zeros_like(p)
        g[:-4] = -np.bincount(index.ravel(), np.repeat(miss.ravel(), FEATURES), FEATURES * LEVELS) / n
        g[-4:] = (seen - true).ravel() / n
        g += decay * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return p[:-4], p[-4:].reshape(2, 2)


def viterbi(emit: np.ndarray, first: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Best labels (1: content) of the lines of all texts; emit: score of content over boilerplate by line; first: each text's first line (n + 1)."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    live_at = np.searchsorted(-size[order], -np.arange(1, (size.max() if len(size) else 0) + 1), "right")
    came = np.zeros((len(emit), 2), np.int8)
    score = np.zeros((len(size), 2))
    for k, live in enumerate(live_at):
        rows = order[:live]
        line = first[rows] + k
        if k:
            step = score[rows][:, :, None] + pair
            came[line] = step.argmax(1)
            score[rows] = step.max(1)
        score[rows, 1] += emit[line]
    label = np.zeros(len(emit), np.int8)
    now = score.argmax(1).astype(np.int8)
    for k in range(len(live_at) - 1, -1, -1):
        rows = order[: live_at[k]]
        line = first[rows] + k
        label[line] = now[rows]
        now[rows] = came[line, now[rows]]
    return label


def recurring(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """Of the known line hashes (sorted), those that recur all over the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, at in blocks(b.column("text")):
                h, context, _ = line_hashes(data, at)
                k = np.minimum(np.searchsorted(shared.value, h), len(shared.value) - 1)
                ok = shared.value[k] == h
                yield pa.RecordBatch.from_arrays([pa.array(k[ok]), pa.array(context[ok].view(np.int64))], ["k", "context"])

    if not len(known):
        return known
    places = docs.select("text").mapInArrow(part, "k long, context long").groupBy("k", "context").agg(F.count(F.lit(1)).alias("n"))
    found = places.groupBy("k").agg(F.count(F.lit(1)).alias("contexts"), F.max("n").alias("most"), F.sum("n").alias("all"))
    found = found.where((F.col("contexts") >= CONTEXTS) & (F.col("most") <= ONE_CONTEXT * F.col("all"))).select("k").toArrow()  # at most the known lines
    return np.sort(known[np.asarray(found["k"].combine_chunks())]) if found.num_rows else known[:0]


def level_cut(sizes: list[int], most: int) -> int:
    """The largest number of lines that each document may give without their sum passing the bound; 0 if not even one each fits."""
    cut, left = 0, most
    for k, n in enumerate(sorted(sizes)):
        rest = len(sizes) - k
        if (n - cut) * rest > left:
            return cut + left // rest
        left -= (n - cut) * rest
        cut = n
    return max(cut, 1)


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, max_lines: int = MAX_LINES) -> tuple[np.ndarray, np.ndarray] | None:
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).cast("long").alias("__good"))
    rated = rated.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)  # max_fit rows bound the broadcast

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in blocks(b.column("text")):
                _, begin, _, level = base(data, at)
                h, _, first = line_hashes(data, at)
                lists = pa.ListArray.from_arrays(pa.array(first * FEATURES, pa.int32()), pa.array(level.ravel().astype(np.int16)))
                hashes = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("__good").slice(i, j - i), hashes, lists], ["doc_id", "good", "hashes", "level"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").mapInArrow(part, f"doc_id {kind}, good long, hashes array<long>, level array<short>")
    one = rows.where("size(hashes) > 0").groupBy("doc_id", "good").agg(F.min(F.struct("hashes", "level")).alias("x"))  # one text of a doc_id; max_fit rows at most
    one = settle(one.select("doc_id", "good", "x.*"), "lines")
    sizes = [r["n"] for r in one.select(F.size("hashes").alias("n")).collect()]  # max_fit numbers at most
    most = level_cut(sizes, max_lines)
    firsts = one if most else one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_lines)
    firsts = firsts.select("doc_id", "good", F.slice("hashes", 1, max(1, most)).alias("hashes"), F.slice("level", 1, max(1, most) * FEATURES).alias("level"))
    rows = firsts.toArrow().to_pandas().sort_values("doc_id")
    if rows["good"].nunique() < 2:
        if one.select("good").distinct().count() > 1:
            warnings.warn(f"max_lines={max_lines} leaves lines of one kind of rated documents only, so there is no model and all lines count as content", stacklevel=2)
        return None
    hashes = [np.asarray(x, np.int64).view(np.uint64) for x in rows["hashes"]]
    levels = [np.asarray(x, np.int16).reshape(-1, FEATURES) for x in rows["level"]]
    everywhere = recurring(docs, np.unique(np.concatenate([h for h, g in zip(hashes, rows["good"], strict=True) if g])))
    content = [np.full(len(h), g, np.int8) & ~np.isin(h, everywhere) for h, g in zip(hashes, rows["good"], strict=True)]
    cut = lambda x: [x[k : k + CHAIN] for k in range(0, len(x), CHAIN)]
    return fit([c for x in levels for c in cut(x)], [c for x in content for c in cut(x)])


def label(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, share: float = SHARE) -> DataFrame:
    """doc_id, base counts, base_failed, kept, content_share."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for i, j, data, at in blocks(b.column("text")):
                counts, begin, size, level = base(data, at)
                good = np.ones(len(begin), np.int8) if known is None else viterbi(known[0][level].sum(1), np.searchsorted(begin, at), known[1])
                n = counts["n_words"]
                content = np.bincount(owners(begin, at), size * good, j - i) / np.maximum(n, 1)
                failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * n)
                out = [*(pa.array(counts[c].astype(np.int64)) for c in names), pa.array(failed), pa.array(~failed & (content >= share)), pa.array(np.round(content, 4))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *out], ["doc_id", *names, "base_failed", "kept", "content_share"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in names)}, base_failed boolean, kept boolean, content_share double"
    return docs.select("doc_id", "text").mapInArrow(part, schema)


def content(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id and content: the text's content lines, in order, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in blocks(b.column("text")):
                _, begin, _, level = base(data, at)
                _, end, _ = lines(data, at, words(data, at)[0])
                first = np.searchsorted(begin, at)
                good = np.ones(len(begin), bool) if shared.value is None else viterbi(shared.value[0][level].sum(1), first, shared.value[1]) == 1
                texts = [b"\n".join(data[begin[k] : end[k]].tobytes() for k in range(p, q) if good[k]).decode() for p, q in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(texts, pa.string())], ["doc_id", "content"])

    return docs.select("doc_id", "text").mapInArrow(part, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content string")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return label(docs, train(docs, table(spark, sf_dir, "labels")))
