"""Operator 1, variable-capacity best-fit packing.

Documents are packed into training sequences of several permitted lengths. A document as long as the largest length or
longer gives full sequences of its own; what remains of it, and every shorter document, is an item. Items are packed in blocks of
about ``BLOCK_ROWS`` (dealt by a hash, so a hot source or a long document fills no block), each block in
decreasing order: an item goes to the open bin that it fits best; where none has room, a bin is opened. The permitted
lengths are optimised jointly: each block is packed once for every opening policy (the least-cost length for the item,
by cost a token, among the lengths up to a limit; or always the same length), every bin is finally downsized to the least length
that holds its contents, and the packing of least total cost stays.

The default cost of a sequence of length c is c + OVERHEAD + c * c / QUADRATIC: tokens, a fixed part for each sequence, attention.

Null or empty texts (or counts) have no tokens, take no room, and get no bin (null bin_id), but keep their row. Repeated rows are packed each.
The result is one row a piece; pieces of a document are numbered, and cover it without gap or overlap. Rows of
equal doc_id are told apart by nothing but their pieces. Bins depend on doc_id and counts only, not on how the input is split. Other columns are left alone.
``sequences`` puts the texts of the bins together.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, partitions, settle, table, word_count

LENGTHS, BLOCK_ROWS, OVERHEAD, QUADRATIC, COPIES = (256, 512, 1024, 2048, 4096), 20_000, 16, 16384, 10_000


def cost(length: int) -> float:
    return length + OVERHEAD + length * length / QUADRATIC


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, price: Callable[[int], float] = cost) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """For items in decreasing order: bin of each, offset in it, length of each bin, total cost. The cheapest of all opening policies."""
    best = None
    for opens in dict.fromkeys([*((x,) for x in lengths), *(lengths[: k + 1] for k in range(len(lengths)))]):
        found = _pack(sizes, opens, lengths, price)
        if best is None or found[3] < best[3]:
            best = found
    return best


def _pack(sizes: np.ndarray, opens: tuple[int, ...], lengths: tuple[int, ...], price: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    rooms: list[int] = []  # distinct free rooms of open bins, sorted
    bins_with: dict[int, list[int]] = {}  # bins by free room, as heaps
    used: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_price = sorted(lengths, key=lambda x: (price(x) / x, x))
    opened = {}
    for k, size in enumerate(sizes.tolist()):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            heap = bins_with[room]
            b = heapq.heappop(heap)
            if not heap:
                del bins_with[room], rooms[at]
        else:
            if size not in opened:
                fits = [x for x in by_price if x >= size and x in opens] or [x for x in sorted(lengths) if x >= size]
                opened[size] = fits[0]
            b, room = len(used), opened[size]
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += size
        if left := room - size:
            if left not in bins_with:
                bins_with[left] = []
                insort(rooms, left)
            heapq.heappush(bins_with[left], b)
    held = np.asarray(sorted(lengths))[np.searchsorted(sorted(lengths), used)] if used else np.zeros(0, np.int64)
    return bins, offsets, held, float(sum(price(int(x)) * int(n) for x, n in zip(*np.unique(held, return_counts=True), strict=True)))


def packed(sized: DataFrame, lengths: tuple[int, ...] = LENGTHS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """From rows of doc_id and n_tokens: doc_id, piece, piece_start, piece_tokens, bin_id, bin_offset, bin_length."""
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    # rows equal in doc_id and count are interchangeable: they are counted, dealt anew in runs of COPIES, and numbered
    same = sized.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("__n"))
    runs = same.withColumn("__from", F.explode(F.expr(f"sequence(0L, __n - 1L, {COPIES}L)")))
    nth = F.explode(F.expr(f"sequence(__from, least(__from + {COPIES}L, __n) - 1L)"))
    sized = settle(runs.select("doc_id", "n_tokens", nth.alias("__row")), "tokens")
    rows = sized.count()
    n_blocks = max(1, -(-rows // block_rows))
    full = F.expr(f"n_tokens div {top}")
    key = F.xxhash64("doc_id", "n_tokens", "__row")
    columns = ["doc_id", "piece", "piece_start", "piece_tokens", "bin_id", "bin_offset", "bin_length"]
    zero = F.lit(0).cast("long")
    whole = sized.where(full > 0).select("doc_id", "n_tokens", "__row", F.posexplode(F.sequence(zero, full - 1))).select(
        "doc_id", F.col("pos").cast("long").alias("piece"), (F.col("col") * top).alias("piece_start"), F.lit(top).cast("long").alias("piece_tokens"),
        F.concat_ws("-", F.lit("w"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("n_tokens"), F.col("__row"), F.col("col")).alias("bin_id"), zero.alias("bin_offset"), F.lit(top).cast("long").alias("bin_length"),
    )
    none = F.lit(None)
    empty = sized.where("n_tokens = 0").select("doc_id", zero.alias("piece"), zero.alias("piece_start"), zero.alias("piece_tokens"), none.cast("string").alias("bin_id"), none.cast("long").alias("bin_offset"), none.cast("long").alias("bin_length"))
    items = sized.where(F.col("n_tokens") % top > 0).select(
        key.alias("__h"), "doc_id", full.alias("piece"), (full * top).alias("piece_start"), (F.col("n_tokens") % top).alias("piece_tokens")
    ).withColumn("__b", F.pmod("__h", F.lit(n_blocks)))
    id_type = items.schema["doc_id"].dataType.simpleString()
    # a block lies in one task, whole and in a fixed order, so that a task run again gives the same bins
    items = items.repartition(partitions(sized, rows, 8 * block_rows), "__b").sortWithinPartitions("__b", F.desc("piece_tokens"), "__h", "doc_id")

    def close(block: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        bins, offsets, held, _ = pack(np.asarray(t.column("piece_tokens")), lengths)
        ids = pa.array([f"{block}-{b}" for b in bins.tolist()])
        return pa.RecordBatch.from_arrays([*(t.column(c) for c in columns[:4]), ids, pa.array(offsets), pa.array(held[bins].astype(np.int64))], columns)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = -1, []
        for batch in batches:
            at = np.asarray(batch.column("__b"))
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i < j:
                    if held and at[i] != block:
                        yield close(block, held)
                        held = []
                    block = int(at[i])
                    held.append(batch.slice(i, j - i))
        if held:
            yield close(block, held)

    inside = items.mapInArrow(part, f"doc_id {id_type}, piece long, piece_start long, piece_tokens long, bin_id string, bin_offset long, bin_length long")
    return whole.unionByName(inside).unionByName(empty)


def sequences(docs: DataFrame, pieces: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """bin_id, bin_length, n_tokens, doc_ids (of the pieces in order) and text (their words, with a space between) of each bin. pieces: packed() of the words of docs; of rows of one doc_id and as many words, one gives the text."""
    top = max(lengths)
    words = F.regexp_extract_all(F.coalesce(docs["text"], F.lit("")), F.lit(WORD), F.lit(0))
    held = docs.select(docs["doc_id"].alias("d"), words.alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    cut = F.transform(F.expr(f"sequence(0, (n - 1) div {top})"), lambda k: F.array_join(F.slice("w", (k * top + 1).cast("int"), F.lit(top)), " "))
    parts = held.select("d", "n", F.posexplode(cut).alias("p", "text"))
    size = F.least(F.lit(top), F.col("n") - F.col("p") * top)
    parts = parts.withColumn("size", size).dropDuplicates(["d", "p", "size"])
    joined = pieces.where("bin_id IS NOT NULL").join(parts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("piece") == F.col("p")) & (F.col("piece_tokens") == F.col("size")))
    joined = joined.groupBy("bin_id", "bin_length").agg(F.sum("piece_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", "text"))).alias("x"))  # one bin's pieces
    return joined.select("bin_id", "bin_length", "n_tokens", F.col("x.doc_id").alias("doc_ids"), F.array_join("x.text", " ").alias("text"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packed(docs.select("doc_id", word_count(docs["text"]).alias("n_tokens")))
