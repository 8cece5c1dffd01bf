"""Operator 4, n-gram Jaccard join by signature trees.

A document's set: distinct shingles of k words (words between ASCII white space, A-Z lower-cased; of fewer words, the whole sequence
as one). Two documents link when |intersection| >= threshold * |union| (thresholds of a half at least). Steps:

1. Frequent tokens. Every text's tokens are counted (windows of ``WINDOW`` tokens drop what is rare in them); at most ``FREQUENT`` tokens count as frequent. They only order the tokens of a set,
   rare ones first, so whatever the counts miss changes no result.
2. Each text becomes its set size, a hash of its set, its token bitmap and a sketch. Sets of up to ``whole`` tokens have an exact one: the prefix filter's first size - ceil(threshold * size) + 1 tokens in this order, of which
   two linked sets surely share one; texts that only share a frequent passage do not. Larger sets have the ``SKETCH`` least hashes of their rare tokens and, where frequent ones make up
   enough of the set, of those: two linked sets share none with a chance under ``CHANCE``. Sets near the border have both. ``whole=EXACT`` gives every set the exact sketch.
3. Equal sets become one class, represented by its smallest doc_id. Classes meet in the groups of their sketch tokens. In each group a signature tree (nodes hold OR-combined bitmaps and size ranges) is
   traversed against itself, depth first; pairs of nodes whose largest possible overlap is too small, or that are connected already, are pruned. Candidates come out as spanning forests, never as all pairs.
4. Candidate components get the texts of their classes once; there a signature tree with exact bitmaps (local token numbers) gives the true links.

A group (of a token, or a component) too large for one task is dealt in blocks, each with the group's ``PIVOTS`` (some of its members). After that, only rows that are not in the group's largest component meet all blocks.

Component ids are the smallest doc_id reachable. Null texts and texts without words have size 0 and link with nothing. Rows that share doc_id count as one
document, linked by any of their texts; a null doc_id has a null component and links nothing. Repeated rows come out repeated. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, perhaps_among, settle, table
from .graph import components
from .signature_tree import bitmap_width, forest, reach
from .textbytes import TO_LOWER, U, blocks, mix, prefix_hash, shingles, span_hash, words

WHOLE, EXACT, SKETCH, CHANCE = 512, 1 << 40, 32, 1e-12
WINDOW, WINDOW_LEAST, FREQUENT_LEAST, FREQUENT = 4_000_000, 4, 200, 1 << 20
BLOCK_ROWS, BLOCK_TOKENS, PIVOTS, DENSE = 4096, 1_000_000, 64, 1 << 27
RARE_KEY, FREQUENT_KEY = U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25)


def token_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin (n + 1)."""
    data = TO_LOWER[data]
    starts, ends, first = words(data, at)
    h, owner = shingles(span_hash(prefix_hash(data), starts, ends), first, k)
    order = np.argsort(h)
    order = order[np.argsort(owner[order], kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(at)))


def sums(x: np.ndarray, at: np.ndarray, f: np.ufunc = np.add) -> np.ndarray:
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.diff(at) > 0
    if len(x):
        out[full] = f.reduceat(x, at[:-1][full])
    return out


def bitmaps(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of all sets behind one another as bytes, and where each begins."""
    width = bitmap_width(np.diff(at))
    base = np.concatenate([[0], np.cumsum(width)])
    flat = np.zeros(base[-1], bool)
    owner = np.repeat(np.arange(len(width)), np.diff(at))
    flat[base[owner] + (h & (width[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(flat, bitorder="little"), base // 8


def frequent_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of the tokens found most often, sorted; at most FREQUENT, as each has more than 1 / FREQUENT of all that are counted."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in _ended(batches):
            for _, _, data, at in blocks(b.column("text")) if b is not None else ():
                held.append(token_sets(data, at, k)[0])
            if held and (b is None or sum(map(len, held)) > WINDOW):
                token, n = np.unique(np.concatenate(held), return_counts=True)
                held = []
                yield pa.RecordBatch.from_arrays([pa.array(token[n >= WINDOW_LEAST].view(np.int64)), pa.array(n[n >= WINDOW_LEAST])], ["token", "n"])

    counts = settle(docs.select("text").mapInArrow(part, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "frequent")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.where(F.col("n") > max(FREQUENT_LEAST, total // FREQUENT)).select("token").toArrow()
    return np.sort(np.asarray(found["token"].combine_chunks()).view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def rare_share(num: int, den: int) -> tuple[float, float]:
    """(share of either kind of tokens that two sketches need to have in common to meet, share of frequent tokens in a set from which on they may have to meet by those)."""
    need = 1 - CHANCE ** (1 / SKETCH)
    return need, max(0.0, (num / den - need) / (1 - need))


def sketches(h: np.ndarray, first: np.ndarray, frequent: np.ndarray, num: int, den: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketch tokens of all sets, and where each set's begin (n + 1). Tokens of different kinds of sketch never meet."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    often = np.zeros(len(h), bool)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
    h = h[np.argsort(owner * 2 + often, kind="stable")]
    n_often = np.bincount(owner[often], minlength=len(n)) if len(h) else np.zeros(len(n), np.int64)
    rare, large = n - n_often, n * den > whole * num
    share = rare_share(num, den)[1]
    kinds = (
        (np.zeros(len(n), np.int64), np.where((n > 0) & (n <= whole), n - (num * n + den - 1) // den + 1, 0), U(0)),
        (np.zeros(len(n), np.int64), np.where(large, np.minimum(rare, SKETCH), 0), RARE_KEY),
        (rare, np.where(large & (n_often >= share * n), np.minimum(n_often, SKETCH), 0), FREQUENT_KEY),
    )
    token, of = [], []
    for offset, take, key in kinds:
        cut = np.concatenate([[0], np.cumsum(take)])
        pick = np.repeat(first[:-1] + offset - cut[:-1], take) + np.arange(cut[-1])
        token.append(mix(h[pick] + key) if key else h[pick])
        of.append(np.repeat(np.arange(len(n)), take))
    of, token = np.concatenate(of), np.concatenate(token)
    order = np.argsort(of, kind="stable")
    return token[order], np.searchsorted(of[order], np.arange(len(n) + 1))


def signatures(docs: DataFrame, k: int, num: int, den: int, whole: int = WHOLE) -> DataFrame:
    """doc_id, n, c1, c2 (hash of the set), near (orders like sets together), sketch, bits."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, k))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in blocks(b.column("text")):
                h, first = token_sets(data, at, k)
                sketch, cut = sketches(h, first, shared.value, num, den, whole)
                bits, base = bitmaps(h, first)
                near = sums(mix(h ^ U(0x5851F42D4C957F2D)), first, np.minimum)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(i, j - i),
                        pa.array(np.diff(first)),
                        *(pa.array(x.view(np.int64)) for x in (sums(mix(h), first), sums(mix(h * U(0xD1342543DE82EF95)), first), near)),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(sketch.view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(bits)]),
                    ],
                    ["doc_id", "n", "c1", "c2", "near", "sketch", "bits"],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(part, "doc_id long, n long, c1 long, c2 long, near long, sketch array<long>, bits binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream sorted by the keys (long, not null), several small groups at a time, with the groups' borders."""
    held: list[pa.RecordBatch] = []
    for batch in _ended(batches):
        if batch is not None:
            held.append(batch)
        if not held or (batch is not None and sum(x.num_rows for x in held) < least):
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([np.asarray(t.column(k).combine_chunks()) for k in keys], 1)
        border = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        end = t.num_rows if batch is None else int(border[-1]) if len(border) else 0
        held = t.slice(end).to_batches() if end < t.num_rows else []
        if end:
            yield t.slice(0, end).combine_chunks(), np.concatenate([[0], border[border < end], [end]]).astype(np.int64)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


#: Columns of the rows of a group's block, before what `attach` adds.
BLOCK = ["key", "i", "j", "doc", "label", "member"]
Find = Callable[[DataFrame, bool], DataFrame]


def _edges(rows: DataFrame, attach: Callable[[DataFrame], DataFrame], find: Find) -> DataFrame:
    """Edges a, b that connect what may link among settled rows of equal `key`: key, doc, n (tokens), rows and tokens (of the whole group).

    attach adds what find needs; find(rows, within) compares the members of a block (key, i, j) with each other, if `within`, and with its other rows."""
    n_blocks = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("tokens") / BLOCK_TOKENS)).cast("long")
    rows = rows.withColumn("blocks", n_blocks)
    own = F.pmod(F.xxhash64("doc"), F.col("blocks"))
    every = F.explode(F.expr("sequence(0L, blocks - 1L)"))
    zero = F.lit(0).cast("long")
    members = rows.withColumns({"i": own, "j": zero, "label": F.col("doc"), "member": F.lit(True)})
    pivots = rows.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("doc", F.lit(7)), F.col("rows")) < PIVOTS)).withColumn("i", every).where(F.col("i") != own)
    pivots = pivots.withColumns({"j": zero, "label": F.col("doc"), "member": F.lit(False)})
    edges = settle(find(attach(members.select(*BLOCK).unionByName(pivots.select(*BLOCK))), True), "edges")
    dealt = rows.where("blocks > 1")
    if dealt.isEmpty():
        return edges
    root = components(edges).select(F.col("node").alias("doc"), "root")
    dealt = settle(dealt.join(root, "doc", "left").withColumn("label", F.coalesce("root", "doc")).drop("root"), "labelled")
    sizes = dealt.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max_by("label", "size").alias("top"), F.sum("size").alias("all"), F.max("size").alias("most"))
    sizes = settle(sizes.withColumn("across", F.ceil((F.col("all") - F.col("most")) / BLOCK_ROWS).cast("long")).where("across > 0").drop("most"), "sizes")
    left = settle(join_unique(dealt, sizes, ["key"], "all"), "left")
    if left.isEmpty():
        return edges
    few = left.where("label != top").withColumns({"i": F.pmod(F.xxhash64("doc", F.lit(1)), F.col("across")), "j": every, "member": F.lit(True)})
    others = left.withColumns({"j": own, "member": F.lit(False)}).withColumn("i", F.explode(F.expr("sequence(0L, across - 1L)")))
    more = find(attach(few.select(*BLOCK).unionByName(others.select(*BLOCK))), False)
    return edges.unionByName(settle(more, "edges"))


def _in_blocks(rows: DataFrame, columns: list[str], part: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc")
    return dealt.select(*BLOCK, *columns).mapInArrow(part, "a long, b long")


def _candidates(reps: DataFrame, num: int, den: int) -> DataFrame:
    """Edges a, b of spanning forests of the classes that may link."""
    tokens = reps.where("n > 0").select(F.explode("sketch").alias("key"), F.col("doc_id").alias("doc"), "n")
    stats = settle(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")).where("rows > 1"), "tokens")
    meet = settle(join_unique(tokens, stats, ["key"], "rows"), "meetings")

    def find(rows: DataFrame, within: bool) -> DataFrame:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int]] = set()
            for t, border in grouped(batches, ["key", "i", "j"]):
                doc, label, member, n, near = (np.asarray(t.column(c).combine_chunks()) for c in ("doc", "label", "member", "n", "near"))
                bits = t.column("bits").combine_chunks()
                at = np.frombuffer(bits.buffers()[1], np.int32, len(bits) + 1 + bits.offset)[bits.offset :]
                flat = np.frombuffer(bits.buffers()[2], np.uint8)
                a, b = [], []
                for x, y in zip(border, border[1:], strict=False):
                    if y - x < 2 or y - x == 2 and (den * min(n[x], n[x + 1]) < num * max(n[x], n[x + 1]) or (doc[x], doc[x + 1]) in seen):
                        continue
                    maps = [flat[at[r] : at[r + 1]].view(np.uint64) if at[r] % 8 == 0 else np.frombuffer(flat[at[r] : at[r + 1]].tobytes(), np.uint64) for r in range(x, y)]
                    for p, q in forest(maps, n[x:y], near[x:y], num, den, None, label[x:y], member[x:y], within):
                        edge = (int(doc[x + p]), int(doc[x + q]))
                        if edge not in seen:
                            if len(seen) < 1_000_000:  # only spares repeats
                                seen.add(edge)
                            a.append(edge[0])
                            b.append(edge[1])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return _in_blocks(rows, ["n", "near", "bits"], part)

    return _edges(meet, lambda rows: rows.join(reps.select(F.col("doc_id").alias("doc"), "n", "near", "bits"), "doc"), find)


def links_within(sets: list[np.ndarray], num: int, den: int, label: np.ndarray | None = None, member: np.ndarray | None = None, within: bool = True) -> list[tuple[int, int]]:
    """Spanning forest of the true links among sorted sets of hashes (label, member, within: see forest)."""
    n = np.array([len(s) for s in sets])
    near = np.array([s[0] for s in sets])
    found = partial(forest, size=n, order=near, num=num, den=den, label=label, member=member, within=within)
    vocabulary, number = np.unique(np.concatenate(sets), return_inverse=True)
    width = -(-len(vocabulary) // 64) * 8  # bytes
    if width * len(sets) * 8 <= DENSE:
        flat = np.zeros((len(sets), width * 8), bool)
        flat[np.repeat(np.arange(len(sets)), n), number] = True
        return found(list(np.packbits(flat, axis=1, bitorder="little").view(np.uint64)))
    h, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)])
    bits, base = bitmaps(h, at)
    maps = [np.frombuffer(bits[base[k] : base[k + 1]].tobytes(), np.uint64) for k in range(len(sets))]

    def check(p: int, q: int) -> bool:
        both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        return bool(reach(np.int64(both), n[p] + n[q], num, den))

    return found(maps, check=check)


def _verified(docs: DataFrame, reps: DataFrame, found: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges a, b that connect the classes that truly link."""
    rows = found.select(F.col("node").alias("doc"), F.col("root").alias("key")).join(reps.select(F.col("doc_id").alias("doc"), "n", "c1"), "doc")
    rows = settle(rows, "candidates")
    stats = settle(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")), "groups")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc"), docs["text"])
    wanted = rows.select("doc").distinct()
    texts = perhaps_among(texts, "doc", wanted, wanted.count())

    def find(rows: DataFrame, within: bool) -> DataFrame:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, border in grouped(batches, ["key", "i", "j"], 512):
                doc, label, member, c1 = (np.asarray(t.column(c).combine_chunks()) for c in ("doc", "label", "member", "c1"))
                sets: list[np.ndarray] = []
                for _, _, data, at in blocks(t.column("text").combine_chunks()):
                    h, first = token_sets(data, at, k)
                    fits = sums(mix(h), first).view(np.int64)
                    sets += [h[p:q] if c == c1[len(sets) + r] else h[:0] for r, (p, q, c) in enumerate(zip(first, first[1:], fits, strict=False))]
                a, b = [], []
                for x, y in zip(border, border[1:], strict=False):
                    own = [r for r in range(x, y) if len(sets[r])]  # where rows share doc_id, each class meets its own text only
                    if len(own) > 1:
                        for p, q in links_within([sets[r] for r in own], num, den, label[own], member[own], within):
                            a.append(int(doc[own[p]]))
                            b.append(int(doc[own[q]]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return _in_blocks(rows, ["c1", "text"], part)

    classes = rows.select("key", "doc", "c1")

    def attach(part: DataFrame) -> DataFrame:
        return part.join(classes.select("doc", "c1"), "doc").join(texts, "doc")

    return _edges(join_unique(rows.select("key", "doc", "n").distinct(), stats, ["key"], "rows"), attach, find)


def join_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, whole: int = WHOLE) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; k words a shingle, links from num / den on."""
    if 2 * num < den:
        raise ValueError("thresholds of a half at least")
    all_rows = settle(signatures(docs, k, num, den, whole), "signatures")
    sized = all_rows.where("doc_id IS NOT NULL AND n > 0")
    classes = settle(sized.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    ranked = settle(join_unique(sized.select("doc_id", "n", "c1", "c2"), classes, ["c1", "c2"], "copies"), "ranked")
    first = sized.join(classes.select(F.col("rep").alias("doc_id"), "c1", "c2"), ["doc_id", "c1", "c2"]).dropDuplicates(["doc_id", "c1", "c2"])
    reps = settle(first.select("doc_id", "n", "c1", "near", "sketch", "bits"), "representatives")
    found = settle(components(_candidates(reps, num, den)), "found")
    # a document of several classes connects them
    several = ranked.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("__b")).where("a != __b").select("doc_id", "a")
    bridges = ranked.select("doc_id", F.col("rep").alias("b")).join(several, "doc_id").where("a != b").select("a", "b")
    linked = components(_verified(docs, reps, found, k, num, den).unionByName(bridges))
    roots = classes.join(linked, F.col("rep") == F.col("node"), "left").select("c1", "c2", "copies", F.coalesce("root", "rep").alias("component_id"))
    of_class = join_unique(ranked.select("doc_id", "n", "c1", "c2"), settle(roots, "roots"), ["c1", "c2"], "copies").select("doc_id", "n", "component_id")
    alone = all_rows.where("doc_id IS NULL OR n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    return of_class.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, with all columns, of which one of each component stays: that of the smallest doc_id."""
    gone = join_components(docs, k, num, den).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), 4, 85, 100)
