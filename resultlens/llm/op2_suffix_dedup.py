"""Operator 2, suffix-array dedup: removes every byte covered by a ``SIZE``-byte string that also starts anywhere else.

1. Candidates. Each window of SIZE bytes has an anchor, the gram of least hash in it, chosen by its content alone; equal windows have equal anchors. Only windows whose anchor is
   found in two distinct texts, or twice in one, can repeat; no other window is looked at further. Equal whole texts are one text (with its
   number of rows): any such text of SIZE bytes or more is removed whole, and it takes part in the rest once.
2. Shards. The stretches of candidate windows are dealt by their text's least shared anchor, so near copies meet (large such groups are split), and cut into shards
   of about ``SHARD`` bytes. Each shard gets a suffix array (Larsson-Sadakane) and common prefixes (Kasai): neighbours that share SIZE bytes repeat.
3. Across shards. Each shard sends one fingerprint (128 bits, sorted) of each distinct window whose anchor is in more texts than the shard holds, by range of the fingerprint, so that the windows around one
   common passage spread evenly. In each range the shards' sorted lists are merged two by two, the places of one list in the other found by binary search; windows found in two shards repeat.
4. The covered bytes of each candidate text are joined to spans. Texts without candidate windows never shuffle: a Bloom filter of the candidates' keys keeps them back (up to its bound of 4 million candidates; beyond it texts move once).

Texts are UTF-8 bytes, null is empty. Matches never cross texts; overlaps count; everything is judged on the input. Repeated rows (of any doc_id) come out repeated. Other columns are left alone.
Memory in a task is a shard, a range of ``RANGE`` windows or one text, whichever is larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, perhaps_among, settle, table
from .suffix import anchors, common_prefixes, fingerprints, stretches, suffix_array
from .textbytes import U, blocks, mix

SIZE, GRAM, SHARD, RANGE = 400, 100, 1_000_000, 1_000_000


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _anchor_rows(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """g, h1, h2, many: the distinct anchors of each text, and whether an anchor stands at two places in it."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = np.asarray(b.column("h1")), np.asarray(b.column("h2"))
            for i, _, data, at in blocks(b.column("text")):
                _, place, g = anchors(data, at, size, gram)
                place = np.unique(place)
                owner = np.searchsorted(at, place, "right") - 1
                order = np.lexsort((owner, g[place]))
                owner, hashes = owner[order], g[place][order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                k = np.flatnonzero(new)
                many = np.diff(np.append(k, len(owner))) > 1
                yield pa.RecordBatch.from_arrays([pa.array(hashes[k].view(np.int64)), pa.array(h1[i + owner[k]]), pa.array(h2[i + owner[k]]), pa.array(many)], ["g", "h1", "h2", "many"])

    return texts.mapInArrow(part, "g long, h1 long, h2 long, many boolean")


def _candidates(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """h1, h2, text, cluster, first and last start of each stretch of candidate windows, windows, anchors and in how many texts each is; for each distinct text that has any."""
    rows = _anchor_rows(texts.where(F.octet_length("text") >= size), size, gram)
    rows = settle(rows.groupBy("g", "h1", "h2").agg(F.max("many").alias("many")), "anchors")
    shared = settle(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("m")).where("n > 1 OR m").select("g", "n"), "shared")
    wanted = join_unique(rows, shared, ["g"], "n").groupBy("h1", "h2").agg(F.collect_list(F.struct("g", "n")).alias("x"))  # a text's own anchors
    wanted = settle(wanted.select("h1", "h2", F.col("x.g").alias("anchors"), F.col("x.n").alias("counts")), "wanted")
    held = perhaps_among(texts.where(F.octet_length("text") >= size), "h1", wanted.select("h1"), wanted.count())
    distinct = held.groupBy("h1", "h2").agg(F.first("text").alias("text"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in blocks(b.column("text")):
                starts, place, g = anchors(data, at, size, gram)
                lists = b.column("anchors").slice(i, j - i)
                known = np.asarray(lists.flatten()).view(np.uint64)
                owner = np.repeat(np.arange(j - i), np.asarray(lists.value_lengths()))
                text = np.searchsorted(at, starts, "right") - 1
                # an anchor counts in the texts that list it
                ok = np.isin(g[place] ^ mix(text.astype(np.uint64)), known ^ mix(owner.astype(np.uint64)))
                starts, text = starts[ok], text[ok]
                cluster = np.zeros(j - i, np.int64)
                sizes = np.asarray(lists.value_lengths())
                cluster[sizes > 0] = np.minimum.reduceat(known, (np.cumsum(sizes) - sizes)[sizes > 0]).view(np.int64)
                low, high = stretches(starts)
                if len(low):  # texts that adjoin in the buffer are apart by SIZE - 1 starts
                    own = np.searchsorted(at, low, "right") - 1
                    cut = np.searchsorted(own, np.arange(j - i + 1))
                    low, high = low - at[own], high - at[own]
                else:
                    cut = np.zeros(j - i + 1, np.int64)
                lists_of = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.astype(np.int64)))  # noqa: E731,B023
                n = np.bincount(text, minlength=j - i)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("h1", "h2", "text")), pa.array(cluster), lists_of(low), lists_of(high), pa.array(n), lists, b.column("counts").slice(i, j - i)], [*"abcdefghi"])

    found = distinct.join(wanted, ["h1", "h2"]).select("h1", "h2", "text", "anchors", "counts")
    names = ["h1", "h2", "text", "cluster", "low", "high", "windows", "anchors", "counts"]
    return found.mapInArrow(part, "a long, b long, c string, d long, e array<long>, f array<long>, g long, h array<long>, i array<long>").toDF(*names).where("windows > 0")


SHARD_ROWS = "kind int, r long, h1 long, h2 long, a long, b long, fp1 binary, fp2 binary, k1 binary, k2 binary, start binary"


def _rows(kind: int, r: np.ndarray, h1: np.ndarray, h2: np.ndarray, a: np.ndarray, b: np.ndarray, blobs: list[list[bytes]] | None = None) -> pa.RecordBatch:
    n = len(h1)
    blobs = blobs or [[None] * n] * 5
    columns = [pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (r, h1, h2, a, b)), *(pa.array(x, pa.binary()) for x in blobs)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SHARD_ROWS.split(", ")])


def _elsewhere(known: list[tuple[np.ndarray, np.ndarray, bool]]) -> np.ndarray:
    """Of the texts' anchors (anchors, in how many texts each is, whether the text lies here whole), sorted, those that may occur outside of these texts."""
    g, n = (np.concatenate([k[i] for k in known]) for i in (0, 1))
    whole = np.repeat([k[2] for k in known], [len(k[0]) for k in known])
    order = np.argsort(g)
    g, n, whole = g[order], n[order], whole[order]
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    here = np.add.reduceat(whole.astype(np.int64), at) if len(g) else at
    return g[at][n[at] > here].view(np.uint64)


def shard(pieces: list[tuple[int, int, int, np.ndarray]], known: list[tuple[np.ndarray, np.ndarray, bool]], ranges: int, size: int, gram: int) -> Iterator[pa.RecordBatch]:
    """For pieces (h1, h2, first start, bytes): rows of kind 0, the starts from a to b that repeat here, and of kind 1, the fingerprints by range of the distinct windows whose
    anchor may occur outside of the shard (known: see _elsewhere)."""
    data = np.concatenate([p[3] for p in pieces])
    at = np.concatenate([[0], np.cumsum([len(p[3]) for p in pieces])])
    starts, place, g = anchors(data, at, size, gram)
    valid = np.zeros(len(data), bool)
    valid[starts] = True
    sa = suffix_array(data, size)
    sa = sa[valid[sa]]
    new = common_prefixes(data, sa, size) < size
    new[:1] = True
    member = np.flatnonzero(new)
    count = np.diff(np.append(member, len(sa)))
    repeats = np.sort(sa[np.repeat(count > 1, count)])
    h1, h2, offset = (np.array([p[k] for p in pieces], np.int64) for k in range(3))

    def owned(x: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, x, "right") - 1

    low, high = stretches(repeats)
    if len(low):
        own = owned(low)
        yield _rows(0, np.zeros(len(low)), h1[own], h2[own], low - at[own] + offset[own], high - at[own] + offset[own])
    anchor = np.zeros(len(data), np.int64)
    anchor[starts] = place
    ask = np.isin(g[anchor[sa[member]]], np.unique(_elsewhere(known)))
    one, count = sa[member][ask], count[ask]
    if not len(one):
        return
    fp1, fp2 = fingerprints(data, one, size)
    r = ((fp1 >> U(40)) * U(ranges) >> U(24)).astype(np.int64)
    order = np.lexsort((fp2, fp1, r))
    one, r, fp1, fp2, count = one[order], r[order], fp1[order], fp2[order], count[order]
    own = owned(one)
    start = np.where(count > 1, -1, one - at[own] + offset[own])  # what repeats here needs no answer
    cut = np.flatnonzero(np.diff(r)) + 1
    cut = np.concatenate([[0], cut, [len(r)]])
    for c in range(0, len(cut) - 1, 8):  # few at a time, as a batch is held whole on its way
        part = list(zip(cut[c : c + 8], cut[c + 1 : c + 9], strict=False))
        blobs = [[x[p:q].tobytes() for p, q in part] for x in (fp1, fp2, h1[own], h2[own], start)]
        zero = np.zeros(len(part))
        yield _rows(1, r[[p for p, _ in part]], zero, zero, zero, zero, blobs)


def _sharded(found: DataFrame, ranges: int, size: int, gram: int) -> DataFrame:
    total = found.groupBy("cluster").agg(F.ceil(F.sum(F.col("windows") + size) / (4 * SHARD)).alias("pieces"), F.count(F.lit(1)).alias("n"))
    large = settle(total.where("pieces > 1"), "clusters")  # dealt before their texts move
    dealt = join_unique(found, large, ["cluster"], "n", "left").withColumn("deal", F.pmod(F.xxhash64("h1"), F.coalesce("pieces", F.lit(1))))
    dealt = dealt.repartition("cluster", "deal").sortWithinPartitions("cluster", "deal", "h1", "h2").select("h1", "h2", "text", "low", "high", "anchors", "counts")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, n = [], [], 0
        for b in batches:
            h1, h2 = np.asarray(b.column("h1")), np.asarray(b.column("h2"))
            low, high, anchor, count = (b.column(c) for c in ("low", "high", "anchors", "counts"))
            for i, _, data, at in blocks(b.column("text")):
                for k in range(len(at) - 1):
                    text = data[at[k] : at[k + 1]]
                    stretch = list(zip(low[i + k].as_py(), high[i + k].as_py(), strict=True))
                    need = sum(y + size - x for x, y in stretch)
                    if held and n + need > SHARD:
                        yield from shard(held, known, ranges, size, gram)
                        held, known, n = [], [], 0
                    mine = (np.asarray(anchor[i + k].values), np.asarray(count[i + k].values), need <= SHARD)
                    known.append(mine)
                    for x, y in stretch:
                        while x <= y:  # a text longer than a shard goes to several
                            z = min(y, x + SHARD)
                            held.append((h1[i + k], h2[i + k], x, text[x : z + size].copy()))
                            n += z + size - x
                            x = z + 1
                            if n >= SHARD and not mine[2]:
                                yield from shard(held, known, ranges, size, gram)
                                held, known, n = [], [mine], 0
        if held:
            yield from shard(held, known, ranges, size, gram)

    return dealt.mapInArrow(part, SHARD_ROWS)


def _places(fp1: np.ndarray, fp2: np.ndarray, of1: np.ndarray, of2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By binary search in a sorted list (fp1, fp2): the place of each of another one's entries, and whether it is there."""
    k = np.searchsorted(fp1, of1)
    n = len(fp1)
    while True:
        at = np.minimum(k, n - 1)
        later = (k < n) & (fp1[at] == of1) & (fp2[at] < of2)
        if not later.any():
            return k, (k < n) & (fp1[at] == of1) & (fp2[at] == of2)
        k[later] += 1


def _merged(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two sorted lists (fp1, fp2, in several shards) as one."""
    if len(x[0]) < len(y[0]):
        x, y = y, x
    if not len(y[0]):
        return x
    k, there = _places(x[0], x[1], y[0], y[1])
    several = x[2].copy()
    several[k[there]] = True
    new = ~there
    return tuple(np.insert(a, k[new], b[new]) for a, b in zip((x[0], x[1], several), y, strict=True))


def merge(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the sorted lists (fp1, fp2, k1, k2, start) of all shards: k1, k2, start of the windows that another shard has too."""
    lists = [(p[0], p[1], np.zeros(len(p[0]), bool)) for p in parts]  # a shard has each window once
    while len(lists) > 1:
        lists = [_merged(*lists[k : k + 2]) if k + 1 < len(lists) else lists[k] for k in range(0, len(lists), 2)]
    fp1, fp2, several = lists[0]
    out = []
    for own1, own2, k1, k2, start in parts:
        ask = np.flatnonzero(start >= 0)
        if len(ask):
            ask = ask[several[_places(fp1, fp2, own1[ask], own2[ask])[0]]]
        out.append((k1[ask], k2[ask], start[ask]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _across(rows: DataFrame) -> DataFrame:
    """h1, h2, a, b: starts from a to b that repeat in another shard."""

    def close(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k1, k2, start = merge(held)
        order = np.lexsort((start, k2, k1))
        k1, k2, start = k1[order], k2[order], start[order]
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (start[1:] != start[:-1] + 1)
        low = np.flatnonzero(new)
        high = np.append(low[1:], len(k1)) - 1
        if len(low):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[low], k2[low], start[low], start[high])], ["h1", "h2", "a", "b"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            names = (("fp1", np.uint64), ("fp2", np.uint64), ("k1", np.int64), ("k2", np.int64), ("start", np.int64))
            for k, r in enumerate(b.column("r").to_pylist()):
                if held and r != now:
                    yield from close(held)
                    held = []
                now = r
                held.append([np.frombuffer(b.column(c)[k].as_py(), t) for c, t in names])
        if held:
            yield from close(held)

    lists = rows.where("kind = 1").select("r", "fp1", "fp2", "k1", "k2", "start")
    return lists.repartition("r").sortWithinPartitions("r").mapInArrow(part, "h1 long, h2 long, a long, b long")


def covered(low: np.ndarray, high: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of the bytes covered by windows starting in the given stretches."""
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order] + size)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    at = np.flatnonzero(new)
    return low[at], high[np.append(at[1:], len(low)) - 1]


def _spans(found: DataFrame, repeats: DataFrame, size: int) -> DataFrame:
    """h1, h2, n_removed, n_spans, kept_sha256, spans, kept (the text that is left)."""
    rows = repeats.groupBy("h1", "h2").agg(F.collect_list(F.struct("a", "b")).alias("s"))  # a text's own stretches
    rows = rows.select("h1", "h2", F.col("s.a").alias("a"), F.col("s.b").alias("b"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, _, data, at in blocks(batch.column("text")):
                for k in range(len(at) - 1):
                    a, b = (np.asarray(batch.column(c)[i + k].values) for c in "ab")
                    low, high = covered(a, b, int(at[k + 1] - at[k]), size)
                    keep = np.ones(at[k + 1] - at[k], bool)
                    for x, y in zip(low, high, strict=True):
                        keep[x:y] = False
                    left = data[at[k] : at[k + 1]][keep].tobytes()
                    out.append((int((high - low).sum()), len(low), hashlib.sha256(left).hexdigest(), ",".join(f"{x}-{y}" for x, y in zip(low, high, strict=True)), left))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), *columns], ["h1", "h2", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    joined = found.select("h1", "h2", "text").join(rows, ["h1", "h2"]).select("h1", "h2", "text", "a", "b")
    return joined.mapInArrow(part, "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, spans string, kept binary")


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_bytes, h1, h2, sha) of all documents, and by h1, h2 the texts that lose bytes: n_removed, n_spans, kept_sha256, spans, kept."""
    text = F.coalesce(docs["text"], F.lit(""))
    texts = docs.select(*_keys(text), text.alias("text"))
    found = settle(_candidates(texts, size, gram), "candidates")
    windows = found.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    rows = settle(_sharded(found, max(1, -(-windows // RANGE)), size, gram), "shards")
    repeats = rows.where("kind = 0").select("h1", "h2", "a", "b").unionByName(_across(rows))
    every = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), *_keys(text), F.sha2(text.cast("binary"), 256).alias("sha"))
    return every, _spans(found, repeats, size)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, lost = dedup(table(spark, sf_dir, "documents"))
    copies = every.where(F.col("n_bytes") >= SIZE).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = lost.select("h1", "h2", "n_removed", "n_spans", "kept_sha256").join(copies, ["h1", "h2"], "full").withColumn("rows", F.coalesce("n", F.lit(1)))
    out = join_unique(every, settle(known, "known"), ["h1", "h2"], "rows", "left")  # copies of one text are met by broadcast where they are very many
    whole, zero = F.col("n").isNotNull(), F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
