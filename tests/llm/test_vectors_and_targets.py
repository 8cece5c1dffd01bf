"""Operators 11 to 13 against plain restatements, with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from resultlens.llm import common
from resultlens.llm import op11_vector_codes as codes
from resultlens.llm import op12_importance_resampling as resampling
from resultlens.llm import op13_decontamination as leaks

from .brute import LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VECTOR = "vec_id long, embedding array<float>, label int, v string, codes int, error string, __n int"
DOCUMENT = "doc_id long, text string, row int, n int, p string, words int, marks string, hashes string, w int, score int, rank int, class int, key int, len int"
ITEM = "item_id long, text string, item string, words int, n int, w string"
CLASH = [1, 1, "z", 1, "z", "z", 1, 1, 1, 1, 1, 1]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def counted(rows):
    return Counter(map(tuple, rows))


# Operator 11


def plain_codes(rows, parts, entries, rounds, scale):
    """(vec_id, codes, error) of each kept row, and the codebooks."""
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in v]))
    if not kept:
        return [], []
    lengths = Counter(len(v) for _, v in kept)
    length = max(lengths, key=lambda n: (lengths[n], n))
    kept = [(i, v) for i, v in kept if len(v) == length]
    width = length // parts
    cut = lambda v, p: v[p * width : (p + 1) * width if p < parts - 1 else length]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]

    def near(x, book):
        found = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v in kept:
                groups[near(cut(v, p), books[p])[0]].append(cut(v, p))
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, [k for k, _ in found], sum(d for _, d in found)))
    return out, books


def vectors(rng, n, length, spread=1.0):
    return [(k, [rng.gauss(0, spread) for _ in range(length)], k % 3 if k % 4 else None, "z", 1, "z", 1) for k in range(n)]


def odd_vectors():
    rng = random.Random(4)
    rows = vectors(rng, 60, 8)
    rows += [rows[5], rows[5], (5, rows[7][1], None, "z", 1, "z", 1)] + [(100 + k, rows[9][1], 1, "z", 1, "z", 1) for k in range(20)]  # repeated rows, one id twice, one vector often
    bad = [None, [None] + [0.0] * 7, [float("nan")] + [0.0] * 7, [float("inf")] * 8, [float("-inf")] * 8, [1.0, 2.0], []]
    rows += [(200 + k, v, 2, "z", 1, "z", 1) for k, v in enumerate(bad)]
    return rows + [(None, [0.5] * 8, None, "z", 1, "z", 1), (300, [-0.0] * 8, 7, "z", 1, "z", 1), (301, [0.25, -0.25] * 4, 7, "z", 1, "z", 1)]


@pytest.mark.parametrize("entries", [1, 7, 256])
def test_codes_are_those_of_the_plain_rounds(spark, entries):
    rows = odd_vectors()
    coded, books = codes.compressed(spark.createDataFrame(rows, VECTOR).repartition(3), 4, entries, 3, 1024)
    want, plain = plain_codes(rows, 4, entries, 3, 1024)
    assert [b.tolist() for b in books] == plain
    assert Counter((r["vec_id"], tuple(r["codes"]), r["error"]) for r in coded.collect()) == Counter((i, tuple(c), d) for i, c, d in want)


def test_codes_of_vectors_that_the_parts_do_not_divide(spark):
    rows = vectors(random.Random(1), 40, 7)
    coded, books = codes.compressed(spark.createDataFrame(rows, VECTOR), 4, 5, 2, 64)
    want, plain = plain_codes(rows, 4, 5, 2, 64)
    assert [b.tolist() for b in books] == plain and sorted((r["vec_id"], r["codes"]) for r in coded.collect()) == sorted((i, c) for i, c, _ in want)


@pytest.mark.parametrize("largest", [3, 900, 1 << 24])
def test_annuli_lose_no_nearest_entry(largest):
    """Few distinct values give many ties; values at the bound leave the exact range of doubles."""
    rng = np.random.default_rng(largest)
    x, book = rng.integers(-largest, largest + 1, (700, 16)), rng.integers(-largest, largest + 1, (256, 16))
    x[:50], book[9] = book[rng.integers(0, 256, 50)], book[3]
    distance = ((x[:, None, :] - book[None]) ** 2).sum(2)
    index, least = codes.nearest(x, book)
    assert (index == distance.argmin(1)).all() and (least == distance.min(1)).all()


def test_components_beyond_the_bound_and_no_vectors(spark):
    rows = [(1, [3e38] * 4, 1, "z", 1, "z", 1), (2, [-3e38] * 4, 1, "z", 1, "z", 1)]
    coded, books = codes.compressed(spark.createDataFrame(rows, VECTOR), 4, 1, 1, 1024)
    assert all(b.tolist() == [[0]] for b in books) and [r["error"] for r in coded.collect()] == [4 * codes.BOUND**2] * 2
    for none in (rows[:0], [(1, None, 1, "z", 1, "z", 1)]):
        coded, _ = codes.compressed(spark.createDataFrame(none, VECTOR))
        out = codes.with_label_error(coded)
        assert out.count() == 0 and {"vec_id", "codes", "error", "label_error"} <= set(out.columns)


def test_errors_of_a_label(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(k, lab, [0], e) for k, (lab, e) in enumerate([(1, 5), (1, 7), (None, 2), (None, 3), (0, 9), (1, 1), (1, 1), (1, 1)])]
    out = codes.with_label_error(spark.createDataFrame(rows, "vec_id long, label int, codes array<int>, error long"))
    assert {r["vec_id"]: r["label_error"] for r in out.collect()} == {0: 15, 1: 15, 2: 5, 3: 5, 4: 9, 5: 15, 6: 15, 7: 15}


# Operator 12


def plain_draw(docs, target, longest, buckets, least, percent, seed):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    rows = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = [r for r in rows if r[1] >= least]
    for k, r in enumerate(sorted(fit, key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))[: len(fit) * percent // 100]):
        r[5] = k + 1
    return Counter(map(tuple, rows))


def odd_documents():
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma", "épée", "x1", "the", "of", "漢字", "😀"]) + rng.choice(["", ",", "."]) for _ in range(n))
    texts = [None, "", " ,.; \n", "one", "a" * 5000, some(9000), *(some(rng.randint(1, 60)) for _ in range(60)), *[some(30)] * 9]
    rows = list(enumerate(texts))
    return rows + [rows[20], rows[20], (None, texts[30]), (None, None), (5, some(25)), (40, texts[-1])]


@pytest.mark.parametrize(("longest", "percent", "nodes"), [(1, 10, 200_000), (3, 40, 50), (2, 100, 1)])
def test_draw_is_that_of_the_plain_scores(spark, monkeypatch, longest, percent, nodes):
    """Tries that are emptied after each text, and ranges of a few rows, change nothing."""
    monkeypatch.setattr(resampling, "NODES", nodes)
    monkeypatch.setattr(resampling, "RANGE_ROWS", 4)
    docs, target = odd_documents(), ["alpha beta alpha", None, "the the 漢字, épée", ""]
    df = spark.createDataFrame([(*r, *CLASH) for r in docs], DOCUMENT).repartition(3)
    aim = spark.createDataFrame([(k, t, "z", 1, 1, "z") for k, t in enumerate(target)], ITEM)
    out = resampling.resampled(df, aim, longest, 97, 20, percent, 7)
    assert counted(out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == plain_draw(docs, target, longest, 97, 20, percent, 7)


def test_draw_of_nothing(spark):
    docs, aim = spark.createDataFrame([], DOCUMENT), spark.createDataFrame([(1, "a", "z", 1, 1, "z")], ITEM)
    assert resampling.resampled(docs, aim).count() == 0
    few = spark.createDataFrame([(1, "a few words", *CLASH), (2, None, *CLASH)], DOCUMENT)
    assert [r["rank"] for r in resampling.resampled(few, aim.limit(0)).collect()] == [None, None]


def test_tied_scores_go_to_the_smaller_id(spark):
    rows = [(k, 30, 30, 0, 5) for k in (9, 3, 7, 3, None, 1)] + [(2, 30, 30, 0, 6), (8, 1, 1, 0, 99)]
    out = resampling.drawn(common.settle(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(4), "ties"), 20, 100)
    assert [r["doc_id"] for r in out.where("rank IS NOT NULL").orderBy("rank").collect()] == [2, 1, 3, 3, 7, 9, None]


# Operator 13


def plain_hits(docs, items, size):
    held = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            held[tuple(w[i : i + m])].add("" if item_id is None else str(item_id))
    lengths = {len(g) for g in held}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (of := held.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= of
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def odd_items():
    rng = random.Random(3)
    some = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(n)]
    long = [some(n) for n in (10, 11, 25, 60)]
    items = [(k, " ".join(w)) for k, w in enumerate(long)] + [(10, "Short item of Five"), (11, "uniqueword"), (12, None), (13, " ,. "), (None, " ".join(long[2][3:20])), (2, " ".join(some(14))), (15, " ".join(long[3])), (16, "a a a a a a a a a a a a")]
    docs = []
    for k in range(80):
        w = some(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(long)
            i = rng.randint(0, len(part) - 1)
            w[rng.randint(0, len(w)) : 0] = part[i : i + rng.randint(1, 40)]
        if k % 7 == 0:
            w += ["SHORT", "item", "of", "five", "Uniqueword"]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(x.upper() if k % 5 == 0 else x for x in w)))
    docs += [(None, docs[3][1]), (None, None), (200, ""), (201, "a " * 3000), (202, "é".join(long[0])), docs[7], docs[7], (7, docs[8][1])] + [(300 + k, " ".join(long[3])) for k in range(40)]
    return docs, items


@pytest.mark.parametrize(("size", "k"), [(10, 5), (6, 2), (4, 4), (10, 10)])
def test_hits_are_all_windows_in_common(spark, monkeypatch, size, k):
    """Hot windows and signatures meet by broadcast here."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    docs, items = odd_items()
    df = spark.createDataFrame([(*r, *CLASH) for r in docs], DOCUMENT).repartition(3)
    out = leaks.judged(df, spark.createDataFrame([(*r, "z", 1, 1, "z") for r in items], ITEM), size, k)
    assert counted(out.collect()) == plain_hits(docs, items, size)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SENT_WORDS", 1)
    docs, items = odd_items()
    out = leaks.judged(spark.createDataFrame([(*r, *CLASH) for r in docs], DOCUMENT), spark.createDataFrame([(*r, "z", 1, 1, "z") for r in items], ITEM))
    assert counted(out.collect()) == plain_hits(docs, items, 10)


def test_no_items_and_no_documents(spark):
    docs, items = spark.createDataFrame([(1, "a b c", *CLASH), (None, None, *CLASH)], DOCUMENT), spark.createDataFrame([(1, "a b", "z", 1, 1, "z")], ITEM)
    nothing = hashlib.sha256(b"").hexdigest()
    assert counted(leaks.judged(docs, items.limit(0)).collect()) == Counter([(1, 3, 0, 0, nothing, False), (None, 0, 0, 0, nothing, False)])
    assert leaks.judged(docs.limit(0), items).count() == 0


def test_documents_do_not_shuffle_their_texts(spark, sf):
    """The pass over the texts has no exchange, and no Python."""
    known = leaks.Items(common.table(spark, sf, "benchmark"), 10, 5)
    plan = leaks.extended(common.table(spark, sf, "documents"), known, 10, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Python" not in plan
