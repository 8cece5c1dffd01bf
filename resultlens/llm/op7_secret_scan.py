"""Operator 7, secret scans: base patterns, and novelty under dictionary-primed zstandard.

Base kinds are assign, access and hex (fixed patterns below; failing matches are dropped, not retried). Beyond them, a run of ``CANDIDATE`` characters (16 or more, with a digit and a letter, or of letters whose case changes as often as at random) in a sensitive context
(a sensitive word shortly before it on its line or in the ``LINES`` lines above, or a PEM block of a private key) is a candidate. Its marginal compressed size is the difference that it makes to its compressed surroundings,
under a compressor primed with a dictionary of identifiers; a candidate whose marginal bytes are at least ``NOVEL`` of what random strings of its length and alphabet
cost in its place (mean of ``DRAWS``) owes nothing to code and names around it and is reported as kind novel, unless a base span covers part of it. Other copies of the
candidate are blanked out of its surroundings, and a string that is novel once is reported wherever it stands as a run of its own.

Positions are code points, end exclusive. Null text is empty; no text gives no spans, and the hash of the empty string. Texts that hold no run of
hex digits, access prefix or sensitive word are not decoded. Repeated rows come out repeated; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left, bisect_right
from itertools import accumulate
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .textbytes import TO_LOWER, blocks, runs

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")
SENSITIVE = (b"passw", b"secret", b"token", b"api", b"credential", b"auth", b"private", b"key", b"bearer")
NOVEL, DRAWS, REACH, LINES, AROUND, LEVEL, SWITCHES = 0.8, 4, 64, 3, 256, 9, 0.37
CONTEXT = re.compile(r"(passw|secret|token|api|credential|auth|private|key|bearer)", re.IGNORECASE | re.ASCII)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*+)-----(?:(?!-----)[\s\S])*+", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IS_HEX = np.zeros(256, bool)
IS_HEX[[*range(48, 58), *range(97, 103)]] = True


# fixed values: words that identifiers of code, configuration and prose about them are made of
IDENTIFIERS = """abstract access account action active address admin agent alias alpha append apply archive argument array assert async attribute author auth await backup base batch begin binary block boolean branch
break bucket buffer build bytes cache callback catch certificate channel char check class client close cluster code collection column command comment commit compare compile config connect connection const constructor
container content context continue control copy count create credential current cursor data database date debug decode default define delete deploy description detail device dict directory disable document domain
download driver element else email enable encode endpoint engine entry enum environment error event except exception execute exists export expression extend false field file filter final finally find first flag float
folder for format from function generate get global group handle handler hash header hello host html http https identifier ignore image implements import include index info init initialize input insert instance integer
interface internal invalid item iterator job json key label language last length library license limit line link list listener load local location lock log login logger loop main manager map match max memory message
metadata method min mode model module mount name namespace network new next node none null number object offset open operation option order output owner package page parameter parent parse password path pattern payload
permission pipeline platform plugin policy pool port position post prefix previous print private process product profile project property protocol provider proxy public query queue random range read record recursive
reference region register release remote remove render replace report repository request require reset resource response result return role root route rule run sample save schema scope script search secret section
select self sequence server service session set settings shared signature size socket sort source space stack start state static status stop storage store stream string struct style submit success suffix super switch
sync system table tag target task team template test text thread time timeout title token total trace transaction transform true try type undefined union unique update upload url user username utils valid value variable
vector vendor verify version view virtual void volume wait warning while width window with worker workspace write xml yaml yield zone"""


def identifiers() -> bytes:
    """The priming dictionary: words of identifiers, joined in the usual ways, with the sensitive words."""
    names = IDENTIFIERS.split()
    joined = [*("_".join(names[k : k + 3]) for k in range(0, len(names), 3)), *("".join(x.title() for x in names[k : k + 2]) for k in range(0, len(names), 2))]
    return "\n".join([*joined, *names, *(f'{s.decode()} = "' for s in SENSITIVE)]).encode()


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def like_a_secret(word: str) -> bool:
    """Digits among letters; or letters alone whose case changes about as often as at random (in names it changes at the borders of words)."""
    if any(c.isdigit() for c in word):
        return any(c.isalpha() for c in word)
    letters = [c.isupper() for c in word if c.isalpha()]
    return len(letters) >= 16 and sum(a != b for a, b in zip(letters, letters[1:])) >= SWITCHES * (len(letters) - 1)


def alphabet(word: str) -> str:
    """The characters that a random string of the kind of `word` is drawn from: digits, its cases of letters (A to F if no others are there) and its signs."""
    held = set(word)
    out = string.digits + "".join(c for c in "+/_=-" if c in held)
    for letters in (string.ascii_lowercase, string.ascii_uppercase):
        if mine := held & set(letters):
            out += letters[:6] if mine <= set(letters[:6]) else letters
    return out


def is_novel(word: str, before: str, after: str, zstd: zstandard.ZstdCompressor) -> bool:
    """Whether `word` costs its surroundings about as much as random strings do; the draws are the same for the same word."""
    rng, chars = random.Random(word), alphabet(word)
    least = len(zstd.compress((before + after).encode()))
    more, *drawn = (len(zstd.compress((before + w + after).encode())) - least for w in (word, *("".join(rng.choices(chars, k=len(word))) for _ in range(DRAWS))))
    return more * DRAWS >= NOVEL * sum(drawn)


def surroundings(text: str, s: int, e: int) -> tuple[str, str]:
    """AROUND characters on each side of text[s:e], with spaces in place of whatever belongs to another copy of it."""
    word, n = text[s:e], e - s
    before, after = text[max(0, s - AROUND - n + 1) : s], text[e : e + AROUND + n - 1]
    return before.replace(word, " " * n)[-AROUND:], after.replace(word, " " * n)[:AROUND]


def sensitive(text: str) -> Callable[[int], bool]:
    """Whether a position is in a sensitive context of the text."""
    words = [m.end() for m in CONTEXT.finditer(text)]
    starts = [m.start() for m in CONTEXT.finditer(text)]
    lines = [-1, *(m.start() for m in re.finditer("\n", text))]
    keys = [m.span() for m in PEM.finditer(text) if "PRIVATE KEY" in m[1]]
    begins = [k[0] for k in keys]

    def at(s: int) -> bool:
        k = bisect_left(lines, s) - 1
        own, above = max(lines[k] + 1, s - REACH), lines[max(0, k - LINES)] + 1
        first = bisect_left(starts, own)
        if first < len(words) and words[first] <= s:
            return True
        first = bisect_left(starts, above)
        key = bisect_right(begins, s) - 1
        return (first < len(words) and words[first] <= lines[k]) or (key >= 0 and s < keys[key][1])

    return at


def novel_spans(text: str, base: list[tuple[int, int, int]], zstd: zstandard.ZstdCompressor) -> list[tuple[int, int, int]]:
    runs_of: dict[str, list[tuple[int, int]]] = {}
    novel: set[str] = set()
    near = sensitive(text)

    begins, reached = [x for x, _, _ in base], list(accumulate((z for _, _, z in base), max))

    def free(s: int, e: int) -> bool:
        k = bisect_left(begins, e) - 1  # the last base span that begins before e
        return k < 0 or reached[k] <= s

    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if not like_a_secret(m[0]):
            continue
        runs_of.setdefault(m[0], []).append((s, e))
        if m[0] not in novel and near(s) and free(s, e) and is_novel(m[0], *surroundings(text, s, e), zstd):
            novel.add(m[0])
    return sorted((s, 3, e) for word in novel for s, e in runs_of[word] if free(s, e))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def suspects(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold anything that a span needs."""
    begin, end = runs(IS_HEX[data], at)
    where = [begin[end - begin >= HEX_LEAST]]
    for raw, needles in ((data.tobytes(), (b"AKIA",)), (TO_LOWER[data].tobytes(), SENSITIVE)):
        for needle in needles:
            hits, k = [], raw.find(needle)
            while k >= 0:
                hits.append(k)
                k = raw.find(needle, k + 1)
            where.append(np.array(hits, np.int64))
    return np.unique(np.searchsorted(at, np.concatenate(where), "right") - 1)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel for each row."""
    dictionary = identifiers()
    nothing = hashlib.sha256(b"").hexdigest()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = compressor(dictionary)
        for b in batches:
            for i, j, data, at in blocks(b.column("text")):
                n = np.zeros((4, j - i), np.int64)
                shas, spans = [nothing] * (j - i), [""] * (j - i)
                for k in suspects(data, at).tolist():
                    text = data[at[k] : at[k + 1]].tobytes().decode()
                    base = base_spans(text)
                    every = sorted(base + novel_spans(text, base, zstd))
                    for _, kind, _ in every:
                        n[kind, k] += 1
                    shas[k], spans[k] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *map(pa.array, n[:3]), pa.array(shas), pa.array(spans), pa.array(n[3])], [*"abcdefg"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(part, f"a {kind}, b long, c long, d long, e string, f string, g long").toDF("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
