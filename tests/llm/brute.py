"""Plain restatements of the operators' contracts, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def suffix_dedup(texts, size):
    """(n_bytes, n_removed, n_spans, sha) by text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        keep = [True] * len(b)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                keep[i : i + size] = [False] * size
        spans = sum(1 for i, k in enumerate(keep) if not k and (i == 0 or keep[i - 1]))
        out.append((len(b), keep.count(False), spans, hashlib.sha256(bytes(x for x, k in zip(b, keep) if k)).hexdigest()))
    return out


def components(docs, k, num, den):
    """{row number: (n_shingles, component)} for (doc_id, text) rows."""
    sets = []
    for _, text in docs:
        w = words((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = {d: d for d, _ in docs if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for r, s in enumerate(sets):
        for t in s:
            where[t].append(r)
    for r, s in enumerate(sets):
        for q, both in Counter(x for t in s for x in where[t] if x < r).items():
            a, b = docs[r][0], docs[q][0]
            if a is not None and b is not None and den * both >= num * (len(s) + len(sets[q]) - both):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
    return [(len(s), None if d is None else find(d)) for (d, _), s in zip(docs, sets)]


def quality_base(text):
    w = words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def joined(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]


def disclosed(texts, alpha, least):
    """Spans of the disclosing terms by text; equal texts count once."""
    everywhere, texts = texts, sorted(set(texts))
    spans = [pii(t) for t in texts]
    terms = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{4,}", t)] for t in texts]
    digits = lambda s: re.sub("[^0-9]", "", s)
    entities = [{(k, (t[s:e].lower() if k == 0 else t[s:e] if k == 1 else digits(t[s:e]))) for s, k, e in x} for t, x in zip(texts, spans)]
    n, df_t, df_e, both = len(texts), Counter(), Counter(), Counter()
    for e, w in zip(entities, terms):
        own = {x[2] for x in w}
        df_t.update(own)
        df_e.update(e)
        both.update((x, y) for x in e for y in own)
    told = {(x, y) for (x, y), c in both.items() if c >= least and math.log2(c * n / (df_t[y] * df_e[x])) >= alpha * math.log2(n / df_e[x])}
    found = {t: tuple((s, z) for s, z, y in w if any((x, y) in told for x in e) and not any(p < z and s < q for p, _, q in base)) for t, e, w, base in zip(texts, entities, terms, spans)}
    return [found[t] for t in everywhere]
