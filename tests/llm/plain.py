"""Plain, slow versions of the operators, for comparison."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fold_of(key, n):
    return None if key is None else zlib.crc32(str(key).encode()) % n


def contaminated(text, items, n=10):
    """(words, hit words, ids of the items with a window in the text)."""
    words, hit, found = WORDS.findall(fold(text)), set(), set()
    for item, body in items:
        w = WORDS.findall(fold(body))
        if item is None or not w:
            continue
        size = min(n, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def fingerprint(text):
    w = WHITE.findall(fold(text))
    if not w:
        return 0
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def runs(text, n=5):
    """The set of word runs of a text."""
    w = WHITE.findall(fold(text))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(prints, bits=2):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def without_repeats(texts, window=35):
    """(words, removed, sha256 of the kept text) of each text."""
    words = [WHITE.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def unigram(rows):
    """(n_tokens, n_known, N, base score) of each (text, learns)."""
    tokens = [[*WHITE.findall(fold(t)), None] for t, _ in rows]
    c = Counter(w for t, (_, learns) in zip(tokens, rows, strict=True) if learns for w in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for t in tokens]


def ppm(learned, texts, order=5):
    """log10 probability of each text: method D, exclusion, contexts of up to ``order`` symbols."""
    symbols = lambda t: [0] * order + [x + 1 for x in fold(t).encode()] + [257]
    seen = {}
    for t in learned:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1

    def cost(context, symbol):
        total, excluded = 0.0, set()
        for k in range(order, -1, -1):
            have = seen.get(context[order - k :])
            if have is None:
                continue
            weights = {s: 2 * c - 1 for s, c in have.items() if s not in excluded}
            left, escape = sum(weights.values()), len(weights)
            escape = max(escape, 1) if not left else escape
            if symbol in weights:
                return total + math.log10(weights[symbol] / (left + escape))
            total += math.log10(escape / (left + escape))
            excluded = set(have)
        return total - math.log10(max(257 - len(excluded), 1))

    out = []
    for t in texts:
        s = symbols(t)
        out.append(sum(cost(tuple(s[i - order : i]), s[i]) for i in range(order, len(s))))
    return out


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) ** 2
    return math.sqrt(total)


def nearest(rows, k=10):
    ok = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in sorted(ok):
        if q % 100 == 0:
            near = sorted((distance(a, b), i) for i, b in ok if i != q)[:k]
            out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return out
