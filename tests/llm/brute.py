"""The definitions of the operators, written plainly over Python lists."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def base_secrets(text):
    text, found = text or "", []
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def base_digest(found):
    names = ("assign", "access", "hex")
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def window_entropy(text, size):
    return [sum(-n / size * math.log2(n / size) for n in Counter(text[i:i + size]).values()) for i in range(len(text) - size + 1)]


def entropy_spans(text, size=20):
    """(start, kind, end) of the windows of high entropy, by the definition of the pieces."""
    text, found, words = text or "", [], re.compile("example|placeholder|changeme|your_?key|xxxx|0123456789|abcdefgh", re.I)
    pieces = [(m.start(), m[0], 3) for m in re.finditer("[0-9A-Fa-f]+", text)]
    for m in re.finditer("[A-Za-z0-9+/_-]+", text):
        if len(m[0]) < size:
            continue
        parts = [(x.start(), x[0]) for x in re.finditer("[^/_-]+", m[0])] if words.search(m[0]) else [(0, m[0])]
        pieces += [(m.start() + at, x, 4) for at, x in parts if not re.fullmatch("[0-9A-Fa-f]+", x)]
    for at, x, kind in pieces:
        uuid = re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", x)
        if uuid or words.search(x) or not re.search("[0-9]", x) or not re.search("[A-Za-z]", x):
            continue
        hot = [i for i, h in enumerate(window_entropy(x, size)) if h >= (3.0 if kind == 3 else 3.75) - 1e-9]
        if hot:
            found.append((at + hot[0], kind, at + hot[-1] + size))
    return sorted(found)


def shingles(text, n=3):
    w = WORDS.findall(low(text))
    n = min(n, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def jaccard_components(rows, percent=90, n=3):
    """(doc_id, set size, component) of (doc_id, text) rows."""
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        ids = [x for x in (least.get(g), i) if x is not None]
        least[g] = min(ids) if ids else None
    return sorted(((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group, strict=True)), key=repr)


def item_windows(items, size=10):
    out = defaultdict(set)
    for i, text in items:
        w = TERMS.findall(low(text))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            out[tuple(w[k:k + n])].add("" if i is None else str(i))
    return out


def contamination(rows, items):
    windows, out = item_windows(items), []
    for i, text in rows:
        w, hit, names = TERMS.findall(low(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    names |= found
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _discounts(n):
    if not n[1] or not n[2]:
        return [0.5, 0.75, 0.75]
    y = n[1] / (n[1] + 2 * n[2])
    found = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1)]


def language_model(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base, score) of (doc_id, text) rows."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    tokens = [[*WORDS.findall(low(t)), "</s>"] for _, t in rows]
    one, two = Counter(), Counter()
    for h, t in zip(held, tokens, strict=True):
        if not h:
            one.update(t)
            two.update(zip(["</s>", *t[:-1]], t, strict=True))
    total, types = sum(one.values()), len(one)
    context, before = defaultdict(Counter), Counter()
    for (u, w), n in two.items():
        context[u]["n"] += n
        context[u][min(n, 3)] += 1
        before[w] += 1
    d, e = _discounts(Counter(two.values())), _discounts(Counter(before.values()))
    rest = sum(e[min(n, 3) - 1] for n in before.values())
    less = lambda n, by: n - (by[min(n, 3) - 1] if n else 0)

    def chance(u, w):
        lower = (less(before[w], e) + rest / (types + 1)) / len(two) if two else 1.0
        if u not in context:
            return lower
        c = context[u]
        return (less(two[u, w], d) + sum(d[k - 1] * c[k] for k in (1, 2, 3)) * lower) / c["n"]

    out = []
    for (i, _), h, t in zip(rows, held, tokens, strict=True):
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t)
        score = sum(math.log10(chance(u, w)) for u, w in zip(["</s>", *t[:-1]], t, strict=True))
        out.append((i, h, len(t), sum(one[w] > 0 for w in t), total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def simhash(text, n=3):
    """The 64-bit fingerprint of a text."""
    words = [w.encode() for w in WORDS.findall(low(text))]
    if not words:
        return 0
    n = min(n, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows, distance=2):
    """(doc_id, fingerprint, component) of (doc_id, text) rows."""
    prints = [simhash(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group, strict=True)), key=repr)


SEARCH_TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lexical_score(terms, document, df, documents, words):
    counts = Counter(document)
    m = 100 - 90 + (90 * len(document) * documents) // words
    return sum(
        math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m))
        for t in terms if counts[t])


def lexical_search(rows, items, top=10):
    """(item_id, rank, doc_id, score) of (doc_id, text) rows for (item_id, text) items."""
    docs = [(i, SEARCH_TERMS.findall(low(t))) for i, t in rows]
    df = Counter(t for _, w in docs for t in set(w))
    documents, words, out = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs), []
    for item, text in items:
        terms = set(SEARCH_TERMS.findall(low(text)))
        scored = [(-lexical_score(terms, w, df, documents, words), i is None, i) for i, w in docs if terms & set(w)]
        best = sorted((s for s in scored if s[0] < 0), key=lambda s: (s[0], s[1], s[2] or 0))[:top]
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


def hard_negatives(rows):
    """The report of (vec_id, vector, label) rows."""
    kept = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, [math.floor(256 * x) for x in vector], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, vector, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(vector, v, strict=False)), j, m) for b, (j, v, m) in enumerate(kept) if b != a]
        for high, p, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            window = [s for s in scored if s[2] != label and 80 * high <= 100 * s[0] <= 100 * high]
            out += [(i, p, k, j, high, s) for k, (s, j, _) in enumerate(sorted(window, key=order)[:5], 1)]
    return sorted(out, key=repr)
