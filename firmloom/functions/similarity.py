"""String similarity kernels (numpy) and the Arrow UDFs built on them.

Scores are on a 0-100 scale. `ratio` is the normalised Indel similarity,
200 * LCS / (|a| + |b|); `wratio` weighs it against token-sorted, token-set and
partial comparisons. LCS lengths come from the bit-parallel recurrence
(Hyyro 2004), run over whole columns of candidate strings at a time: one
pattern, thousands of texts per numpy call.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_WEIGHT = 0.95
LONG_RATIO, LONG_RATIO_MAX = 1.5, 8.0
PARTIAL_WEIGHT, FAR_PARTIAL_WEIGHT = 0.9, 0.6


class TextColumn:
    """Strings of a candidate set by character position, shortest string first.

    `columns[j]` holds the codes of character j for the strings that have one,
    so memory follows the total length, not the longest string.
    """

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.order = np.argsort(self.lengths, kind="stable")
        flat = np.frombuffer("".join(texts[i] for i in self.order).encode("utf-32-le"), dtype=np.uint32)
        self.alphabet, codes = np.unique(flat, return_inverse=True)
        sizes = self.lengths[self.order]
        widest = int(sizes[-1]) if len(texts) else 0
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        position = np.arange(len(flat)) - starts
        by_position = codes[np.argsort(position, kind="stable")]
        self.first_longer = np.searchsorted(sizes, np.arange(widest), side="right")
        ends = np.cumsum(len(texts) - self.first_longer)
        self.columns = np.split(by_position, ends[:-1]) if widest else []

    def masks(self, pattern: str) -> np.ndarray:
        """Bit masks of the pattern's characters, one row per alphabet code."""
        words = (len(pattern) + 63) // 64
        table = np.zeros((len(self.alphabet) + 1, words), dtype=np.uint64)
        index = {int(c): i for i, c in enumerate(self.alphabet)}
        for at, char in enumerate(pattern):
            row = index.get(ord(char))
            if row is not None:
                table[row, at // 64] |= np.uint64(1) << np.uint64(at % 64)
        return table

    def lcs(self, pattern: str) -> np.ndarray:
        """LCS length of the pattern with every text, in the texts' given order."""
        found = np.zeros(len(self.lengths), dtype=np.int64)
        if pattern and self.columns:
            columns = zip(self.columns, self.first_longer)
            found[self.order] = _lcs_columns(columns, self.masks(pattern), len(self.lengths), len(pattern))
        return found

    def edits(self, pattern: str) -> np.ndarray:
        """Edit distance of the pattern to every text, in the texts' given order."""
        found = self.lengths.copy()
        if pattern:
            columns = zip(self.columns, self.first_longer)
            found[self.order] = _edit_columns(columns, self.masks(pattern), len(self.lengths), len(pattern))
        return found


def _edit_columns(columns, table: np.ndarray, count: int, size: int) -> np.ndarray:
    """Bit-parallel edit distance (Myers 1999) for `count` texts fed one (codes, first live text) column at a time."""
    words = table.shape[1]
    one, top = np.uint64(1), np.uint64(63)
    end = np.uint64((size - 1) % 64)
    up = np.full((words, count), ~np.uint64(0), dtype=np.uint64)  # cells one more than the cell above, or one less
    down = np.zeros((words, count), dtype=np.uint64)
    distance = np.full(count, size, dtype=np.int64)
    for codes, start in columns:
        carry = more_in = less_in = None
        for w in range(words):
            more, less, match = up[w, start:], down[w, start:], table[codes, w]
            both = match & more
            total = both + more
            overflow = total < both
            if carry is not None:
                total = total + carry
                overflow |= total < carry
            carry = overflow.astype(np.uint64)
            across = (total ^ more) | match
            level = match | less
            rises, falls = less | ~(across | more), more & across
            if w == words - 1:
                distance[start:] += ((rises >> end) & one).astype(np.int64) - ((falls >> end) & one).astype(np.int64)
            next_more, next_less = rises >> top, falls >> top
            rises = (rises << one) | (one if more_in is None else more_in)
            falls = falls << one if less_in is None else (falls << one) | less_in
            more_in, less_in = next_more, next_less
            up[w, start:] = falls | ~(level | rises)
            down[w, start:] = rises & level
    return distance


def _lcs_columns(columns, table: np.ndarray, count: int, size: int) -> np.ndarray:
    """Bit-parallel LCS for `count` texts fed one (codes, first live text) column at a time."""
    words = table.shape[1]
    state = np.full((words, count), ~np.uint64(0), dtype=np.uint64)
    for codes, start in columns:
        carry = None
        for w in range(words):
            s = state[w, start:]
            match = s & table[codes, w]
            total = s + match
            overflow = total < s
            if carry is not None:
                total = total + carry
                overflow |= total < carry
            state[w, start:] = total | (s - match)
            carry = overflow.astype(np.uint64)
    bits = np.full(words, ~np.uint64(0), dtype=np.uint64)
    if size % 64:
        bits[-1] = (np.uint64(1) << np.uint64(size % 64)) - np.uint64(1)
    return np.bitwise_count(~state & bits[:, None]).sum(axis=0).astype(np.int64)


def lcs_length(a: str, b: str) -> int:
    """LCS length of one pair."""
    masks: dict[str, int] = {}
    for at, char in enumerate(a):
        masks[char] = masks.get(char, 0) | (1 << at)
    full = (1 << len(a)) - 1
    state = full
    for char in b:
        match = state & masks.get(char, 0)
        state = ((state + match) | (state - match)) & full
    return len(a) - state.bit_count()


def _norm(lcs: int, total: int) -> float:
    return 200.0 * lcs / total if total else 100.0


def ratio(a: str, b: str) -> float:
    return _norm(lcs_length(a, b), len(a) + len(b))


def _set_score(shared: int, left: str, right: str) -> float:
    """Token-set score from the joined length of the shared tokens and the two remainders."""
    gap = 1 if shared else 0
    if shared and (not left or not right):
        return 100.0
    l_full, r_full = shared + gap + len(left), shared + gap + len(right)
    both = _norm(shared + gap + lcs_length(left, right), l_full + r_full)
    if not shared:
        return both
    return max(both, _norm(shared, shared + l_full), _norm(shared, shared + r_full))


def _remainders(a: str, b: str) -> tuple[int, str, str]:
    ta, tb = set(a.split()), set(b.split())
    shared = ta & tb
    return len(" ".join(shared)), " ".join(sorted(ta - shared)), " ".join(sorted(tb - shared))


def token_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    ordered = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(ordered, _set_score(*_remainders(a, b)))


def _best_windows(needle: str, texts: list[str]) -> np.ndarray:
    """Best ratio of the needle against every window of each text no longer than it.

    The texts are laid out in one array with padding between them, so all
    windows of all texts go through the LCS recurrence together.
    """
    size = len(needle)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    alphabet, codes = np.unique(flat, return_inverse=True)
    # Text i starts after size - 1 pads for each text up to it.
    starts = np.cumsum(lengths) - lengths + (size - 1) * np.arange(1, len(texts) + 1)
    padded = np.full(lengths.sum() + (size - 1) * (len(texts) + 1), len(alphabet), dtype=np.int64)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    padded[np.repeat(starts, lengths) + offset] = codes
    windows = len(padded) - size + 1
    index = {int(c): i for i, c in enumerate(alphabet)}
    table = np.zeros((len(alphabet) + 1, (size + 63) // 64), dtype=np.uint64)
    for at, char in enumerate(needle):
        row = index.get(ord(char))
        if row is not None:
            table[row, at // 64] |= np.uint64(1) << np.uint64(at % 64)
    lcs = _lcs_columns(((padded[j:j + windows], 0) for j in range(size)), table, windows, size)
    real = np.concatenate(([0], np.cumsum(padded != len(alphabet))))
    widths = real[size:] - real[:-size]
    scores = 200.0 * lcs / (size + widths)
    # Windows from size - 1 before a text's start onwards touch that text only.
    return np.maximum.reduceat(scores, starts - (size - 1))


def _best_window(needle: str, text: str) -> float:
    return float(_best_windows(needle, [text])[0])


def partial_ratio(a: str, b: str) -> float:
    """Ratio of the shorter string with the best-matching stretch of the longer one."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = 100.0 if short in long else _best_window(short, long)
    if best < 100.0 and len(a) == len(b):
        best = max(best, _best_window(long, short))
    return best


def _partial_token_ratio(a: str, b: str) -> float:
    ta, tb = a.split(), b.split()
    if set(ta) & set(tb):
        return 100.0
    best = partial_ratio(" ".join(sorted(ta)), " ".join(sorted(tb)))
    if len(set(ta)) < len(ta) or len(set(tb)) < len(tb):
        best = max(best, partial_ratio(" ".join(sorted(set(ta))), " ".join(sorted(set(tb)))))
    return best


def wratio(a: str, b: str) -> float:
    """Weighted ratio of one pair; 0 when either side is empty."""
    if not a or not b:
        return 0.0
    plain = ratio(a, b)
    stretch = max(len(a), len(b)) / min(len(a), len(b))
    if stretch < LONG_RATIO:
        return max(plain, token_ratio(a, b) * TOKEN_WEIGHT)
    weight = PARTIAL_WEIGHT if stretch <= LONG_RATIO_MAX else FAR_PARTIAL_WEIGHT
    return max(
        plain,
        partial_ratio(a, b) * weight,
        _partial_token_ratio(a, b) * TOKEN_WEIGHT * weight,
    )


def _partial_rows(name: str, texts: list[str]) -> np.ndarray:
    """partial_ratio of one name with many texts."""
    if name and all(len(t) > len(name) for t in texts):
        return _best_windows(name, texts)
    return np.array([partial_ratio(name, t) for t in texts])


class WRatioIndex:
    """Right-hand names of one cell, prepared for top-1 search by `wratio`.

    `best` scores every name with what numpy can do for the whole column and
    runs the costlier comparisons only where their upper bound could still win,
    so the answer is the exact maximum (lowest position among equals).
    """

    SMALL = 6

    def __init__(self, names: list[str]):
        self.names = names
        if len(names) <= self.SMALL:
            return
        self.plain = TextColumn(names)
        split = [n.split() for n in names]
        self.sorted = TextColumn([" ".join(sorted(t)) for t in split])
        self.token_sets = [set(t) for t in split]
        self.holders: dict[str, list[int]] = {}
        for row, tokens in enumerate(self.token_sets):
            for token in tokens:
                self.holders.setdefault(token, []).append(row)
        self.set_sizes = np.array([len(" ".join(t)) for t in self.token_sets], dtype=np.int64)
        self.holders = {t: np.array(r) for t, r in self.holders.items()}
        self.repeats = np.array([len(t) < len(u) for t, u in zip(self.token_sets, split)])
        self.by_order = [" ".join(sorted(t)) for t in split]
        self.bags = np.zeros((len(names), len(self.plain.alphabet)), dtype=np.int32)
        for codes, start in zip(self.plain.columns, self.plain.first_longer):
            np.add.at(self.bags, (self.plain.order[start:], codes), 1)

    def best(self, name: str, floor: float = 0.0) -> tuple[int, float]:
        """Position and score of the best name; below `floor` the score is only a lower bound."""
        if not name:
            return 0, 0.0
        if len(self.names) <= self.SMALL:
            scores = np.array([wratio(name, other) for other in self.names])
            return int(scores.argmax()), float(scores.max())
        lengths = self.plain.lengths
        total = lengths + len(name)
        common = self.plain.lcs(name)
        exact = np.where(lengths > 0, 200.0 * common / total, 0.0)
        stretch = np.maximum(lengths, len(name)) / np.maximum(np.minimum(lengths, len(name)), 1)
        near = (stretch < LONG_RATIO) & (lengths > 0)
        far = (stretch >= LONG_RATIO) & (lengths > 0)
        tokens = name.split()
        by_order = " ".join(sorted(tokens))
        common_sorted = self.sorted.lcs(by_order)
        ordered = 200.0 * common_sorted / np.maximum(self.sorted.lengths + len(by_order), 1)
        exact = np.where(near, np.maximum(exact, TOKEN_WEIGHT * ordered), exact)

        shared_chars = np.zeros(len(self.names), dtype=np.int64)
        shared_count = np.zeros(len(self.names), dtype=np.int64)
        for token in set(tokens):
            rows = self.holders.get(token)
            if rows is not None:
                shared_chars[rows] += len(token)
                shared_count[rows] += 1
        shared = shared_chars + np.maximum(shared_count - 1, 0)

        weight = np.where(stretch <= LONG_RATIO_MAX, PARTIAL_WEIGHT, FAR_PARTIAL_WEIGHT)
        exact = np.where(far & (shared_count > 0), np.maximum(exact, 100 * TOKEN_WEIGHT * weight), exact)

        # Upper bounds of what is left to compute. A window's LCS is at most the
        # whole text's, and a window is at least as long as its LCS.
        mine = len(" ".join(set(tokens)))
        window = 200.0 * common / np.maximum(np.minimum(lengths, len(name)) + common, 1)
        by_token = 200.0 * common_sorted / np.maximum(np.minimum(self.set_sizes, mine) + common_sorted, 1)
        bound = weight * np.maximum(np.minimum(window, 100.0), TOKEN_WEIGHT * np.minimum(by_token, 100.0))
        shared_bag = np.minimum(self.bags, self._bag(name)).sum(axis=1)
        left = np.maximum(mine - shared - (shared_count > 0), 0)
        right = np.maximum(self.set_sizes - shared - (shared_count > 0), 0)
        sect = shared + (shared_count > 0)
        overlap = np.minimum(np.minimum(left, right), shared_bag)
        full = 200.0 * (sect + overlap) / np.maximum(2 * sect + left + right, 1)
        ends = 200.0 * shared / np.maximum(shared + sect + np.minimum(left, right), 1)
        subset = (shared_count > 0) & ((left == 0) | (right == 0))
        token_bound = np.where(subset, 100.0, np.maximum(full, np.where(shared_count > 0, ends, 0.0)))
        bound = np.where(near, TOKEN_WEIGHT * token_bound, np.where(far, bound, 0.0))

        # Texts longer than the name: all their windows at once.
        wins = lambda limit: (bound > exact + 1e-9) & (bound >= limit - 1e-9)
        long = far & (lengths > len(name)) & wins(max(floor, float(exact.max()))) & ~self.repeats
        rows = np.flatnonzero(long) if len(set(tokens)) == len(tokens) else []
        if len(rows):
            found = _best_windows(name, [self.names[r] for r in rows])
            apart = rows[shared_count[rows] == 0]
            exact[rows] = np.maximum(exact[rows], weight[rows] * found)
            if len(apart):
                token = _partial_rows(by_order, [self.by_order[r] for r in apart])
                exact[apart] = np.maximum(exact[apart], token * TOKEN_WEIGHT * weight[apart])
            bound[rows] = 0.0

        open_rows = np.flatnonzero(bound > exact + 1e-9)
        at = int(exact.argmax())
        top = float(exact[at])
        for row in open_rows[np.argsort(-bound[open_rows], kind="stable")]:
            if bound[row] < max(top, floor) - 1e-9:
                break
            score = wratio(name, self.names[row])
            if score > top or (score == top and row < at):
                at, top = int(row), score
        return at, top

    def _bag(self, name: str) -> np.ndarray:
        codes = np.frombuffer(name.encode("utf-32-le"), dtype=np.uint32)
        spots = np.searchsorted(self.plain.alphabet, codes)
        known = (spots < len(self.plain.alphabet))
        known[known] = self.plain.alphabet[spots[known]] == codes[known]
        return np.bincount(spots[known], minlength=len(self.plain.alphabet)).astype(np.int32)


class LevenshteinIndex:
    """The same search by edit distance; the score is its negative.

    An equal name ends the search. Otherwise the characters that one name has and the other
    lacks bound the distance from below: names are compared by rising bound, in growing
    groups, until the bound exceeds the best distance.
    """

    GROUP = 64

    def __init__(self, names: list[str]):
        self.names = names
        self.first = {n: i for i, n in reversed(list(enumerate(names)))}
        column = TextColumn(names)
        self.alphabet = column.alphabet
        self.bags = np.zeros((len(self.alphabet), len(names)), dtype=np.int32)
        for codes, start in zip(column.columns, column.first_longer):
            np.add.at(self.bags, (codes, column.order[start:]), 1)
        self.lengths = column.lengths

    def best(self, name: str, floor: float = 0.0) -> tuple[int, float]:
        if name in self.first:
            return self.first[name], -0.0
        shared = np.zeros(len(self.names), dtype=np.int64)
        for char, times in Counter(name).items():
            row = int(np.searchsorted(self.alphabet, ord(char)))
            if row < len(self.alphabet) and self.alphabet[row] == ord(char):
                shared += np.minimum(self.bags[row], times)
        bound = np.maximum(self.lengths, len(name)) - shared
        order = np.argsort(bound, kind="stable")
        at, least, begin, group = -1, int(bound.max()) + len(name) + 1, 0, self.GROUP
        while begin < len(order) and bound[order[begin]] <= least:
            rows = order[begin:begin + group]
            rows = np.sort(rows[bound[rows] <= least])
            distance = TextColumn([self.names[i] for i in rows]).edits(name)
            near = int(distance.argmin())
            if (distance[near], rows[near]) < (least, at) or at < 0:
                at, least = int(rows[near]), int(distance[near])
            begin, group = begin + group, group * 4
        return at, -float(least)


@F.pandas_udf(T.DoubleType())
def wratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([wratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
