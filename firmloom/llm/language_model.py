"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and read through memory maps.

Words are 64-bit hashes. A model is a folder of sorted arrays in the shared folder:

1. Tasks send the distinct words of their texts with counts, by range of the hash.
   Each range is merged and written as a sorted array; a word's id is its place.
2. Tasks look ids up in these arrays and send their distinct pairs of ids as sorted
   runs, packed as differences, by range of the first word and part of the second.
   Each range is merged and written; it gives the sums of each context, the number of
   different words before each word, and the counts of counts for the discounts.
3. The sums meet by word and are written as arrays by id.

Order 3 first writes the pairs of step 2 without counts; a pair's id is its place. The
triples are counted by range of their first pair, as followers and counts of each pair.
Every range sends the pairs (v, w) of its distinct triples (u, v, w) with the number of
their u, and step 2's merge takes these instead of raw counts.

Only the numbers of a range and the counts of counts reach the driver. Workers map
the arrays and look up a batch's distinct, sorted words and pairs range by range.
Files carry fresh names and count only if the manifest names them, so a lost or
repeated task does no harm.

A text is a sequence of words between two document ends; the closing end is a token.
P(w | u) = (max(c(uw) - D, 0) + (D1 N1 + D2 N2 + D3 N3+)(u) P(w)) / c(u), with P(w) the
same of continuation counts over 1 / (V + 1), the chance of any unknown word. An
unknown context passes on to P(w). At order 3, P(w | uv) is the same of the raw counts over
P(w | v), whose counts are continuation counts; before a text stand two document ends.

Defined cases: a null or empty text has the end as its only token; a null id has the
checksum of the empty string; without training rows all chances are 1; repeated rows
count as often as they occur; ties need no rule; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmloom.llm.array_store import forget, make_folder, mapped, write_array
from firmloom.llm.common import shared_path, stage, text_of
from firmloom.llm.shingles import batch_words, mix

END = mix(np.array([0xE0D], np.uint64))
FLUSH = 1 << 20
SPLIT = 4
"""A context's pairs go to this many ranges by their second word, so that a frequent word is shared."""


def _binary(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences in the fewest bytes that hold the largest, that number first."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(steps[1:].max() if len(steps) > 1 else 0).bit_length() // 8))
    first = np.array(steps[:1], "<u8").tobytes()
    return bytes([width]) + first + steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width, first = data[0], np.frombuffer(data[1:9], "<u8")
    wide = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate((first, wide.view("<u8").ravel())), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest, that number first."""
    width = next(w for w in (1, 2, 4, 8) if counts.max() < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64)


def write_counts(folder: str, counts: np.ndarray) -> str:
    """One byte a count; those of 255 and more follow with their places."""
    large = np.flatnonzero(counts >= 255)
    parts = [np.minimum(counts, 255).astype("u1"), large.astype("<u8"), counts[large].astype("<u8")]
    return ",".join(write_array(folder, x) for x in parts)


def read_counts(folder: str, names: str, at: np.ndarray) -> np.ndarray:
    small, places, large = names.split(",")
    out = mapped(folder, small, "u1")[at].astype(np.uint64)
    over = np.flatnonzero(out == 255)
    if len(over):
        out[over] = mapped(folder, large, "<u8")[np.searchsorted(mapped(folder, places, "<u8"), at[over].astype(np.uint64))]
    return out


def _by_part(keys: np.ndarray, counts: np.ndarray, parts: np.ndarray, ranges: int) -> list[tuple[int, bytes, bytes]]:
    """Packed runs of sorted keys for each part."""
    order = np.argsort(parts, kind="stable")
    at = np.searchsorted(parts[order], np.arange(ranges + 1))
    cells = [order[at[p]:at[p + 1]] for p in range(ranges)]
    return [(p, pack(keys[mine]), pack_counts(counts[mine])) for p, mine in enumerate(cells) if len(mine)]


def _sequences(batch: pa.RecordBatch, before: int = 1) -> Iterator[np.ndarray]:
    """Each text's words with the document end before and after."""
    for words in batch_words(batch.column("text")):
        yield np.concatenate((*[END] * before, words, END))


@dataclass
class Words:
    """The unigram arrays: where each range lies and how many ids come before it."""

    folder: str
    bits: int
    hashes: list[str]
    counts: list[str]
    base: np.ndarray
    total: int

    @property
    def size(self) -> int:
        return int(self.base[-1])

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Ids of sorted words, -1 for unknown ones."""
        out = np.full(len(words), -1, np.int64)
        cuts = np.searchsorted(words >> np.uint64(64 - self.bits), np.arange(len(self.hashes) + 1, dtype=np.uint64))
        for r, name in enumerate(self.hashes):
            part = words[cuts[r]:cuts[r + 1]]
            if name and len(part):
                known = mapped(self.folder, name, "<u8")
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                out[cuts[r]:cuts[r + 1]] = np.where(known[at] == part, at + self.base[r], -1)
        return out

    def take(self, names: list[str], dtype: str, ids: np.ndarray) -> np.ndarray:
        """Values of a by-id array at sorted ids; 0 for id -1."""
        out = np.zeros(len(ids), dtype)
        cuts = np.searchsorted(ids, self.base)
        for r, name in enumerate(names):
            part = ids[cuts[r]:cuts[r + 1]]
            if name and len(part):
                out[cuts[r]:cuts[r + 1]] = mapped(self.folder, name, dtype)[part - self.base[r]]
        return out


def count_words(docs: DataFrame, folder: str, bits: int) -> Words:
    """Write the sorted words of `docs` (column text) and their counts."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def cut():
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(words >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = [(r, pack(words[at[r]:at[r + 1]]), pack_counts(counts[at[r]:at[r + 1]])) for r in range(1 << bits) if at[r] < at[r + 1]]
            return _binary(rows, ["part", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()])

        for batch in batches:
            for words in _sequences(batch):
                held.append(words[1:])
                size += len(words)
                if size >= FLUSH:
                    yield cut()
                    held, size = [], 0
        if held:
            yield cut()

    def write(group: pa.Table) -> pa.Table:
        words, counts = _merge(
            np.concatenate([unpack(x) for x in group.column("keys").to_pylist()]),
            np.concatenate([unpack_counts(x) for x in group.column("counts").to_pylist()]))
        return pa.table({
            "part": group.column("part")[:1], "types": [len(words)], "tokens": [int(counts.sum())],
            "hashes": [write_array(folder, words.astype("<u8"))], "counted": [write_array(folder, counts.astype("<u8"))]})

    rows = stage(docs.mapInArrow(runs, "part int, keys binary, counts binary").groupBy("part").applyInArrow(
        write, "part int, types bigint, tokens bigint, hashes string, counted string"), "words").collect()
    by = {r.part: r for r in rows}
    every = range(1 << bits)
    return Words(
        folder, bits, [by[r].hashes if r in by else "" for r in every], [by[r].counted if r in by else "" for r in every],
        np.cumsum([0, *(by[r].types if r in by else 0 for r in every)]), sum(r.tokens for r in rows))


def discounts(counts: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2:
        return [0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1)]


@dataclass
class Pairs:
    """The sorted pairs: where each range lies and how many ids come before it."""

    words: Words
    keys: list[str]
    base: np.ndarray

    def ids(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Ids of pairs of known words in any order, -1 for unknown pairs."""
        out = np.full(len(first), -1, np.int64)
        keys, parts = first.astype(np.uint64) * np.uint64(max(self.words.size, 1)) + second.astype(np.uint64), _part(self.words, first, second)
        order = np.lexsort((keys, parts))
        cuts = np.searchsorted(parts[order], np.arange(len(self.keys) + 1))
        for p, name in enumerate(self.keys):
            mine = order[cuts[p]:cuts[p + 1]]
            if name and len(mine):
                known = mapped(self.words.folder, name, "<u8")
                at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
                out[mine] = np.where(known[at] == keys[mine], at + self.base[p], -1)
        return out


@dataclass
class Triples:
    """Followers of each pair: by range of the pair, starts, words and counts, and the sums of each pair."""

    pairs: Pairs
    starts: list[str]
    words: list[str]
    counts: list[str]
    sums: list[tuple[str, ...]]
    discounts: list[float]

    def find(self, pairs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the known pairs `pairs` and counts of `words`, -1 for unknown, behind them."""
        folder = self.pairs.words.folder
        sums, out = np.zeros(len(pairs), CONTEXT), np.zeros(len(pairs), np.uint64)
        order = np.argsort(pairs, kind="stable")
        cuts = np.searchsorted(pairs[order], self.pairs.base)
        for p, name in enumerate(self.starts):
            mine = order[cuts[p]:cuts[p + 1]]
            if name and len(mine):
                at, want = pairs[mine] - self.pairs.base[p], words[mine]
                for field, names in zip(CONTEXT.names, self.sums[p], strict=True):
                    sums[field][mine] = read_counts(folder, names, at)
                starts, follow = mapped(folder, name, "<u4"), mapped(folder, self.words[p], "<u4")
                low, end = starts[at].astype(np.int64), starts[at + 1].astype(np.int64)
                high = end.copy()
                while (open_ := low < high).any():
                    middle = (low + high) // 2
                    less = open_ & (follow[np.minimum(middle, len(follow) - 1)] < want)
                    low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
                found = np.flatnonzero(low < end)
                found = found[follow[low[found]] == want[found]]
                out[mine[found]] = read_counts(folder, self.counts[p], low[found])
        return sums, out


@dataclass
class Bigrams:
    """The whole model."""

    words: Words
    keys: list[str]
    counts: list[str]
    contexts: list[str]
    befores: list[str]
    pair_discounts: list[float]
    word_discounts: list[float]
    pair_types: int
    word_classes: list[int]
    triples: Triples | None = None

    def parts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return _part(self.words, first, second)

    def pair_counts(self, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Counts of pairs; keys in any order."""
        out = np.zeros(len(keys), np.uint64)
        order = np.lexsort((keys, parts))
        cuts = np.searchsorted(parts[order], np.arange(len(self.keys) + 1))
        for p, name in enumerate(self.keys):
            mine = order[cuts[p]:cuts[p + 1]]
            if name and len(mine):
                known = mapped(self.words.folder, name, "<u8")
                at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
                found = known[at] == keys[mine]
                out[mine[found]] = read_counts(self.words.folder, self.counts[p], at[found])
        return out


    def pairs_of(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, -1 for unknown ones, and counts of pairs of word ids, -1 for unknown ones; each distinct pair is looked up once."""
        pairs, size = self.triples.pairs, np.uint64(max(self.words.size, 1))
        ids, counts = np.full(len(first), -1, np.int64), np.zeros(len(first), np.uint64)
        known = np.flatnonzero((first >= 0) & (second >= 0))
        distinct, place = np.unique(first[known].astype(np.uint64) * size + second[known].astype(np.uint64), return_inverse=True)
        found = pairs.ids((distinct // size).astype(np.int64), (distinct % size).astype(np.int64))
        order = np.argsort(found, kind="stable")
        cuts, seen = np.searchsorted(found[order], pairs.base), np.zeros(len(distinct), np.uint64)
        for p, names in enumerate(self.counts):
            mine = order[cuts[p]:cuts[p + 1]]
            if names and len(mine):
                seen[mine] = read_counts(self.words.folder, names, found[mine] - pairs.base[p])
        ids[known], counts[known] = found[place], seen[place]
        return ids, counts


CONTEXT = np.dtype([("count", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])


def _part(words: Words, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Range of a pair of ids: by the range of the first word, split by that of the second."""
    of = lambda ids: np.searchsorted(words.base, ids, side="right") - 1
    ranges = 1 << words.bits
    return of(first) // SPLIT * SPLIT + of(second) * SPLIT // ranges


def _gram_runs(words: Words, folder: str, before: int, pairs: Pairs | None = None):
    """mapInArrow function: packed runs of the texts' pairs; with `pairs` of their triples, by range of the first pair."""
    size, ranges, width = np.uint64(max(words.size, 1)), 1 << words.bits, 2 if pairs is None else 3

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(folder)
        held, total = [], 0

        def cut():
            flat = np.concatenate(held)
            distinct, place = np.unique(flat, return_inverse=True)
            ids = words.ids(distinct)[place]
            inner = np.ones(len(flat) - width + 1, bool)
            for back in range(1, width):
                inner[np.cumsum([len(x) for x in held])[:-1] - back] = False
            first, last = ids[:len(inner)][inner], ids[width - 1:][inner]
            if pairs is not None:
                both, place = np.unique(first.astype(np.uint64) * size + ids[1:-1][inner].astype(np.uint64), return_inverse=True)
                first = pairs.ids((both // size).astype(np.int64), (both % size).astype(np.int64))[place]
            keys, counts = np.unique(first.astype(np.uint64) * size + last.astype(np.uint64), return_counts=True)
            first, last = (keys // size).astype(np.int64), (keys % size).astype(np.int64)
            parts = _part(words, first, last) if pairs is None else np.searchsorted(pairs.base, first, side="right") - 1
            return _binary(_by_part(keys, counts, parts, ranges), ["part", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()])

        for batch in batches:
            for sequence in _sequences(batch, before):
                held.append(sequence)
                total += len(sequence)
                if total >= FLUSH:
                    yield cut()
                    held, total = [], 0
        if held:
            yield cut()

    return runs


RUNS = "part int, keys binary, counts binary"


def _merged_runs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _merge(
        np.concatenate([unpack(x) for x in group.column("keys").to_pylist()]),
        np.concatenate([unpack_counts(x) for x in group.column("counts").to_pylist()]))


def number_pairs(docs: DataFrame, words: Words, folder: str) -> Pairs:
    """Write the sorted pairs of `docs`, two document ends before each text."""

    def write(group: pa.Table) -> pa.Table:
        keys, _ = _merged_runs(group)
        return pa.table({"part": group.column("part")[:1], "types": [len(keys)], "keys": [write_array(folder, keys.astype("<u8"))]})

    rows = stage(docs.mapInArrow(_gram_runs(words, folder, 2), RUNS).groupBy("part").applyInArrow(
        write, "part int, types bigint, keys string"), "pair_ids").collect()
    by, every = {r.part: r for r in rows}, range(1 << words.bits)
    return Pairs(words, [by[r].keys if r in by else "" for r in every], np.cumsum([0, *(by[r].types if r in by else 0 for r in every)]))


def count_triples(docs: DataFrame, pairs: Pairs, folder: str) -> tuple[Triples, DataFrame]:
    """The triples, and runs of the pairs (v, w) with the number of different words before them."""
    words = pairs.words
    size, ranges = np.uint64(max(words.size, 1)), 1 << words.bits

    def write(group: pa.Table) -> pa.Table:
        forget(folder)
        part = int(group.column("part")[0].as_py())
        keys, counts = _merged_runs(group)
        first, last = (keys // size).astype(np.int64) - pairs.base[part], (keys % size).astype(np.int64)
        many = int(pairs.base[part + 1] - pairs.base[part])
        starts = np.searchsorted(first, np.arange(many + 1))
        sums = [np.bincount(first, weights=x, minlength=many).astype(np.uint64) for x in (counts, counts == 1, counts == 2, counts > 2)]
        names = [write_array(folder, starts.astype("<u4")), write_array(folder, last.astype("<u4")), write_counts(folder, counts),
                 *(write_counts(folder, x) for x in sums)]
        rows = [("triples", part, None, None, names, [int((counts == k).sum()) for k in range(1, 5)])]
        middle = mapped(folder, pairs.keys[part], "<u8")[first] % size
        after, befores = np.unique(middle * size + last.astype(np.uint64), return_counts=True)
        parts = _part(words, (after // size).astype(np.int64), (after % size).astype(np.int64))
        rows += [("pairs", p, k, c, None, None) for p, k, c in _by_part(after, befores, parts, ranges)]
        return pa.Table.from_batches([_binary(
            rows, ["kind", "part", "keys", "counts", "names", "totals"],
            [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())])])

    merged = stage(docs.mapInArrow(_gram_runs(words, folder, 2, pairs), RUNS).groupBy("part").applyInArrow(
        write, f"kind string, {RUNS}, names array<string>, totals array<bigint>"), "triples")
    by = {r.part: r for r in merged.filter("kind = 'triples'").select("part", "names", "totals").collect()}
    names = [by[r].names if r in by else [""] * 7 for r in range(ranges)]
    totals = np.sum([r.totals for r in by.values()], axis=0).tolist() if by else [0] * 4
    found = Triples(pairs, *([n[i] for n in names] for i in range(3)), [tuple(n[3:]) for n in names], discounts(totals))
    return found, merged.filter("kind = 'pairs'").select("part", "keys", "counts")


def count_pairs(docs: DataFrame, words: Words, folder: str, order: int = 2) -> Bigrams:
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    size, ranges = np.uint64(max(words.size, 1)), 1 << words.bits
    pairs, triples = None, None
    if order == 2:
        runs = docs.mapInArrow(_gram_runs(words, folder, 1), RUNS)
    else:
        pairs = number_pairs(docs, words, folder)
        triples, runs = count_triples(docs, pairs, folder)

    def write(group: pa.Table) -> pa.Table:
        """The range's pair arrays, and its share of every word's sums by range of the word."""
        forget(folder)
        part = int(group.column("part")[0].as_py())
        keys, counts = _merged_runs(group)
        if pairs is None:
            names = write_array(folder, keys.astype("<u8")), write_counts(folder, counts)
        else:  # the pairs have been written; that of two document ends may have no count
            known = mapped(folder, pairs.keys[part], "<u8")
            whole = np.zeros(len(known), np.uint64)
            whole[np.searchsorted(known, keys)] = counts
            names = pairs.keys[part], write_counts(folder, whole)
        first, second = keys // size, (keys % size).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        sums = np.zeros(len(starts), CONTEXT)
        sums["count"] = np.add.reduceat(counts, starts)
        for name, holds in (("n1", counts == 1), ("n2", counts == 2), ("n3", counts > 2)):
            sums[name] = np.add.reduceat(holds.astype(np.uint32), starts)
        rows = [("pairs", part, *names, None, None,
                 [len(keys), *(int((counts == k).sum()) for k in range(1, 5))])]
        befores, many = np.unique(second, return_counts=True)
        for kind, ids, values in (("context", first[starts].astype(np.int64), sums), ("before", befores, many.astype("<u4"))):
            at = np.searchsorted(ids, words.base)
            for r in np.flatnonzero(np.diff(at)):
                own = slice(at[r], at[r + 1])
                rows.append((kind, int(r), None, None, pack(ids[own].astype(np.uint64)), values[own].tobytes(), None))
        return pa.Table.from_batches([_binary(
            rows, ["kind", "part", "keys", "counted", "ids", "values", "totals"],
            [pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64())])])

    def sum_up(group: pa.Table) -> pa.Table:
        """One by-id array of a range of words."""
        kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
        dtype = CONTEXT if kind == "context" else np.dtype("<u4")
        out = np.zeros(int(words.base[part + 1] - words.base[part]), dtype)
        for ids, values in zip(group.column("ids").to_pylist(), group.column("values").to_pylist(), strict=True):
            at, more = unpack(ids).astype(np.int64) - int(words.base[part]), np.frombuffer(values, dtype)
            for name in dtype.names or [None]:
                target, add = (out[name], more[name]) if name else (out, more)
                target[at] += add
        classes = [int((out == k).sum()) for k in range(1, 5)] + [int((out > 2).sum())] if kind == "before" else None
        return pa.table({
            "kind": [kind], "part": pa.array([part], pa.int32()), "name": [write_array(folder, out)],
            "totals": pa.array([classes], pa.list_(pa.int64()))})

    merged = stage(runs.groupBy("part").applyInArrow(
        write, "kind string, part int, keys string, counted string, ids binary, values binary, totals array<bigint>"), "pairs")
    ends = {r.part: r for r in merged.filter("kind = 'pairs'").select("part", "keys", "counted", "totals").collect()}
    arrays = stage(merged.filter("kind <> 'pairs'").groupBy("kind", "part").applyInArrow(
        sum_up, "kind string, part int, name string, totals array<bigint>"), "sums").collect()
    named = {(r.kind, r.part): r.name for r in arrays}
    totals = np.sum([r.totals for r in ends.values()], axis=0).tolist() if ends else [0] * 5
    classes = np.sum([r.totals for r in arrays if r.kind == "before"], axis=0).tolist() if ends else [0] * 5
    every = range(ranges)
    return Bigrams(
        words, [ends[r].keys if r in ends else "" for r in every], [ends[r].counted if r in ends else "" for r in every],
        [named.get(("context", r), "") for r in every], [named.get(("before", r), "") for r in every],
        discounts(totals[1:]), discounts(classes[:4]), totals[0], [classes[0], classes[1], classes[4]], triples)


def train(docs: DataFrame, text_column: str = "text", bits: int | None = None, order: int = 2) -> Bigrams:
    """Count the texts of `docs`. 2^bits ranges; by default about one for each shuffle partition."""
    spark: SparkSession = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    if bits is None:
        bits = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())
    folder = shared_path(spark, "model")
    make_folder(folder)
    texts = docs.select(text_of(text_column).alias("text"))
    return count_pairs(texts, count_words(texts, folder, bits), folder, order)


def _discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def score_sequences(model: Bigrams, sequences: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Per sequence n_tokens, n_known, base_score and score."""
    words = model.words
    flat = np.concatenate(sequences)
    distinct, place = np.unique(flat, return_inverse=True)
    ids = words.ids(distinct)
    order = np.argsort(ids, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    take = lambda names, dtype: words.take(names, dtype, ids[order])[back]
    counts = take(words.counts, "<u8").astype(np.float64)
    context = take(model.contexts, CONTEXT)
    before = take(model.befores, "<u4").astype(np.float64)

    lengths = np.array([len(x) for x in sequences])
    ends = np.cumsum(lengths)
    token = np.ones(len(flat), bool)
    token[ends - lengths] = False
    second = np.flatnonzero(token)
    w, u = place[second], place[second - 1]
    base = np.log10((counts + 0.5) / (words.total + 0.5 * (words.size + 1)))
    if model.pair_types:
        rest = sum(d * n for d, n in zip(model.word_discounts, model.word_classes, strict=True))
        lower = (_discounted(before, model.word_discounts) + rest / (words.size + 1)) / model.pair_types
    else:
        lower = np.ones(len(distinct))
    chance = lower[w]
    seen = context["count"][u] > 0
    if model.triples is not None:
        pair_id, pair = model.pairs_of(ids[u], ids[w])
        pair = pair.astype(np.float64)
    elif seen.any():
        both = seen & (ids[w] >= 0)
        pair = np.zeros(len(w))
        first_id, second_id = ids[u[both]], ids[w[both]]
        keys = first_id.astype(np.uint64) * np.uint64(max(words.size, 1)) + second_id.astype(np.uint64)
        pair[both] = model.pair_counts(keys, model.parts(first_id, second_id))
    if seen.any():
        about = context[u[seen]]
        left = sum(d * about[n].astype(np.float64) for d, n in zip(model.pair_discounts, ("n1", "n2", "n3"), strict=True))
        chance[seen] = (_discounted(pair[seen], model.pair_discounts) + left * lower[w[seen]]) / about["count"]
    if model.triples is not None:
        # The context of a word is the pair before it, at a text's beginning that of two document ends.
        end = words.ids(END)[:1]
        opening = np.concatenate(([0], np.cumsum(lengths - 1)[:-1]))
        before_it = np.concatenate(([-1], pair_id[:-1]))
        before_it[opening] = model.pairs_of(end, end)[0][0]
        known = np.flatnonzero(before_it >= 0)
        about, count = model.triples.find(before_it[known], ids[w[known]])
        known, about, count = (x[about["count"] > 0] for x in (known, about, count))
        left = sum(d * about[n].astype(np.float64) for d, n in zip(model.triples.discounts, ("n1", "n2", "n3"), strict=True))
        chance[known] = (_discounted(count.astype(np.float64), model.triples.discounts) + left * chance[known]) / about["count"]
    at = np.concatenate(([0], np.cumsum(lengths - 1)[:-1]))
    return {
        "n_tokens": lengths - 1, "n_known": np.add.reduceat((counts[w] > 0).astype(np.int64), at),
        "base_score": np.add.reduceat(base[w], at), "score": np.add.reduceat(np.log10(chance), at)}


def score(docs: DataFrame, model: Bigrams, keep: tuple[str, ...] = (), text_column: str = "text") -> DataFrame:
    """Columns `keep` with n_tokens, n_known, train_tokens, base_score, score of each text."""
    total, folder = model.words.total, model.words.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = score_sequences(model, list(_sequences(batch)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(found["n_tokens"], pa.int64()), pa.array(found["n_known"], pa.int64()),
                 pa.array(np.full(batch.num_rows, total), pa.int64()), pa.array(found["base_score"]), pa.array(found["score"])],
                names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(*keep, text_of(text_column).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    return rows.mapInArrow(
        run, f"{kinds}{', ' if keep else ''}n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out(id_column: str = "doc_id"):
    """Rows that are scored but not learnt from: checksum of the id mod 5 is 1."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def train_and_score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = 2) -> DataFrame:
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    model = train(rows.filter(~F.col("held_out")), order=order)
    return score(rows, model, ("doc_id", "held_out"))
