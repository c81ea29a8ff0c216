"""Ranked lexical search over bit-sliced Bloom signatures.

Index. A document's signature is a Bloom filter of its terms. A term that occurs often
also enters it once for each level of `LEVELS` that its count reaches, so a signature
tells roughly how often a term occurs. Documents of like size stand together in blocks, each
with a width of its own, and a block is stored bit-sliced: one bitmap over its documents
per signature bit. The AND of a term's slices holds every document with the term, and some
others.

Bounds. Per block, item and level the slices of the item's terms are summed by the terms'
weights; the sum times the most that a count below the next level adds in a document
of that length gives an upper bound of the score. Nothing but bitmaps and
lengths is read.

Search. The documents of the highest bounds are scored exactly; the last of the best
`top` is a floor that the answer cannot fall below. Then every document whose bound
reaches the floor is scored exactly from its whole text, so wide or full signatures cost
time, never rows. Both passes run over all blocks of the index.

The items are the query set. They are taken in blocks of at most `most_terms` terms (an
item with more is a block of its own), and only such a block is sent to the tasks.

Defined cases: null or empty texts, and texts without a term, match nothing and count
nowhere; an item without terms has no rows; equal scores go by id, null ids last; rows
that repeat are ranked each, items that repeat are each answered; very long texts are counted
whole, and their signatures end at `most_bits`, which only raises bounds; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmloom.llm.common import broadcast_if_small, stage, text_of
from firmloom.llm.shingles import mix, texts_of

#: Byte by byte: 0-9, a-z and all above 0x7F are of a term, A-Z become a-z, the rest is a border.
TERM_BYTES = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
LEVELS = np.array([1, 2, 3, 4, *(k << s for s in range(1, 14) for k in (3, 4))], np.int64)  # 1, 2, 3, 4, 6, 8, 12, 16, ...
FULL = 10**6  # no count adds more than this, times its weight
HASHES = 4
DOCS_A_BLOCK, BITS_A_BLOCK, CELLS = 512, 1 << 26, 1 << 21
_U = np.uint64
_LEVEL = 0x9E3779B97F4A7C15

INDEX = "width int, keys array<bigint>, lengths array<bigint>, slices binary, terms array<int>, seen array<bigint>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def term_hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def level_hashes(hashes: np.ndarray, level: int) -> np.ndarray:
    return mix(hashes + _U((level + 1) * _LEVEL % 2**64))


def places(hashes: np.ndarray, width: int) -> np.ndarray:
    """The `HASHES` signature bits of every hash, one row a hash."""
    step = (hashes >> _U(32)) | _U(1)
    return ((hashes[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % _U(width)).astype(np.int64)


def saturation(tf, length_factor):
    """What a count adds per weight, at this length."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * length_factor)


def length_factors(lengths, documents: int, words: int):
    return 10 + 90 * lengths * documents // words


class Items:
    """A block of items as it is sent to the tasks: their terms, and which terms each has."""

    def __init__(self, texts: list[set[bytes]]):
        self.terms = sorted(set().union(*texts))
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.of = [np.array(sorted(self.place[t] for t in terms), np.int64) for terms in texts]
        self.hashes = term_hashes(self.terms)


class Weights:
    """Corpus statistics for a block of items."""

    def __init__(self, items: Items, documents: int, words: int, df: dict[int, int]):
        self.documents, self.words = documents, words
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(items.terms))], np.int64)


# --- Index ----------------------------------------------------------------

def build_index(rows: DataFrame, items, bits_a_key: int = 16, most_bits: int = 1 << 22) -> DataFrame:
    """The index of `rows` (key, text): blocks, and how many documents hold each term of the items."""

    def block(held: list, width: int) -> tuple:
        grid = np.zeros((width, -(-len(held) // 8) * 8), bool)
        for i, (_, _, hashes) in enumerate(held):
            grid[places(hashes, width).ravel(), i] = True
        return (width, [h[0] for h in held], [h[1] for h in held], np.packbits(grid, axis=1).tobytes(), None, None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["width", "keys", "lengths", "slices", "terms", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = items.value.place
        seen, held = np.zeros(len(wanted), np.int64), {}
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), texts_of(batch.column("text")), strict=True):
                counts = Counter(terms_of(text.tobytes()))
                if not counts:
                    continue
                seen[[wanted[t] for t in counts.keys() & wanted.keys()]] += 1
                hashes, tf = term_hashes(counts), np.fromiter(counts.values(), np.int64, len(counts))
                levels = [level_hashes(hashes[tf >= t], i) for i, t in enumerate(LEVELS) if t <= tf.max()]
                entries = np.concatenate(levels)
                width = min(most_bits, bits_a_key << max(5, (len(entries) - 1).bit_length()))
                held.setdefault(width, []).append((key, int(tf.sum()), entries))
                if len(held[width]) >= max(8, min(DOCS_A_BLOCK, BITS_A_BLOCK // width)):
                    yield batch_of([block(held.pop(width), width)])
        for width, rest in held.items():
            yield batch_of([block(rest, width)])
        if seen.any():
            at = np.flatnonzero(seen)
            yield batch_of([(0, None, None, None, at.tolist(), seen[at].tolist())])

    return stage(rows.mapInArrow(run, INDEX), "signatures")


def weigh(index: DataFrame, items: Items) -> Weights | None:
    """The statistics, or None where no document has a term."""
    total = index.filter("width > 0").agg(
        F.sum(F.size("keys")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("words")).first()
    if not total.n:
        return None
    df = index.filter("width = 0").select(F.explode(F.arrays_zip("terms", "seen")).alias("z")).groupBy("z.terms").agg(F.sum("z.seen").alias("df"))
    return Weights(items, total.n, total.words, dict(map(tuple, df.collect())))


# --- Bounds ---------------------------------------------------------------

def bounds(items: Items, weights: Weights, width: int, lengths: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Upper bound of the score of every item (row) for every document of a block (column)."""
    docs, factor = len(lengths), length_factors(lengths, weights.documents, weights.words)
    out = np.zeros((len(items.of), docs), np.int64)
    present = np.full((len(items.terms), slices.shape[1]), 255, np.uint8)
    active, below = np.arange(len(items.terms)), np.zeros(docs, np.int64)
    for level in range(len(LEVELS)):
        at = places(level_hashes(items.hashes[active], level), width)
        bits = present[active]
        for k in range(HASHES):
            bits &= slices[at[:, k]]
        kept = bits.any(axis=1)
        present[active] = bits
        active = active[kept]
        if not len(active):
            break
        above = saturation(LEVELS[level + 1] - 1, factor) if level + 1 < len(LEVELS) else np.full(docs, FULL, np.int64)
        rise, below = above - below, above
        lines = np.zeros(len(items.terms), np.int64) - 1
        lines[active] = np.arange(len(active))
        weighted = np.unpackbits(bits[kept], axis=1, count=docs) * weights.weight[active].astype(np.int32)[:, None]
        mine = [lines[t] for t in items.of]
        mine = [m[m >= 0] for m in mine]
        at_once = max(1, CELLS // docs)
        first = 0
        while first < len(mine):
            last, size = first, 0
            while last < len(mine) and (last == first or size + len(mine[last]) <= at_once):
                size += len(mine[last])
                last += 1
            some = [i for i in range(first, last) if len(mine[i])]
            if some:
                starts = np.cumsum([0, *(len(mine[i]) for i in some[:-1])])
                sums = np.add.reduceat(weighted[np.concatenate([mine[i] for i in some])], starts, axis=0, dtype=np.int64)
                out[some] += sums * rise
            first = last
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """width, keys, lengths, slices of each block."""
    for batch in batches:
        for i in range(len(batch)):
            width = batch.column("width")[i].as_py()
            slices = np.frombuffer(batch.column("slices")[i].as_buffer(), np.uint8).reshape(width, -1)
            yield (width, batch.column("keys")[i].values.to_numpy(), batch.column("lengths")[i].values.to_numpy(), slices)


def _rows(item: np.ndarray, key: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(item.astype(np.int32)), pa.array(key.astype(np.int64)), pa.array(bound.astype(np.int64))], names=["item", "key", "bound"])


def highest_bounds(index: DataFrame, items, weights, most: int) -> DataFrame:
    """item, key, bound: each item's `most` documents of highest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, sent, n = None, items.value, len(items.value.of)
        keys = np.zeros((n, 0), np.int64)
        best = np.zeros((n, 0), np.int64)
        for width, names, lengths, slices in _blocks(batches):
            have = bounds(sent, weights.value, width, lengths, slices)
            best, keys = np.hstack([best, have]), np.hstack([keys, np.broadcast_to(names, have.shape)])
            if best.shape[1] > most:
                at = np.argpartition(-best, most - 1, axis=1)[:, :most]
                best, keys = np.take_along_axis(best, at, 1), np.take_along_axis(keys, at, 1)
        item, place = np.nonzero(best)
        yield _rows(item, keys[item, place], best[item, place])

    found = index.filter("width > 0").select("width", "keys", "lengths", "slices").mapInArrow(run, "item int, key bigint, bound bigint")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "key"))
    return found.withColumn("r", rank).filter(F.col("r") <= most).select("item", "key")


def reaching(index: DataFrame, items, weights, floors: np.ndarray) -> DataFrame:
    """item, key: the documents whose bound reaches the item's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, names, lengths, slices in _blocks(batches):
            have = bounds(items.value, weights.value, width, lengths, slices)
            item, place = np.nonzero(have >= floors[:, None])
            yield _rows(item, names[place], have[item, place])

    return index.filter("width > 0").select("width", "keys", "lengths", "slices").mapInArrow(
        run, "item int, key bigint, bound bigint").select("item", "key")


# --- Exact scores ---------------------------------------------------------

def exact_scores(rows: DataFrame, wanted: DataFrame, items, weights) -> DataFrame:
    """item, doc_id, score of the documents `wanted` (item, key), from their whole texts."""
    asked = stage(wanted.groupBy("key").agg(F.collect_set("item").alias("items")), "asked")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, stats = items.value, weights.value
        for batch in batches:
            item, line, score = [], [], []
            for i, (text, mine) in enumerate(zip(texts_of(batch.column("text")), batch.column("items").to_pylist(), strict=True)):
                counts = Counter(terms_of(text.tobytes()))
                length = length_factors(counts.total(), stats.documents, stats.words)
                have = {sent.place[t]: saturation(counts[t], length) for t in counts.keys() & sent.place.keys()}
                for k in mine:
                    item.append(k)
                    line.append(i)
                    score.append(sum(int(stats.weight[t]) * have[t] for t in sent.of[k].tolist() if t in have))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), batch.column("doc_id").take(pa.array(line, pa.int64())), pa.array(score, pa.int64())],
                names=["item", "doc_id", "score"])

    return rows.join(broadcast_if_small(asked), "key").select("doc_id", "text", "items").mapInArrow(
        run, f"item int, doc_id {kind}, score bigint")


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scores.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _answer(rows: DataFrame, texts: list[set[bytes]], top: int, seeds: int, signature: dict[str, int]) -> DataFrame | None:
    """item, rank, doc_id, score for one block of items."""
    context = rows.sparkSession.sparkContext
    block = Items(texts)
    items = context.broadcast(block)
    index = build_index(rows, items, **signature)
    found = weigh(index, block)
    if found is None:
        return None
    weights = context.broadcast(found)
    seeded = exact_scores(rows, stage(highest_bounds(index, items, weights, seeds), "seeds"), items, weights)
    last = _ranked(seeded, top).filter(F.col("rank") == top).select("item", "score").collect()  # one number an item
    floors = np.ones(len(block.of), np.int64)
    for item, score in last:
        floors[item] = score
    return _ranked(exact_scores(rows, stage(reaching(index, items, weights, floors), "reaching"), items, weights), top)


def search(
    docs: DataFrame, items: DataFrame, top: int = 10, seeds: int = 32, most_terms: int = 1_000_000,
    id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text",
    **signature: int,
) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of every item. `signature`: bits_a_key, most_bits."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"),
        F.xxhash64(F.col(id_column).cast("string"), text_of(text_column)).alias("key"))
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id_column].dataType
    schema = f"item_id {item_kind.simpleString()}, rank int, doc_id {kind}, score bigint"
    out, ids, texts, held = None, [], [], 0

    def answered() -> DataFrame | None:
        """The answers so far and those of the held items."""
        found = _answer(rows, texts, max(1, top), max(top, seeds), signature)
        if found is None:
            return out
        named = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {item_kind.simpleString()}")
        found = stage(found.join(named, "item").select("item_id", "rank", "doc_id", "score"), "answers")
        return found if out is None else out.unionByName(found)

    for row in items.select(F.col(item_id_column).alias("i"), F.col(item_text_column).alias("t")).toLocalIterator():
        terms = set(terms_of((row.t or "").encode()))
        if not terms:
            continue
        if texts and held + len(terms) > most_terms:
            out = answered()
            ids, texts, held = [], [], 0
        ids.append(row.i)
        texts.append(terms)
        held += len(terms)
    if texts:
        out = answered()
    return spark.createDataFrame([], schema) if out is None else out
