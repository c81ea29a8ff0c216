"""Hard-negative mining over an inverted multi-index.

Index. Vectors are cut into two halves, and each half has a codebook of its own; a
row's two codewords are its cell. Codebooks are fitted by k-means on at most `sample`
rows, drawn by a hash; every row is indexed. For each codeword the
radius, the largest distance of a row's half from it, is taken over all rows. A cell is
dealt into parts of at most `part_rows` rows, so a cell with a third of all rows is many parts.

Search. For an anchor q a cell's rows score at most the sum of its two half bounds,
q_h . c_h + |q_h| * radius(c_h). A heap walks the grid of both sorted half lists and gives the
cells by falling sum (the multi-sequence order). An anchor goes on until the next sum
lies below what it still lacks:

* positives: the score of its fifth same-label row so far;
* negatives: for each positive's window, the score of its fifth row in the window so far,
  or the window's lower end while there are fewer. A window ends where that is certified.

Sums equal to the score are still visited, because ties go by vec_id. So the answer is exact,
whatever the codebooks; they decide the work only. Anchors walk in rounds, each of twice
as many cells as the one before: a round sends (anchor, part) requests, tasks score a part
against at most `anchors_a_task` anchors at a time and return a few rows for each.
What grows is in tables: rows, requests and results; the codebooks, radii and counts
of the cells (at most `most_codes` squared) go to all tasks.

Components are floor(256 * x) as integers and scores are integers: products are taken
in doubles where every sum is below 2^53 and in 64-bit integers otherwise.

Defined cases: rows with a null label, vector or component, or one that is not finite,
take no part; a vector of no components scores 0; vectors of different lengths count as
zero beyond their end; ties go by smaller vec_id, null ids last, then by row; rows with
the same vec_id are rows of their own, each an anchor if the id says so; an anchor
without rows of its label has no positives, a window without rows no negatives; empty tables
give no rows; other columns, text among them, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmloom.llm.common import stage

NO_ID = 2**63 - 1  # stands for a null id, behind all others
SAFE = 2**52
ROWS = "row bigint, id bigint, label int, vector array<bigint>"
FIRST_CELLS = 8


class Rules(NamedTuple):
    anchors_by: int = 100
    relabel_by: int = 7
    labels: int = 10
    positives: int = 5
    negatives: int = 5
    low_percent: int = 80
    high_percent: int = 100


class Grid(NamedTuple):
    """What every task needs of the index."""

    codes: list[np.ndarray]  # two codebooks
    radii: list[np.ndarray]
    parts: dict[tuple[int, int], int]  # of the cells that have rows


def prepared(vectors: DataFrame, rules: Rules, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """row, id, label, vector (integers) and anchor of the rows that take part."""
    usable = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(label_column).cast("int").alias("label"),
        F.col(vector_column).cast("array<double>").alias("v")).filter("label is not null and v is not null").filter(usable)
    shifted = F.when(F.col("vec_id") % rules.relabel_by == 0, (F.col("label") + 1) % rules.labels).otherwise(F.col("label"))
    return stage(rows.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), shifted.alias("label"),
        F.transform("v", lambda x: F.floor(x * 256).cast("bigint")).alias("vector"),
        F.coalesce(F.col("vec_id") % rules.anchors_by == 0, F.lit(False)).alias("anchor")), "vectors")


# --- Index ----------------------------------------------------------------

def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as the rows of an integer matrix, shorter ones filled up with zeros."""
    values, offsets = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    if len(offsets) and (offsets == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(offsets), width), np.int64)
    out[np.repeat(np.arange(len(offsets)), offsets), np.arange(len(values)) - np.repeat(np.cumsum(offsets) - offsets, offsets)] = values
    return out


def halves(vectors: np.ndarray) -> list[np.ndarray]:
    cut = (vectors.shape[1] + 1) // 2
    return [vectors[:, :cut].astype(float), vectors[:, cut:].astype(float)]


def distances(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(1)[:, None] - 2 * points @ codes.T + (codes**2).sum(1)
    return np.sqrt(np.maximum(squares, 0))


def codebook(points: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    """k-means over the sample; starts from evenly spaced rows of it, sorted."""
    points = np.unique(points, axis=0)
    codes = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)]
    for _ in range(rounds):
        nearest = distances(points, codes).argmin(1)
        for k in range(len(codes)):
            if (nearest == k).any():
                codes[k] = points[nearest == k].mean(0)
    return codes


class Index:
    """The rows dealt to cells, and the grid."""

    def __init__(self, rows: DataFrame, sample: int, most_codes: int, cell_rows: int, part_rows: int):
        context = rows.sparkSession.sparkContext
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
        self.count, self.width = size.n, max(2, size.width or 0)
        self.empty = not self.count
        if self.empty:
            return
        width = self.width
        draw = F.xxhash64("vector", "row")
        drawn = rows.filter(F.abs(draw) % 1_000_000 < F.lit(min(1_000_000, 1 + 2_000_000 * sample // self.count)))
        taken = drawn.select("vector", draw.alias("draw"), "row").orderBy("draw", "row").limit(sample).select("vector").toArrow()
        points = halves(matrix(taken.column("vector").combine_chunks(), width))
        per_half = int(min(most_codes, max(1, round((self.count / cell_rows) ** 0.5))))
        codes = [codebook(p, per_half) for p in points]

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, apart = [], []
                for points, book in zip(halves(matrix(batch.column("vector"), width)), codes, strict=True):
                    far = distances(points, book)
                    found.append(far.argmin(1))
                    apart.append(far.min(1) if len(far) else np.empty(0))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(f, pa.int32()) for f in found), *(pa.array(a) for a in apart)],
                    names=[*batch.schema.names, "c0", "c1", "d0", "d1"])

        placed = stage(rows.select("row", "id", "label", "vector").mapInArrow(
            cells, f"{ROWS}, c0 int, c1 int, d0 double, d1 double"), "cells")
        seen = placed.groupBy("c0", "c1").agg(F.count("*").alias("n"), F.max("d0").alias("d0"), F.max("d1").alias("d1")).collect()
        radii = [np.zeros(len(c)) for c in codes]
        for r in seen:
            radii[0][r.c0], radii[1][r.c1] = max(radii[0][r.c0], r.d0), max(radii[1][r.c1], r.d1)
        parts = {(r.c0, r.c1): -(-r.n // part_rows) for r in seen}
        # Bounds are rounded up by far more than what the doubles above can be wrong.
        self.grid = context.broadcast(Grid(codes, [r * (1 + 1e-6) + 1e-3 for r in radii], parts))
        sizes = rows.sparkSession.createDataFrame([(*k, v) for k, v in parts.items()], "c0 int, c1 int, parts int")
        self.rows = stage(placed.join(F.broadcast(sizes), ["c0", "c1"]).select(
            "c0", "c1", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"), "row", "id", "label", "vector"), "parts")


def cell_order(grid: Grid, query: np.ndarray) -> Iterator[tuple[float, tuple[int, int]]]:
    """(bound, cell) by falling bound, from two sorted lists of half bounds and a heap."""
    lists = []
    for half, codes, radii in zip(halves(query[None, :]), grid.codes, grid.radii, strict=True):
        part = codes @ half[0] + np.linalg.norm(half[0]) * radii
        part += np.abs(part) * 1e-9 + 1e-6
        order = np.argsort(-part, kind="stable")
        lists.append((order, part[order]))
    (first, x), (second, y) = lists
    heap, pushed = [(-(x[0] + y[0]), 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        cell = (int(first[i]), int(second[j]))
        if cell in grid.parts:
            yield -bound, cell
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(x) and b < len(y) and (a, b) not in pushed:
                pushed.add((a, b))
                heapq.heappush(heap, (-(x[a] + y[b]), a, b))


def requests(index: Index, anchors: DataFrame, first: int, last: int, groups: int) -> DataFrame:
    """c0, c1, part, grp and the columns of `anchors` (row, label, vector, floor, ...): one row for each part to visit.

    Of the anchor's cells, those from `first` up to `last` in its order whose bound reaches `floor` (null: all).
    """
    grid, width, names = index.grid, index.width, anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, c0, c1, parts = [], [], [], []
            floors = batch.column("floor").to_pylist()
            for i, query in enumerate(matrix(batch.column("vector"), width)):
                for k, (bound, cell) in enumerate(cell_order(grid.value, query)):
                    if k >= last or floors[i] is not None and bound < floors[i]:
                        break
                    if k >= first:
                        for p in range(grid.value.parts[cell]):
                            lines.append(i)
                            c0.append(cell[0])
                            c1.append(cell[1])
                            parts.append(p)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int32()) for c in (c0, c1, parts)), *batch.take(pa.array(lines, pa.int64())).columns],
                names=["c0", "c1", "part", *names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    asked = anchors.mapInArrow(run, f"c0 int, c1 int, part int, {kinds}")
    return asked.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))


def scored(index: Index, asked: DataFrame, schema: str, choose) -> DataFrame:
    """What `choose(anchor table, part table, scores)` takes of every part and group of anchors that asked for it."""
    width, keys = index.width, ["c0", "c1", "part", "grp"]
    visits = asked.select(*[F.col(k).alias(k) for k in keys]).distinct()
    blocks = index.rows.join(visits, ["c0", "c1", "part"])

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, v = (matrix(t.column("vector").combine_chunks(), width) for t in (queries, rows))
        largest = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(v).max(initial=0))) * max(1, width)
        scores = (q.astype(float) @ v.T.astype(float)).astype(np.int64) if largest < SAFE else q @ v.T
        return choose(queries, rows, scores)

    return asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(run, schema)


def ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


# --- Mining ---------------------------------------------------------------

def _walk(index: Index, anchors: DataFrame, groups: int, schema: str, choose, keep, floors) -> DataFrame:
    """Rounds over the cells until no anchor asks for more.

    `keep` cuts what was found so far to what counts, `floors(found)` gives (row, floor) for
    the next round.
    """
    found, first, last = None, 0, FIRST_CELLS
    state = anchors
    while True:
        asked = stage(requests(index, state, first, last, groups), "requests")
        if asked.isEmpty():
            return found if found is not None else anchors.sparkSession.createDataFrame([], schema)
        new = scored(index, asked, schema, choose)
        found = stage(keep(new if found is None else found.unionByName(new)), "found")
        first, last = last, 3 * last
        state = anchors.drop("floor").join(floors(found), "row", "left")


def positives(index: Index, anchors: DataFrame, most: int, groups: int) -> DataFrame:
    """row (the anchor's), hit, hit_id, score: the best rows of the anchor's label."""

    def choose(queries: pa.Table, rows: pa.Table, scores: np.ndarray) -> pa.Table:
        own, label, row, ids = ints(queries, "row"), ints(queries, "label"), ints(rows, "row"), ints(rows, "id")
        labels, out = ints(rows, "label"), []
        for i in range(len(own)):
            at = np.flatnonzero((labels == label[i]) & (row != own[i]))
            best = at[np.lexsort((row[at], ids[at], -scores[i, at]))[:most]]
            out.append((np.full(len(best), own[i]), row[best], ids[best], scores[i, best]))
        return pa.table(dict(zip(("row", "hit", "hit_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "hit_id", "hit"))
    return _walk(
        index, anchors.select("row", "label", "vector").withColumn("floor", F.lit(None).cast("bigint")), groups,
        "row bigint, hit bigint, hit_id bigint, score bigint", choose,
        lambda found: found.withColumn("r", rank).filter(F.col("r") <= most).drop("r"),
        lambda found: found.groupBy("row").agg(F.when(F.count("*") >= most, F.min("score")).alias("floor")))


def negatives(index: Index, anchors: DataFrame, near: DataFrame, rules: Rules, groups: int) -> DataFrame:
    """row, high (the positive's score), hit, hit_id, score: the best rows of other labels in every window.

    Positives of one anchor with the same score share a window.
    """
    low = F.ceil(F.col("score") * rules.low_percent / 100)  # rounded in doubles: one less keeps it a bound
    windows = stage(near.select("row", F.col("score").alias("high"), (low.cast("bigint") - 1).alias("low")).distinct(), "windows")
    asking = windows.groupBy("row").agg(F.sort_array(F.collect_list("high")).alias("highs"), F.min("low").alias("floor"))
    most, low_percent, high_percent = rules.negatives, rules.low_percent, rules.high_percent

    def choose(queries: pa.Table, rows: pa.Table, scores: np.ndarray) -> pa.Table:
        own, label, highs = ints(queries, "row"), ints(queries, "label"), queries.column("highs").to_pylist()
        row, ids, labels = ints(rows, "row"), ints(rows, "id"), ints(rows, "label")
        out = [(np.empty(0, np.int64),) * 5]
        for i in range(len(own)):
            at = np.flatnonzero((labels != label[i]) & (high_percent * highs[i][-1] >= 100 * scores[i]))
            at = at[np.lexsort((row[at], ids[at], -scores[i, at]))]
            falling = scores[i, at]
            for high in highs[i]:
                # From the first score of at most the upper end as long as the lower end is kept.
                start = int(np.searchsorted(-100 * falling, -high_percent * high, "left"))
                best = at[start:start + most]
                best = best[100 * scores[i, best] >= low_percent * high]
                out.append((np.full(len(best), own[i]), np.full(len(best), high), row[best], ids[best], scores[i, best]))
        names = ("row", "high", "hit", "hit_id", "score")
        return pa.table(dict(zip(names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    def floors(found: DataFrame) -> DataFrame:
        """The least of what the anchor's windows still lack."""
        have = found.groupBy("row", "high").agg(F.when(F.count("*") >= most, F.min("score")).alias("certain"))
        return windows.join(have, ["row", "high"], "left").groupBy("row").agg(F.min(F.coalesce("certain", "low")).alias("floor"))

    rank = F.row_number().over(W.partitionBy("row", "high").orderBy(F.desc("score"), "hit_id", "hit"))
    return _walk(
        index, anchors.select("row", "label", "vector").join(asking, "row"), groups,
        "row bigint, high bigint, hit bigint, hit_id bigint, score bigint", choose,
        lambda found: found.withColumn("r", rank).filter(F.col("r") <= most).drop("r"), floors)


def mine(
    vectors: DataFrame, rules: Rules = Rules(), sample: int = 20_000, most_codes: int = 256, cell_rows: int = 200,
    part_rows: int = 4096, anchors_a_task: int = 2048,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = prepared(vectors, rules, id_column, vector_column, label_column)
    index = Index(rows, sample, most_codes, cell_rows, part_rows)
    anchors = rows.filter("anchor").select("row", "id", "label", "vector")
    asking = 0 if index.empty else anchors.count()
    if not asking:
        return rows.sparkSession.createDataFrame([], schema)
    groups = -(-asking // anchors_a_task)
    near = positives(index, anchors, rules.positives, groups)
    if near.isEmpty():
        return rows.sparkSession.createDataFrame([], schema)
    far = negatives(index, anchors, near, rules, groups)
    rank = F.row_number().over(W.partitionBy("row", "high").orderBy(F.desc("negative_score"), "hit_id", "hit"))
    ranked = far.withColumnRenamed("score", "negative_score").withColumn("rank", rank).select(
        "row", "high", "rank", "negative_score", F.nullif("hit_id", F.lit(NO_ID)).alias("negative_id"))
    named = near.select("row", F.col("score").alias("high"), F.nullif("hit_id", F.lit(NO_ID)).alias("positive_id"))
    return named.join(ranked, ["row", "high"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("high").alias("positive_score"), "negative_score")
