"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Every text gives a few dozen statistics (characters, words, lines; never language,
source or id). Standardised, they pass through cos(W x + b) with fixed random W, b,
which approximates a Gaussian kernel. Each partition of the labelled rows sums its
part of the normal equations; the parts are added by row of the matrix, and one
matrix of fixed size is solved on the driver. The labelled rows fall into two folds.
Each fold is scored by the model of the other, and these scores, summed into a fixed
number of bins, are made monotone (pool adjacent violators). The final weights use
both folds. All labelled rows are learnt from, none is sampled.

Defined cases: a null or empty text has statistics of zero length and is scored like
any other; a row without a label or with a null one is not learnt from; several
labels of an id count as their mean; a null id has no label and is not held out;
without labels every score is 0.5; a single label value is a constant score;
repeated rows get equal scores; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmloom.llm.common import attach, stage, text_of
from firmloom.llm.shingles import BLANK, batch_words, texts_of

FEATURES, WIDTH, RIDGE, SEED, BINS = 256, 4.0, 1e-3, 7, 1024
LOW, HIGH = -0.5, 1.5


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


UPPER, LOWER = _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
DIGIT, PLAIN = _class(b"0123456789"), _class(b".,;:'\"-()?")
SYMBOL = _class(b"#$%&*@^~=+<>/\\_{}[]`")
HIGH_BYTE = np.arange(256) >= 128
N_STATISTICS = 26


def text_statistics(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The statistics of one text from its bytes and the hashes of its words."""
    out = np.zeros(N_STATISTICS)
    n, many = len(data), len(words)
    if not n:
        return out
    seen = np.bincount(data, minlength=256)
    share = lambda of: seen[of].sum() / n
    letters = seen[UPPER].sum() + seen[LOWER].sum()
    p = seen[seen > 0] / n
    out[:12] = [
        np.log1p(n), np.log1p(many), seen[UPPER].sum() / max(letters, 1), share(DIGIT), share(SYMBOL), seen[ord("!")] / n,
        seen[ord("|")] / n, share(PLAIN), share(HIGH_BYTE), -(p * np.log2(p)).sum(), share(BLANK),
        (seen[ord(".")] + seen[ord("?")] + seen[ord("!")]) / max(many, 1)]
    symbol = SYMBOL[data]
    out[12] = (symbol[1:] & (data[1:] == data[:-1])).sum() / n
    if many:
        word = np.concatenate(([False], ~BLANK[data], [False]))
        edge = np.flatnonzero(word[1:] != word[:-1])
        lengths = edge[1::2] - edge[::2]
        _, counts = np.unique(words, return_counts=True)
        out[13:19] = [lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(counts) / many, counts.max() / many,
                      (words[1:] == words[:-1]).sum() / many]
    starts = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
    starts = starts[starts < n]
    sizes = np.diff(np.append(starts, n))
    per_line = lambda of: np.add.reduceat(of.astype(np.int64), starts) / np.maximum(sizes, 1)
    upper, symbols, bars = per_line(UPPER[data]), per_line(symbol), per_line(data == ord("|"))
    long = sizes >= 20
    lines = bytes(data).split(b"\n")
    out[19:] = [
        np.log1p(len(lines)), len(set(lines)) / len(lines), sizes[upper > 0.5].sum() / n, sizes[symbols > 0.05].sum() / n,
        sizes[bars > 0.02].sum() / n, upper[long].max(initial=0.0), symbols[long].max(initial=0.0)]
    return out


def _batch_statistics(column: pa.Array) -> np.ndarray:
    rows = [text_statistics(t, w) for t, w in zip(texts_of(column), batch_words(column), strict=True)]
    return np.array(rows).reshape(-1, N_STATISTICS)


def statistics(docs: DataFrame, keep: tuple[str, ...] = (), text_column: str = "text") -> DataFrame:
    """Columns `keep` and `x`, the statistics of the whole text."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _batch_statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], _lists(x)], names=[*keep, "x"])

    rows = docs.select(*keep, text_of(text_column).alias("text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[: len(keep)])
    return rows.mapInArrow(run, f"{kinds}x array<double>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Fourier:
    """Standardisation and random features; the last feature is constant."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray

    @staticmethod
    def fit(mean: list[float], scale: list[float]) -> Fourier:
        rng = np.random.default_rng(SEED)
        scale = np.array([s if s and s > 1e-9 else 1.0 for s in scale])
        return Fourier(np.array(mean), scale, rng.normal(0, 1 / WIDTH, (len(mean), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        wave = np.sqrt(2 / FEATURES) * np.cos(z @ self.turn + self.shift)
        return np.hstack((wave, np.ones((len(x), 1))))


@dataclass
class QualityModel:
    """Scores of statistics; without `features` it is the constant `values[0]`."""

    features: Fourier | None
    weights: np.ndarray
    points: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.features(x) @ self.weights, self.points, self.values), 0.0, 1.0)


def monotone(points: np.ndarray, means: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centre and value of each block."""
    blocks: list[list[float]] = []
    for p, m, s in zip(points, means, sizes, strict=True):
        blocks.append([p * s, m * s, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _sum_rows(group: pa.Table) -> pa.Table:
    total = _matrix(group.column("v").combine_chunks()).sum(axis=0)
    return group.slice(0, 1).set_column(group.schema.get_field_index("v"), "v", _lists(total[None, :]))


def normal_equations(rows: DataFrame, features: Fourier) -> dict[int, np.ndarray]:
    """fold -> [Z'Z | Z'y] of `rows` (x, y, fold), summed in each partition, then by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y = features(_matrix(batch.column("x"))), batch.column("y").to_numpy()
            fold = batch.column("fold").to_numpy()
            for k in np.unique(fold):
                mine = z[fold == k]
                part = mine.T @ np.hstack((mine, y[fold == k][:, None]))
                sums[int(k)] = sums.get(int(k), 0) + part
        for k, total in sums.items():
            m = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, k), pa.int32()), pa.array(np.arange(m), pa.int32()), _lists(total)], names=["fold", "i", "v"])

    parts = rows.mapInArrow(run, "fold int, i int, v array<double>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("fold", "i", "salt").applyInArrow(_sum_rows, "fold int, i int, v array<double>, salt int")
    whole = some.groupBy("fold", "i").applyInArrow(_sum_rows, "fold int, i int, v array<double>, salt int").collect()
    size = FEATURES + 1
    out = {k: np.zeros((size, size + 1)) for k in {r.fold for r in whole}}
    for r in whole:
        out[r.fold][r.i] = r.v
    return out


def solve(equations: np.ndarray) -> np.ndarray:
    m = len(equations)
    return np.linalg.solve(equations[:, :m] + RIDGE * max(equations[-1, m - 1], 1.0) * np.eye(m), equations[:, m])


def calibrate(rows: DataFrame, features: Fourier, weights: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Monotone map from raw scores to label shares, from scores of rows by the other fold's weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, ones = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y, fold = features(_matrix(batch.column("x"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            raw = np.where(fold == 0, z @ weights[1], z @ weights[0])
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            np.add.at(count, at, 1)
            np.add.at(ones, at, y)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(count[held]), pa.array(ones[held])], names=["bin", "n", "ones"])

    bins = rows.mapInArrow(run, "bin bigint, n double, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    found = np.array(sorted(map(tuple, bins.collect())))
    centres = LOW + (found[:, 0] + 0.5) / BINS * (HIGH - LOW)
    return monotone(centres, found[:, 2] / found[:, 1], found[:, 1])


def remainder(id_column: str = "doc_id"):
    """Checksum of the id mod 3; rows of remainder 1 are held out."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 3


def fit_quality(rows: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id") -> QualityModel:
    """Learn from staged `rows` (doc_id, x, part) and `labels`; held-out rows are left out."""
    marks = (
        labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("double").alias("y"))
        .filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    )
    wanted = rows.filter(F.col("doc_id").isNotNull() & (remainder() != 1))
    known = stage(
        attach(wanted.select("doc_id", "part", "x"), marks, ["doc_id"], "part")
        .select("x", "y", F.when(remainder() == 0, 0).otherwise(1).alias("fold")), "labelled")
    spots = range(N_STATISTICS)
    about = known.agg(
        F.count("*").alias("n"), F.min("y").alias("least"), F.max("y").alias("most"),
        *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in spots], *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in spots]).first()
    if not about.n or about.least == about.most:
        return QualityModel(None, np.empty(0), np.empty(0), np.array([about.least if about.n else 0.5]))
    features = Fourier.fit([about[f"m{i}"] for i in spots], [about[f"s{i}"] for i in spots])
    equations = normal_equations(known, features)
    both = sum(equations.values())
    weights = {k: solve(equations[k]) if k in equations else solve(both) for k in (0, 1)}
    points, values = calibrate(known, features, weights)
    return QualityModel(features, solve(both), points, values)


def score_statistics(rows: DataFrame, model: QualityModel, keep: tuple[str, ...]) -> DataFrame:
    """Columns `keep` and `score` of `rows` with statistics `x`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(model.score(_matrix(batch.column("x"))))], names=[*keep, "score"])

    picked = rows.select(*keep, "x")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema[: len(keep)])
    return picked.mapInArrow(run, f"{kinds}score double")


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Staged doc_id, x, part of every row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return stage(statistics(rows, ("doc_id",)).withColumn("part", F.spark_partition_id()), "statistics")


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = document_statistics(docs, id_column, text_column)
    model = fit_quality(rows, labels)
    return score_statistics(rows, model, ("doc_id",)).select(
        "doc_id", (remainder() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, that the classifier does not reject."""
    columns = docs.columns
    model = fit_quality(document_statistics(docs, id_column, text_column), labels)
    scored = score_statistics(
        statistics(docs.select(F.struct(*columns).alias("row"), F.col(text_column).alias("text")), ("row",)), model, ("row",))
    return scored.filter("score >= 0.5").select(*[F.col("row").getField(c).alias(c) for c in columns])
