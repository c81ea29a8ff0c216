"""Hard negatives against the plain definition over all rows."""

import numpy as np
import pytest
from conftest import listed

import brute
from firmloom.llm.common import table
from firmloom.llm.hard_negatives import Grid, cell_order, halves, matrix, mine

VECTORS = "vec_id bigint, embedding array<float>, label int, row int, part string, c0 int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], VECTORS)


def rows_of(df):
    return [(r.vec_id, r.embedding, r.label) for r in df.collect()]


@pytest.fixture(scope="module")
def odd():
    """Clusters, copies with ties, repeated ids, and rows that take no part."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 0.4
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.1).tolist(), int(rng.integers(0, 3))) for i in range(900)]
    same = centres[2].tolist()
    rows += [(1000 + i, same, i % 2) for i in range(300)]  # 1000, 1100 and 1200 are anchors among copies
    rows += [(300, same, 1), (300, same, 2), (None, same, 0), (None, rows[5][1], 1)]
    rows += [(2000, None, 1), (2100, same, None), (2200, [*same[:7], float("nan")], 1), (2300, [*same[:7], None], 1),
             (2400, [*same[:7], float("inf")], 1), (2500, [], 1), (2600, same[:5], 0), (2700, [0.0] * 8, 2), (-100, same, 0)]
    return rows


def test_mine(spark, odd):
    df = frame(spark, odd)
    want = brute.hard_negatives(rows_of(df))
    assert len(want) > 200
    assert listed(mine(df)) == want
    assert listed(mine(df.repartition(7), cell_rows=5, part_rows=40, anchors_a_task=2, sample=50)) == want


def test_large_components_stay_integers(spark):
    rng = np.random.default_rng(1)
    rows = [(i * 50, (rng.normal(size=4) * 300_000).tolist(), i % 2) for i in range(60)]
    df = frame(spark, rows)
    assert listed(mine(df, cell_rows=4)) == brute.hard_negatives(rows_of(df))


def test_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    assert listed(mine(df)) == brute.hard_negatives(rows_of(df))


def test_nothing_to_mine(spark, odd):
    for rows in ([], [r for r in odd if r[0] and 2000 <= r[0] <= 2400], [(1, [0.5], 1), (2, [0.5], 2)], [(100, [0.5], 1)],
                 [(100, [0.5], 1), (200, [0.5], 1)]):
        found = mine(frame(spark, rows))
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert found.isEmpty()


def test_cells_come_by_falling_bound_and_none_is_lost():
    rng = np.random.default_rng(2)
    points = rng.integers(-200, 200, (500, 6))
    codes = [rng.normal(size=(k, 3)) * 100 for k in (5, 7)]
    parts, radii = {}, [np.zeros(5), np.zeros(7)]
    near = [((h[:, None, :] - c) ** 2).sum(2) ** 0.5 for h, c in zip(halves(points), codes, strict=True)]
    cells = list(zip(near[0].argmin(1).tolist(), near[1].argmin(1).tolist(), strict=True))
    for h in (0, 1):
        np.maximum.at(radii[h], near[h].argmin(1), near[h].min(1))
    for c in cells:
        parts[c] = 1
    for query in points[:20]:
        order = list(cell_order(Grid(codes, radii, parts), query))
        bounds = [b for b, _ in order]
        assert bounds == sorted(bounds, reverse=True) and {c for _, c in order} == set(cells)
        bound = {c: b for b, c in order}
        assert all(bound[c] >= s for c, s in zip(cells, points @ query, strict=True))


def test_matrix_fills_up():
    import pyarrow as pa

    assert matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), 2).tolist() == [[1, 2], [0, 0], [3, 0]]
