"""Groups of many near copies, whose links are found by their differences, against brute force."""

import random

import brute
import pytest
from conftest import prose
from pyspark.sql import functions as F

from firmloom.llm import jaccard_join
from firmloom.llm.jaccard_join import JaccardJoin


def copies(seed: int):
    """Two bases that share most words, and copies with edits at common and at own places; some far from all others."""
    rng = random.Random(seed)
    base = prose(seed, 120).split()
    second = list(base)
    for at in range(10, 110, 9):
        second[at] = f"second{at}"
    rows = []
    for i in range(150):
        words = list(rng.choice((base, base, second)))
        for k in range(rng.choice((0, 1, 2, 3, 5, 8))):
            at = rng.choice((7, 31, 55, 78, 102)) if rng.random() < 0.6 else rng.randrange(120)
            words[at] = f"edit{at}" if rng.random() < 0.5 else f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (2, 70, 3)])
def test_dense_groups(spark, n, percent, seed):
    rows = copies(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    join = JaccardJoin(docs, n=n, percent=percent, dense=4)
    assert join.places().filter(F.col("dense").isNotNull()).count() > 100
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.documents().collect())
    want = sorted(brute.jaccard_components(rows, percent, n))
    assert got == want and 1 < len({c for *_, c in want}) < len(rows)


def test_pairs_of_a_group_grow_with_its_size(spark):
    """Copies with own edits beyond the limit share only what they all miss: no pairs of them are made."""
    base = prose(9, 100).split()

    def join(size):
        rng = random.Random(size)
        rows = [(0, " ".join(base))]
        for i in range(1, size):
            words = list(base)
            for at in rng.sample(range(100), 2 + i % 5):
                words[at] = f"own{i}x{at}"
            rows.append((i, " ".join(words)))
        made = JaccardJoin(spark.createDataFrame(rows, "doc_id bigint, text string"), n=5, percent=80, dense=4)
        sizes = {}
        close = made.close

        def counted(pairs, placed):
            sizes[len(sizes)] = pairs.count()
            return close(pairs, placed)

        made.close = counted
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in made.documents().collect())
        assert got == sorted(brute.jaccard_components(rows, 80, 5))
        return sum(sizes.values())

    assert join(240) <= 8 * max(join(60), 15)


def rounds(spark, monkeypatch, rows, n=5, percent=80):
    """Rows of the differences at first and after each round, with the result checked against brute force."""
    counts = []
    write = jaccard_join.stage

    def counted(df, name="stage"):
        out = write(df, name)
        if name == "differing":
            counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    join = JaccardJoin(spark.createDataFrame(rows, "doc_id bigint, text string"), n=n, percent=percent, dense=4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.documents().collect())
    assert got == sorted(brute.jaccard_components(rows, percent, n))
    return counts


def edited(rng, base, i, edits):
    words = list(base)
    for at in rng.sample(range(len(base)), edits):
        words[at] = rng.choice((f"own{i}x{at}", f"edit{rng.randrange(40)}"))
    return " ".join(words)


def test_places_lacked_by_many_are_no_meeting_place(spark, monkeypatch):
    """Copies lack the same words again and again; only what they have in their place may link those far from the base."""
    rng = random.Random(5)
    base = prose(21, 100).split()
    rows = [(0, " ".join(base)), *((i, edited(rng, base, i, 1 + i % 6)) for i in range(1, 200))]
    # Own edits that two copies share, and pairs that only lack the same words.
    rows += [(200 + i, " ".join([*base[:30], *(f"both{i // 2}x{k}" for k in range(6 + i % 2)), *base[40:]])) for i in range(6)]
    rows += [(210 + i, " ".join(base[: 60 + i])) for i in range(6)]
    first, *left = rounds(spark, monkeypatch, rows)
    assert sum(left) < first / 2


def test_a_cut_copy_does_not_lengthen_all_differences(spark, monkeypatch):
    """Differences are taken from what most members have, not from a short text that has no rare n-gram."""
    rng = random.Random(6)
    base = prose(22, 100).split()
    rows = [(i, edited(rng, base, i, 1 + i % 4)) for i in range(120)]
    rows += [(200 + i, " ".join(base[: 30 + i])) for i in range(5)]
    first, *left = rounds(spark, monkeypatch, rows)
    sets = [brute_set(t) for _, t in rows]
    most = {g for g in set().union(*sets) if 2 * sum(g in s for s in sets) > len(sets)}
    assert first <= sum(len(s ^ most) for s in sets)
    assert sum(left) < first


def brute_set(text, n=5):
    words = text.split()
    return {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))}
