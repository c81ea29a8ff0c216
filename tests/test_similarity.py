import random
import time

import pytest

from firmloom.functions.similarity import (
    LevenshteinIndex, TextColumn, WRatioIndex, lcs_length, partial_ratio, wratio,
)

WORDS = ["ACME", "CELTIC", "COVER", "INSURANCE", "BROKERS", "X", "THE", "OF", "DUBLIN" * 6, "É"]


def name(rng, longest=7):
    return " ".join(
        rng.choice(WORDS) if rng.random() < 0.7 else "".join(rng.choice("ABCÉ") for _ in range(rng.randint(1, 9)))
        for _ in range(rng.randint(1, longest))
    )


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def slow_partial(a, b):
    def windows(s, t):
        return max(
            200 * slow_lcs(s, w) / (len(s) + len(w))
            for i in range(1 - len(s), len(t)) for w in [t[max(i, 0):i + len(s)]]
        )

    s, t = (a, b) if len(a) <= len(b) else (b, a)
    return max(windows(s, t), windows(t, s)) if len(s) == len(t) else windows(s, t)


@pytest.mark.parametrize("left, right, expected", [
    ("CELTIC COVER INSURANCES", "CELTIC INSURANCE ADVISORS", 75.2),
    ("ACME INSURANCE BROKERS IRELAND", "ACME INSURANCE BROKERS", 95.0),
    ("ZENITH MARITIME CONSULTING", "CELTIC INSURANCE ADVISORS", 31.4),
])
def test_published_scores(left, right, expected):
    assert round(wratio(left, right), 1) == expected


def test_long_against_short_names():
    # Shared token and a length ratio from 1.5: 100 * 0.95 * 0.9; a contained name: 100 * 0.9.
    assert wratio("ACME", "WHOLLY OTHER ACME") == 90.0
    assert wratio("ACME ZZZ", "ACME HOLDINGS LIMITED") == pytest.approx(85.5)
    assert wratio("", "ACME") == 0.0


def test_lcs_and_partial_against_plain_versions():
    rng = random.Random(1)
    for _ in range(40):
        a, b = name(rng)[:70], name(rng)[:100]
        assert lcs_length(a, b) == slow_lcs(a, b)
        assert TextColumn([b, "", a]).lcs(a).tolist() == [slow_lcs(a, b), 0, len(a)]
        assert partial_ratio(a, b) == pytest.approx(slow_partial(a, b))


def test_index_is_exact():
    rng = random.Random(2)
    for _ in range(8):
        names = [name(rng, rng.choice([2, 5, 12])) for _ in range(50)]
        index, edits = WRatioIndex(names), LevenshteinIndex(names)
        for _ in range(10):
            wanted = name(rng, rng.choice([1, 3, 9]))
            scores = [wratio(wanted, n) for n in names]
            assert index.best(wanted) == (scores.index(max(scores)), max(scores))
            if max(scores) >= 60:
                assert index.best(wanted, 60.0) == (scores.index(max(scores)), max(scores))
            row, score = edits.best(wanted)
            distances = [slow_edits(wanted, n) for n in names]
            assert (row, -score) == (distances.index(min(distances)), min(distances))


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_edit_distance_of_long_and_empty_names():
    rng = random.Random(4)
    names = ["", "A" * 200, *[name(rng, 30) for _ in range(60)]]
    for wanted in ["", "B", "A" * 64, "A" * 65, *[name(rng, 30) for _ in range(12)]]:
        assert TextColumn(names).edits(wanted).tolist() == [slow_edits(wanted, n) for n in names]


def test_a_full_cell_of_edit_distances_is_quick():
    rng = random.Random(6)
    names = list(dict.fromkeys(f"ACME {name(rng, 6)} {rng.randrange(10**6)}" for _ in range(4096)))
    index = LevenshteinIndex(names)
    start = time.process_time()
    for wanted in names[:20]:
        found, score = index.best(wanted[:-1])
        assert -score <= 1 and slow_edits(wanted[:-1], names[found]) == -score
        assert index.best(wanted) == (names.index(wanted), 0)
    assert time.process_time() - start < 1
