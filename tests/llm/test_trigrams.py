"""The language model of order 3 against its plain definition."""

import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
from conftest import listed, prose

from firmloom.llm.language_model import END, score_sequences, train, train_and_score
from firmloom.llm.shingles import batch_words


def plain(rows):
    """(doc_id, score) of (doc_id, text) rows."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    tokens = [["</s>", "</s>", *brute.WORDS.findall(brute.low(t)), "</s>"] for _, t in rows]
    three = Counter(g for h, t in zip(held, tokens, strict=True) if not h for g in zip(t, t[1:], t[2:], strict=False))
    types = len({w for h, t in zip(held, tokens, strict=True) if not h for w in t[2:]})
    levels = [three, Counter(g[1:] for g in three)]
    levels.append(Counter(g[1:] for g in levels[1]))
    by = [brute._discounts(Counter(n.values())) for n in levels]
    context = [defaultdict(list), defaultdict(list), defaultdict(list)]
    for k, level in enumerate(levels):
        for g, n in level.items():
            context[k][g[:-1]].append(n)

    def chance(g, k=0):
        lower = chance(g[1:], k + 1) if k < 2 else 1 / (types + 1)
        seen, d, n = context[k][g[:-1]], by[k], levels[k][g]
        if not seen:
            return lower if k < 2 else 1.0
        return (n - (d[min(n, 3) - 1] if n else 0) + sum(d[min(c, 3) - 1] for c in seen) * lower) / sum(seen)

    return sorted(((i, round(sum(math.log10(chance(g)) for g in zip(t, t[1:], t[2:], strict=False)), 6))
                   for (i, _), t in zip(rows, tokens, strict=True)), key=repr)


def test_order_three(docs, pairs, spark):
    got = train_and_score(docs, order=3)
    assert listed(got.select("doc_id", "score")) == plain(pairs)
    assert listed(got.drop("score")) == listed(train_and_score(docs).drop("score"))
    often = [(i, "a b c a b d") for i in range(300)] + [(1000, "a b d a b c x")]
    assert listed(train_and_score(spark.createDataFrame(often, "doc_id int, text string"), order=3).select("doc_id", "score")) == plain(often)


def test_chances_sum_to_one(spark):
    rows = [(i, prose(i, 12)) for i in range(40)]
    words = sorted({w for _, t in rows for w in t.split()})
    model = train(spark.createDataFrame(rows, "doc_id int, text string"), order=3)
    one, two = batch_words(pa.array(rows[0][1].split()[:2]))
    tails = [*batch_words(pa.array([*words, "unknown"])), END]
    parts = [score_sequences(model, [np.concatenate((one, two, w)) for w in tails])["score"],
             np.full(len(tails), score_sequences(model, [np.concatenate((one, two))])["score"])]
    assert abs(sum(10 ** (parts[0] - parts[1])) - 1) < 1e-9


def test_no_texts(nothing):
    assert train_and_score(nothing, order=3).count() == 0
