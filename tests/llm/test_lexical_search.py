"""Ranked lexical search against the plain score of every document."""

import numpy as np
import pytest
from conftest import listed, prose

import brute
from firmloom.llm.common import table
from firmloom.llm.lexical_search import LEVELS, Items, Weights, bounds, level_hashes, places, search, terms_of

ITEMS = "item_id bigint, text string, key string, items string"


@pytest.fixture(scope="module")
def items(spark):
    words = prose(2, 120).split()
    rows = [
        (1, " ".join(words[:30])), (2, prose(3, 40)), (3, "One two"), (4, None), (5, " ,;! "), (6, "nowhere to be found"),
        (7, "ſecret KELVIN élan deadbeefdeadbeef"), (None, prose(4, 5)), (7, "one one ONE"), (8, prose(1, 300)),
    ]
    return spark.createDataFrame([(*r, "k", "i") for r in rows], ITEMS)


def asked(items):
    return [(r.item_id, r.text) for r in items.collect()]


def test_search(docs, items, pairs):
    assert listed(search(docs, items)) == brute.lexical_search(pairs, asked(items))


@pytest.mark.parametrize("options", [{"bits_a_key": 1, "most_bits": 64}, {"most_terms": 20}, {"top": 2, "seeds": 2}])
def test_signatures_blocks_and_seeds_change_nothing(docs, items, pairs, options):
    """Full signatures, several blocks of items, few seeds."""
    assert listed(search(docs, items, **options)) == brute.lexical_search(pairs, asked(items), options.get("top", 10))


def test_whole_table(spark):
    docs, items = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    assert listed(search(docs, items)) == brute.lexical_search([(r.doc_id, r.text) for r in docs.collect()], asked(items))


def test_empty_tables(spark, docs, nothing, items):
    none = spark.createDataFrame([], ITEMS)
    for found in (search(nothing, items), search(docs, none), search(nothing, none)):
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.isEmpty()
    blank = spark.createDataFrame([(1, None), (2, " . ")], "doc_id bigint, text string")
    assert search(blank, items).isEmpty()


def test_other_id_kinds(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "X-y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in search(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]


def test_bounds_are_bounds():
    """On random documents no bound lies below the exact score, whatever the width."""
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}".encode() for i in range(60)]
    docs = [[vocabulary[i] for i in rng.zipf(1.3, rng.integers(1, 3000)) % 60] for _ in range(40)]
    sent = Items([set(rng.choice(vocabulary, 12).tolist()) for _ in range(7)])
    df = {i: sum(t in d for d in docs) for i, t in enumerate(sent.terms)}
    weights = Weights(sent, len(docs), sum(map(len, docs)), df)
    for width in (32, 256, 4096):
        grid = np.zeros((width, 40), bool)
        for k, d in enumerate(docs):
            terms, counts = np.unique(np.array(d), return_counts=True)
            hashes = Items([set(terms.tolist())]).hashes
            for level, least in enumerate(LEVELS):
                grid[places(level_hashes(hashes[counts >= least], level), width).ravel(), k] = True
        found = bounds(sent, weights, width, np.array([len(d) for d in docs]), np.packbits(grid, axis=1))
        exact = np.array([[brute.lexical_score([sent.terms[t] for t in of], d, df_of(sent, df), len(docs), weights.words)
                           for d in docs] for of in sent.of])
        assert (found >= exact).all() and (width < 4096 or (found < 2 * exact + 10**9).mean() > 0.5)


def df_of(sent, df):
    return {t: df[i] for i, t in enumerate(sent.terms)}


def test_terms():
    assert terms_of("Él-An_3a\x00b\x7fc É".encode()) == ["Él".lower().replace("é", "É").encode(), b"an", b"3a", b"b", b"c", "É".encode()]
