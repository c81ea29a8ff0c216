"""Jaccard join, decontamination, language model and their parts against plain definitions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import listed, prose

from firmloom.llm.common import stage
from firmloom.llm.components import components
from firmloom.llm.decontamination import decontaminate, remove_contaminated
from firmloom.llm.jaccard_join import JaccardJoin, jaccard_join, pack_codes, unpack_codes
from firmloom.llm.language_model import pack, pack_counts, train, train_and_score, unpack, unpack_counts
from firmloom.llm.shingles import PIECE, batch_words, word_hashes


def test_word_hashes_do_not_depend_on_pieces():
    text = (b"Alpha beta\n" * (PIECE // 8)) + b"x" * (2 * PIECE) + b" omega"
    hashes = word_hashes(np.frombuffer(text, np.uint8))
    assert len(hashes) == len(text.split()) and len(set(hashes.tolist())) == 4
    parts = list(batch_words(pa.array(["omega", None, "", " alpha  BETA", "Beta É é"])))
    assert [len(p) for p in parts] == [1, 0, 0, 2, 3]
    assert parts[0][0] == hashes[-1] and parts[3].tolist() == hashes[:2].tolist()
    assert parts[4][0] == parts[3][1] and parts[4][1] != parts[4][2]


def test_packing():
    rng = np.random.default_rng(1)
    codes = np.sort(rng.integers(0, 1 << 40, 500, dtype=np.uint64))
    codes = np.sort(np.concatenate((codes, codes[:7])))
    assert (unpack_codes(pack_codes(codes)) == codes).all()
    for top in (3, 300, 1 << 20, 1 << 62):
        keys = np.unique(rng.integers(0, top, 200, dtype=np.uint64))
        assert (unpack(pack(keys)) == keys).all() and (unpack_counts(pack_counts(keys)) == keys).all()


def test_jaccard_components(docs, pairs):
    assert listed(jaccard_join(docs)) == brute.jaccard_components(pairs)


def test_near_copies_with_many_variants(spark):
    """One group of variants, some linked only through others, and texts that share a common passage."""
    rng, base, shared = random.Random(5), prose(8, 200).split(), prose(9, 40)
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(200)] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, f"{prose(50 + i, 45)} {shared}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute.jaccard_components(rows)
    assert len({c for _, _, c in want}) < 115
    assert listed(jaccard_join(df)) == want
    assert listed(jaccard_join(df, frequent_limit=3)) == want
    for dense in (2, 20):  # the variants are then found by their differences from a hub
        join = JaccardJoin(df, dense=dense)
        assert not join.places().filter("dense is not null").isEmpty()
        assert listed(join.documents()) == want


def test_one_of_each_group_stays(docs, pairs):
    kept = JaccardJoin(docs).keep_one()
    assert kept.columns == docs.columns
    groups = {c: n for _, n, c in brute.jaccard_components(pairs) if n}
    ids = [r.doc_id for r in kept.collect() if brute.shingles(r.text)]
    assert len(ids) == len(groups) and set(ids) == set(groups)
    assert sum(1 for r in kept.collect() if not brute.shingles(r.text)) == sum(1 for _, t in pairs if not brute.shingles(t))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (3, 2)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_run_no_round_that_changes_nothing(spark, monkeypatch):
    """What is written for each call: the links, and a table for each round."""
    written = []
    monkeypatch.setattr("firmloom.llm.components.stage", lambda df, name: written.append(name) or stage(df, name))
    found = lambda links: dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert found([(1, 5), (6, 1), (2, 9), (9, 2)]) == {1: 1, 5: 1, 6: 1, 2: 2, 9: 2} and len(written) == 1
    written.clear()
    assert found([(1, 2), (2, 3)]) == {1: 1, 2: 1, 3: 1} and len(written) == 2


def test_last_components_of_the_join_start_from_stars(spark, monkeypatch):
    """Copies that are linked inside their n-grams come to the last call as stars, which need no round."""
    base = prose(30, 300).split()
    rows = [(k, " ".join([*base[:3 * k], f"z{k}", *base[3 * k + 1:]])) for k in range(90)]
    written, calls = [], []
    monkeypatch.setattr("firmloom.llm.components.stage", lambda df, name: written.append(name) or stage(df, name))

    def counted(links):
        written.clear()
        parts = components(links)
        calls.append(len(written))
        return parts

    monkeypatch.setattr("firmloom.llm.jaccard_join.components", counted)
    got = listed(jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=80, n=5))
    assert got == brute.jaccard_components(rows, 80, 5) and calls[-1] == 1


ITEM = prose(20, 40).split()
ITEMS = [
    (1, " ".join(ITEM)), (2, " ".join(ITEM[5:30]).upper()), (3, "solo"), (3, "solo"), (4, "two words"), (5, None), (6, " ,. "),
    (None, " ".join(ITEM[:12])), (7, " ".join(ITEM)), (8, "a b a b a b a b a b a b"), (9, "three little words"),
]
TEXTS = [
    (1, " ".join(ITEM[3:13])), (2, " ".join(ITEM[3:12])), (3, "x " + ", ".join(ITEM) + " y solo"), (4, "b a b a b a b a b a b a"),
    (5, "Two... WORDS two"), (6, None), (7, ""), (8, "Solo three little, words"), (8, "Solo three little, words"),
    (None, " ".join(ITEM[20:])), (9, " ".join([*ITEM[:10], "gap", *ITEM[10:25]])), (10, prose(21, 300)),
]


def test_contamination(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in TEXTS], "doc_id bigint, text string, words string, at int").repartition(3)
    items = spark.createDataFrame([(*r, 5) for r in ITEMS], "item_id bigint, text string, class int")
    want = brute.contamination(TEXTS, ITEMS)
    assert listed(decontaminate(docs, items).drop("key")) == want
    assert listed(decontaminate(docs, items, bits=64).drop("key")) == want
    clean = remove_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(i) for i, *_, hit in want if not hit)


def test_contamination_of_odd_texts(docs, pairs, spark):
    items = [(i, " ".join((t or "").split()[2:40])) for i, t in pairs]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    assert listed(decontaminate(docs, frame).drop("key")) == brute.contamination(pairs, items)
    assert not any(r.contaminated for r in decontaminate(docs, frame.limit(0)).collect())


@pytest.mark.parametrize("bits", [None, 1])
def test_language_model(docs, pairs, bits):
    if bits is None:
        assert listed(train_and_score(docs)) == brute.language_model(pairs)
    else:
        assert train(docs, bits=2).words.size == train(docs).words.size


def test_language_model_sums_to_one(spark):
    """Over all words that follow some context, and the unknown one, chances sum to one."""
    rows = [(i, prose(i, 12)) for i in range(40)]
    words = sorted({w for i, t in rows for w in t.split()})
    model = train(spark.createDataFrame(rows, "doc_id int, text string"))
    from firmloom.llm.language_model import END, score_sequences

    first = next(iter(batch_words(pa.array([words[0]]))))
    ends = [np.concatenate((first, w)) for w in [*batch_words(pa.array(words)), END, next(iter(batch_words(pa.array(["unknown"]))))]]
    assert abs(sum(10 ** score_sequences(model, ends)["score"]) - 1) < 1e-9


def test_empty_tables(nothing, spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert jaccard_join(nothing).count() == decontaminate(nothing, items).count() == train_and_score(nothing).count() == 0
    assert JaccardJoin(nothing).keep_one().count() == remove_contaminated(nothing, items).count() == 0
