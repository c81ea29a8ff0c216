"""SimHash groups and the pigeonring join against plain definitions."""

import random

import brute
import pyarrow as pa
import pytest
from conftest import listed

from firmloom.llm.common import table
from firmloom.llm.simhash import chain, close_pairs, fingerprint, fingerprints, simhash_groups


def signed(x):
    return x - 2**64 if x >> 63 else x


def test_fingerprint_is_the_definition(pairs):
    for _, text in pairs:
        assert fingerprint((text or "").encode()) == brute.simhash(text)


def test_groups(docs, nothing, pairs):
    assert listed(simhash_groups(docs)) == brute.simhash_components(pairs)
    assert listed(simhash_groups(docs.withColumnsRenamed({"key": "fp", "part": "component_id"}))) == brute.simhash_components(pairs)
    empty = simhash_groups(nothing)
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.isEmpty()


def test_tasks_take_few_texts_at_once(spark):
    """Texts reach Python in batches of 256 rows, however many a partition holds."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(i, f"a{i % 7} b c {i}") for i in range(1000)]
    got = fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    sizes = got.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n bigint").collect()
    assert sum(r.n for r in sizes) == 1000 and max(r.n for r in sizes) <= 256


def test_string_ids(spark):
    got = simhash_groups(spark.createDataFrame([("b", "x y z"), ("a", "X  y z"), (None, "q")], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {("b", "a"), ("a", "a"), (None, None)}


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert listed(simhash_groups(docs)) == brute.simhash_components([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("distance, segments, crowd", [(2, 8, 64), (2, 8, 1), (2, 16, 2), (3, 8, 1), (1, 4, 1)])
def test_pairs(spark, distance, segments, crowd):
    """Random values, a ball around one of them, and a group that fills the bits beside a crowded key."""
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    for _ in range(150):
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    for _ in range(150):
        values.add(centre ^ rng.getrandbits(7) << rng.choice((0, 21, 60)) & (1 << 64) - 1)
    values = sorted(values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1:] if (a ^ b).bit_count() <= distance}
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in close_pairs(frame, distance, segments, crowd).collect()}
    assert got == want and len(want) > 100


def test_chains_and_bounds(spark):
    assert chain(8, 2, 0) == 3 and chain(8, 2, 1) == 7 and chain(16, 2, 0) == 7
    with pytest.raises(ValueError):
        close_pairs(spark.createDataFrame([], "fp bigint"), 3, 10)
