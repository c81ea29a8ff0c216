"""Exact dedup, sharding, mixing and secrets against plain definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
from conftest import listed, odd_texts

from firmloom.llm.exact_dedup import exact_dedup
from firmloom.llm.mixing import mix, take_mix
from firmloom.llm.secrets import find_secrets, secret_report
from firmloom.llm.sharding import shard_rows


def test_exact_dedup(docs, pairs):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(pairs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i, k))
    for fan_in in (2, 8):
        rows = exact_dedup(docs, fan_in=fan_in).collect()
        assert len(rows) == len(pairs)
        by = defaultdict(list)
        for r in rows:
            by[r.text_sha256].append(r)
        for bare, members in groups.items():
            got = by[hashlib.sha256(bare.encode()).hexdigest()]
            assert {r.keep_id for r in got} == {min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]}
            assert {r.group_size for r in got} == {len(members)} and len(got) == len(members)
            assert [r.doc_id for r in got if r.kept] == [got[0].keep_id]


def test_many_runs_agree_with_one(docs):
    assert listed(exact_dedup(docs.repartition(9), fan_in=2)) == listed(exact_dedup(docs.coalesce(1)))


def test_sharding(docs, pairs):
    rows = shard_rows(docs, [1.0] * 5).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs)
    grown = {(r.doc_id): r.shard for r in shard_rows(docs, [1.0] * 6).collect()}
    slots = defaultdict(list)
    for r in rows:
        assert r.grown_shard in (r.shard, 5) and grown[r.doc_id] == r.grown_shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_sharding_weights(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    many = Counter(r.shard for r in shard_rows(rows, [1.0, 2.0, 5.0]).collect())
    assert all(abs(many[s] / 20_000 - w / 8) < 0.02 for s, w in enumerate((1, 2, 5)))


def test_mixing(docs, pairs):
    rows = mix(docs).collect()
    assert listed(mix(docs)) == listed(mix(docs.repartition(5)))
    size, weight = Counter(), {}
    for i, t, s in odd_texts():
        size[s] += len(brute.WORDS.findall(t or ""))
    for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        weight[s] = (5, 2, 1)[k % 3]
    full, level = set(), 0
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        more = {s for s in size if 2 * size[s] <= weight[s] * level}
        if more == full:
            break
        full = more
    want = {size[s]: 2.0 * size[s] if s in full else weight[s] * level for s in size}
    assert {r.source_size: round(r.target, 6) for r in rows} == {k: round(v, 6) for k, v in want.items()}
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert sum(r.taken for r in rows) <= 1.5 * sum(size.values()) + 1e-6
    repeated = take_mix(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.taken // r.size for r in rows if r.size)


def test_mix_comes_near_its_targets(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 7 % 4) as source", "repeat('w ', 1 + cast(id % 9 as int)) as text")
    got, target = Counter(), {}
    for r in mix(rows).collect():
        got[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(got[s] - target[s]) <= 20 for s in target)


def test_base_secrets(docs, pairs):
    got = Counter(tuple(r)[:5] for r in secret_report(find_secrets(docs)).collect())
    want = Counter()
    for i, t in pairs:
        found = brute.base_secrets(t)
        kinds = [k for _, k, _ in found]
        want[(i, kinds.count(0), kinds.count(1), kinds.count(2), brute.base_digest(found))] += 1
    assert got == want


def entropy_of(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    return {r.doc_id: [tuple(s) for s in r.spans if s.kind > 2] for r in find_secrets(df).collect()}


def test_entropy_windows(spark):
    key, hexa = "Zx9Qw7Er5Ty3Ui1Op0As2Df4Gh6Jk8LmN", "9F86D081884C7D659A2FEAA0C55AD015"
    texts = [
        "aaaa1aaaa1aaaa1aaaa1aaaa1" + key, key + "/" + "a1" * 40, "f3a9c07be8d14526" * 3, "word" * 10, "x" + key + "example", None, "",
        f"sig={hexa}", f"id_{hexa}", f"EXAMPLE_AUTH={hexa}", f"/x/{hexa}", f"EXAMPLE_AUTH={key}", f"/example/{key}/{key}", f"{key}==",
        f"your_key_{key}", f"{key[:15]}/{key[15:]}", f"EXAMPLE_AUTH={key[:15]}/{key[15:]}", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
        "550e8400-e29b-41d4-a716-446655440000", "20240101123456789012345", f"ä {key}😀{hexa.lower()} " + "plain " * 20_000 + key,
    ]
    spans = entropy_of(spark, texts)
    assert spans == {k: brute.entropy_spans(t) for k, t in enumerate(texts)}
    assert [k for k in range(len(texts)) if not spans[k]] == [3, 4, 5, 6, 17, 18, 19]
    assert len(spans[12]) == 2 and len(spans[20]) == 3
    assert [spans[k][0][1] for k in (7, 8, 9, 10)] == [3] * 4


def test_prefixed_keys_are_found_as_often_as_bare_ones(spark):
    rng = random.Random(3)
    keys = ["".join(rng.choice("0123456789ABCDEF") for _ in range(32)) for _ in range(200)]
    heads = ["", "sig=", "id_", "/x/", "EXAMPLE_AUTH="]
    spans = entropy_of(spark, [h + k for h in heads for k in keys])
    hits = [sum(bool([s for s in spans[i * 200 + j] if s[1] == 3]) for j in range(200)) for i in range(len(heads))]
    assert len(set(hits)) == 1 and hits[0] >= 199


def test_empty_tables(nothing):
    assert exact_dedup(nothing).count() == shard_rows(nothing, [1.0, 1.0]).count() == mix(nothing).count() == 0
    assert secret_report(find_secrets(nothing)).count() == take_mix(nothing).count() == 0
