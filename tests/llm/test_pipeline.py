"""The pipeline, stage by stage, against plain definitions on the smallest tables."""

from collections import Counter

import brute
from conftest import listed, prose

import corpus_pipeline
from firmloom.llm.common import stage, table
from firmloom.llm.mixing import mix
from firmloom.llm.quality import quality_scores

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    scores = quality_scores(docs, table(spark, FOLDER, "labels")).collect()
    good = {r.doc_id for r in scores if r.predicted}
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]

    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    first = stage(steps["quality"](spark, docs, FOLDER))
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert {i for i, _ in rows} == good and len(rows) == len(good) and first.columns == columns

    second = stage(steps["near_duplicates"](spark, first, FOLDER))
    one = {c for i, n, c in brute.jaccard_components(rows, 80, 5)}
    assert sorted(r.doc_id for r in second.collect()) == sorted(one) and second.columns == columns

    third = stage(steps["decontamination"](spark, second, FOLDER))
    clean = [i for i, *_, hit in brute.contamination([(r.doc_id, r.text) for r in second.collect()], items) if not hit]
    assert sorted(r.doc_id for r in third.collect()) == sorted(clean) and third.columns == columns

    fourth = stage(steps["mixing"](spark, third, FOLDER))
    want = {r.doc_id: r.taken // r.size for r in mix(third).collect() if r.taken}
    assert Counter(r.doc_id for r in fourth.collect()) == want and fourth.columns == columns

    last = steps["sharding"](spark, fourth, FOLDER).collect()
    assert len(last) == fourth.count()
    assert sorted(map(tuple, last)) == sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()))


def test_stages_on_odd_tables(spark, docs, pairs):
    """Nulls, repeats, ties and long texts; columns with names that the stages use; no rows at all."""
    clash = docs.selectExpr("*", "doc_id as __row", "source as __key", "text as whole", "doc_id as found_key")
    cells = lambda df: listed(df.select("doc_id", "text"))
    for name, step in corpus_pipeline.STAGES:
        plain, odd = step(spark, docs, FOLDER), step(spark, clash, FOLDER)
        if name == "sharding":
            assert listed(odd) == listed(plain) and odd.count() == docs.count()
        else:
            assert odd.columns == clash.columns and plain.columns == docs.columns and cells(odd) == cells(plain)
            assert odd.filter("not (doc_id <=> __row and text <=> whole and source <=> __key and doc_id <=> found_key)").isEmpty()
        if name == "near_duplicates":
            assert {r.doc_id for r in odd.collect()} == {c for *_, c in brute.jaccard_components(pairs, 80, 5)}
        assert step(spark, clash.limit(0), FOLDER).count() == 0


def test_near_duplicates_of_five_words(spark):
    """Copies whose similarity is 0.8 or more in five words but below 0.9 in three."""
    rows = []
    for k in range(6):
        base = prose(300 + k, 200).split()
        swapped, longer = list(base), list(base)
        for at in (30, 80, 130, 180):
            swapped[at] = f"other{at}"
        longer[100:100] = [f"more{i}" for i in range((20, 30, 40)[k % 3])]
        fewer = [w if i % 20 else f"gap{i}" for i, w in enumerate(base)]  # below 0.8: stays
        rows += [(10 * k + i, " ".join(t)) for i, t in enumerate((base, swapped, longer, fewer))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, FOLDER).collect())
    assert kept == sorted({c for *_, c in brute.jaccard_components(rows, 80, 5)})
    assert kept == sorted(10 * k + i for k in range(6) for i in (0, 3))
    assert len({c for *_, c in brute.jaccard_components(rows)}) == len(rows)
