"""Quality classifier: held-out accuracy and defined cases."""

import random

import numpy as np
import pytest
from conftest import listed, prose

from firmloom.llm.quality import keep_good, monotone, quality_scores


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(400):
        words = prose(1000 + i, rng.randint(30, 200)).split()
        good = rng.random() < 0.7
        if not good:
            words = [w + rng.choice(("###", "$$$", "%%%")) for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", "src", 5, "x"))
        if i % 4:
            labels.append((i, int(good), 0, "x"))
    rows += [(1000, None, None, None, 1, "x"), (1001, "", "en", "s", 1, "x"), (None, prose(1, 50), "en", "s", 1, "x"), (3, rows[3][1], "de", "t", 2, "y")]
    labels += [(5, None, 0, "x"), (None, 1, 0, "x"), (7, labels[0][1], 0, "x"), (9999, 1, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, x int, part string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, x string"), {i: q for i, q, *_ in labels}


def test_held_out_accuracy(corpus):
    docs, labels, known = corpus
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert len(held) > 60 and np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.95
    assert len({r.score for r in rows if r.doc_id == 3}) == 1


def test_only_labels_of_the_fold_count(corpus, spark):
    docs, labels, known = corpus
    import zlib

    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in known.items() if i is not None and q is not None]
    changed = spark.createDataFrame(other, "doc_id bigint, quality int")
    kept = spark.createDataFrame([(i, q) for i, q in known.items() if i is not None and q is not None], "doc_id bigint, quality int")
    assert listed(quality_scores(docs, changed), 4) == listed(quality_scores(docs, kept), 4)


def test_rejected_rows_go(corpus):
    docs, labels, _ = corpus
    good = sorted(repr(r.doc_id) for r in quality_scores(docs, labels).collect() if r.predicted)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(repr(r.doc_id) for r in kept.collect()) == good


def test_few_or_no_labels(corpus, nothing):
    docs, labels, _ = corpus
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_scores(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality_scores(nothing, labels).count() == 0


def test_monotone():
    x, y = monotone(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.4, 0.9]), np.array([1.0, 1.0, 1.0, 2.0, 1.0]))
    assert np.allclose(y, [0.1, 0.4, 0.9]) and (np.diff(x) > 0).all()
