import random

import numpy as np
import pytest
from scorelake.llm import toxicity as t
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    words = ["".join(r.choice(["th", "er", "on", "an", "re", "nd", "ha"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    out = []
    for i in range(900):
        w = [r.choice(words) for _ in range(r.randrange(5, 120))]
        bad = i % 5 == 0
        for _ in range(max(1, len(w) // 12) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "worthless", "pathetic"]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_held_out_accuracy_and_misspellings(spark, make_docs, rows):
    docs = make_docs([(i, x) for i, x, _ in rows] + [(2000, None), (2001, ""), (None, "some text")])
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows] + [(None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = t.fit(docs, labels)
    got = {r.doc_id: r.score for r in t.scored(docs.withColumn("score", F.lit(1)), model).collect()}
    held = [r.doc_id for r in docs.where(t.held_out()).collect()]
    y = {i: v for i, _, v in rows}
    assert np.mean([(got[i] >= t.THRESHOLD) == bool(y[i]) for i in held if i in y]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[2000] == got[2001] < 0.5
    a, b, c = model.word_logits(["worthlesss", "pathetik", "thereon"])
    assert a > c and b > c
    kept = {r.doc_id for r in t.keep_clean(docs, labels).collect()}
    assert kept == {i for i, s in got.items() if s < t.THRESHOLD}


def test_batches_do_not_matter_and_training_repeats(rows):
    texts, y = [r[1] for r in rows[:200]], [r[2] for r in rows[:200]]
    m, n = t.train(*t.bags(texts), y), t.train(*t.bags(texts), y)
    assert np.allclose(m.score(texts), n.score(texts))
    assert np.allclose(m.score(texts), np.concatenate([m.score([x]) for x in texts]))


def test_one_class_and_empty(spark, make_docs):
    docs = make_docs([(1, "x"), (2, "y")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in t.scored(docs, t.fit(docs, labels)).collect()} == {0.0}
    assert t.scored(docs.where(F.lit(False)), t.Model()).count() == 0


def test_bags_and_scores_match_plain_sums():
    """The definition word by word: means of n-gram vectors, means of words with PRIOR zero words, a softmax of two inputs."""
    texts = ["Worthless, worthless idiots!", "", None, "a b c don't " * 40, "x" * 500 + " ok"]
    r = np.random.default_rng(4)
    vectors, out = r.normal(0, 1, (t.BUCKETS, t.DIM)), r.normal(0, 1, (t.DIM, 2))
    model = t.Model(vectors, out[:, 1] - out[:, 0], 0.3)
    ends, bucket, weight = t.bags(texts)
    for i, text in enumerate(texts):
        total, words = np.zeros(t.DIM), t.words_of(text)
        for w in words:
            _, to = t.grams([w], t.SIZES, t.BUCKETS, whole=True)
            total += vectors[to].mean(0)
        z = total / (len(words) + t.PRIOR) @ out + [0, 0.3]
        want = np.exp(z[1]) / np.exp(z).sum()
        assert abs(model.score([text])[0] - want) < 1e-9
        own = slice(ends[i], ends[i + 1])
        assert np.allclose((vectors[bucket[own]] * weight[own, None]).sum(0), total / (len(words) + t.PRIOR), atol=1e-4)
        assert len(set(bucket[own].tolist())) == ends[i + 1] - ends[i]


def test_repeated_ids_are_learned_from_once_and_long_texts_are_whole(spark, make_docs, rows):
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    once, twice = make_docs([(i, x) for i, x, _ in rows]), make_docs([(i, x) for i, x, _ in rows for _ in range(2)])
    a, b = t.fit(once, labels), t.fit(twice.unionByName(make_docs([(rows[1][0], "~ later text")])), labels)
    assert np.allclose(a.table, b.table)
    long = (rows[1][1] + " ") * 2_000
    x, y = (r.score for r in t.scored(make_docs([(1, long + "idiot worthless pathetic " * 40_000), (2, long)]), a).orderBy("doc_id").collect())
    assert x > y
    assert t.fit(once.where(F.lit(False)), labels).table is None
