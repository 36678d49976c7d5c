"""Trees grown by levels and in tasks against plain counts; large nodes, repeated keys, one class."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from scorelake.operators import classical, forests


def plain_best(bins, y, w, features, weight):
    """The greatest decrease of weighted Gini impurity over the features' bins, by the definition."""
    def impurity(rows):
        a, b = (weight[c] * w[rows & (y == c)].sum() for c in (0, 1))
        return 2 * a * b / (a + b) if a + b else 0.0

    everything, most = np.ones(len(y), bool), 0.0
    for f in features:
        for c in range(forests.BINS - 1):
            left = bins[:, f] <= c
            if left.any() and (~left).any():
                most = max(most, impurity(everything) - impurity(left) - impurity(~left))
    return most


def test_splits_by_their_definition_and_leaves_that_are_pure():
    r = np.random.default_rng(4)
    n, d, weight = 300, 9, np.array([0.7, 1.9])
    bins, y, w = r.integers(0, 32, (n, d)).astype(np.uint8), r.integers(0, 2, n).astype(np.uint8), r.integers(1, 4, n).astype(float)
    node, features = r.integers(0, 5, n), forests.drawn(5, d, 1, 2)
    assert features.shape == (5, 3) and all(len(set(f)) == 3 for f in features)
    _, _, gain = forests.best(forests.histograms(bins, y, w, node, features), weight)
    for k in range(5):
        own = node == k
        assert gain[k] == pytest.approx(plain_best(bins[own], y[own], w[own], features[k], weight))
    tree, gains = forests.grown(bins, y, w, weight, 30, (1, 2, 3))
    assert np.array_equal(forests.walked(bins, *tree), y) and gains.sum() > 0
    stump, _ = forests.grown(bins, y, w, weight, 1, (1, 2, 3))
    assert len(stump[0]) == 3 and set(forests.walked(bins, *stump)) == set(stump[3][1:])
    alone, _ = forests.grown(bins, y * 0, w, weight, 30, (1,))
    assert [len(v) for v in alone] == [1] * 4 and alone[3][0] == 0


@pytest.mark.parametrize("local", [20_000, 60])
def test_no_task_holds_a_large_node_and_partitions_do_not_matter(spark, monkeypatch, local):
    monkeypatch.setattr(forests, "LOCAL", local)
    monkeypatch.setattr(forests, "BLOCK", 50)
    r = np.random.default_rng(8)
    y = np.arange(400) % 2
    x = r.normal(0, 1, (400, 9)) + y[:, None] * np.array([2.5, 0, 0, 0, 0, 0, 0, 0, 0])
    rows = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "filename long, x array<double>, y int")
    model = classical.forest(rows, trees=30)
    held = model.subtrees.select("tree", "node").collect()
    assert len(set(held)) == len(held) and {h.tree for h in held} == set(range(30))
    assert (max(h.node for h in held) == 1) == (local > 400) and bool(model.top) == (local < 400)
    got = {v.filename: v.score for v in classical.forest_scores(model, rows).collect()}
    assert len(got) == 400 and np.mean([(got[i] > 0.5) == y[i] for i in got]) > 0.97
    parts = model.importances()
    assert parts.sum() == pytest.approx(1) and parts.argmax() == 0 and len(parts) == 9
    again = classical.forest(rows.repartition(3), trees=30)
    assert {v.filename: v.score for v in classical.forest_scores(again, rows.repartition(2)).collect()} == got
    # rows that repeat a key are scored each, and keep their columns
    twice = classical.forest_scores(model, rows.limit(5).unionByName(rows.limit(5)).withColumn("more", F.lit(1)))
    assert twice.count() == 10 and twice.columns == ["filename", "x", "y", "more", "score"]


def test_rows_and_subtrees_meet_without_a_broadcast(spark):
    """Spark broadcast the side that it took for small, through the driver (F2)."""
    x = np.random.default_rng(3).random((400, 4))
    rows = spark.createDataFrame([(i, v.tolist(), int(v[0] > 0.5)) for i, v in enumerate(x)], "filename long, x array<double>, y int")
    scored = classical.forest_scores(classical.forest(rows, 5), rows)
    got = scored.collect()
    assert len(got) == 400 and all((r.score > 0.5) == bool(r.y) for r in got if abs(r.x[0] - 0.5) > 0.1)
    joins = [line for line in scored._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line and "tree#" in line]
    assert joins and not any("Broadcast" in line for line in joins), joins
