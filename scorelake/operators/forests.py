"""Balanced random forests (L12-L14): trees by levels while a node is large, then each node's rows to one task for its subtree.

Features become bins between BINS quantiles, rows packed blocks of bytes. Nodes of more than LOCAL rows are split by distributed
histograms: tasks count (node, feature, bin, class) over their blocks, a group sums a node's counts and chooses, and a level is one job;
what reaches the driver is a row a node split so. The rows of every other node, LOCAL at most, go to a task of its own, which
grows the subtree level by level, all nodes of a level in one histogram. Dense counts for every small node are so never shuffled, and no
model stands on the driver: subtrees are rows of a stored table, and rows to score go to the subtrees they reach.

Each tree draws its rows by Poisson weights from a hash of the row's key, and a root of the features for each node; classes are weighted
to count alike; splits take the greatest decrease of Gini impurity. Results do not depend on partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .bootstrap import poisson

#: Bins of a feature; rows of a node that one task may grow; rows of a packed block; trees that a task deals at once.
BINS, LOCAL, BLOCK, TREES = 32, 20_000, 4096, 25
#: Nodes whose histograms are made at once; fractions are summed as whole numbers of this unit, so their order is of no account.
NODES, UNIT = 1024, 2.0**-40
SUBTREE = "tree int, node long, feature binary, cut binary, left binary, share binary, gains array<double>"


@dataclass
class Forest:
    """Splits of large nodes by tree (nodes' numbers, features, bins), the subtrees below them (SUBTREE), and the features' bins."""

    trees: int
    depth: int
    edges: np.ndarray
    top: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    gains: np.ndarray
    subtrees: DataFrame

    def getMaxDepth(self) -> int:
        return self.depth

    def importances(self) -> np.ndarray:
        """Each tree's decreases of impurity, made to sum to one, averaged."""
        per = self.gains.copy()
        sums = self.subtrees.select("tree", F.posexplode("gains").alias("i", "v")).groupBy("tree", "i").agg(F.sum("v").alias("v"))
        for r in sums.collect():  # trees x features numbers
            per[r.tree, r.i] += r.v
        per = per[per.sum(1) > 0]
        total = (per / per.sum(1, keepdims=True)).sum(0) if len(per) else np.zeros(self.gains.shape[1])
        return total / (total.sum() or 1.0)


def packed(rows: DataFrame, edges: np.ndarray, key: str, label: str | None = None) -> DataFrame:
    """ids, bins, y: blocks of rows as bytes."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1).astype(np.uint8)
                y = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (b.column(0).to_numpy(zero_copy_only=False), bins, y)], ["ids", "bins", "y"])

    some = rows.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.col("x").cast("array<double>").alias("x"), (F.col(label) if label else F.lit(0)).cast("int").alias("y"))
    return some.mapInArrow(run, "ids binary, bins binary, y binary")


def edges_of(rows: DataFrame, d: int) -> np.ndarray:
    """d x (BINS - 1): each feature's inner quantiles, infinite where fewer are different."""
    at = [i / BINS for i in range(1, BINS)]
    got = rows.select(*[F.percentile_approx(F.col("x")[i].cast("double"), at, 10_000).alias(f"q{i}") for i in range(d)]).first()
    out = np.full((d, BINS - 1), np.inf)
    for i in range(d):
        v = np.unique(got[i] or [])
        out[i, : len(v)] = v
    return out


def routed(bins: np.ndarray, splits) -> np.ndarray:
    """The node below the splits that each row reaches; the root is 1, children are 2 i and 2 i + 1."""
    node = np.ones(len(bins), np.int64)
    if splits is None:
        return node
    ids, feature, cut = splits
    while True:
        at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
        hit = np.flatnonzero(ids[at] == node)
        if not len(hit):
            return node
        node[hit] = 2 * node[hit] + (bins[hit, feature[at[hit]]] > cut[at[hit]])


def drawn(nodes: int, d: int, *seed: int) -> np.ndarray:
    """Nodes x features: for each node a root of all features, without repeats."""
    keys = np.random.default_rng(list(seed)).random((nodes, d))
    return np.argsort(keys, axis=1)[:, : math.ceil(math.sqrt(d))]


def histograms(bins, y, w, node, features):
    """Nodes x features x bins x classes: sums of the rows' draws; node is each row's place among the nodes."""
    m, k = features.shape
    code = (node[:, None] * k + np.arange(k)) * BINS + bins[np.arange(len(bins))[:, None], features[node]]
    return np.bincount((code * 2 + y[:, None]).ravel(), np.repeat(w, k), m * k * BINS * 2).reshape(m, k, BINS, 2)


def best(h: np.ndarray, weight) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the place of its best feature, the bin (it goes left) and the decrease of weighted impurity, zero if none parts it."""
    left = np.cumsum(h, 2)[:, :, :-1]
    total = h[:, :1].sum(2, keepdims=True)
    right = total - left
    a, b, p = left * weight, right * weight, total * weight
    impurity = lambda v: 2 * v[..., 0] * v[..., 1] / np.maximum(v.sum(-1), 1e-300)
    gain = np.where((left.sum(-1) > 0) & (right.sum(-1) > 0), impurity(p) - impurity(a) - impurity(b), 0.0)
    flat = gain.reshape(len(h), -1)
    at = flat.argmax(1)
    most = flat[np.arange(len(h)), at]
    return at // (BINS - 1), at % (BINS - 1), np.where(most > 1e-9, most, 0.0)


def grown(bins, y, w, weight, depth: int, seed: tuple[int, ...]):
    """A subtree: for each node its feature (-1: a leaf), bin, left child (the right one follows) and share of class 1; and the
    features' decreases of impurity. depth is how many levels may still follow."""
    d = bins.shape[1]
    gains = np.zeros(d)
    out, at, rows, level, made = [], np.zeros(len(bins), np.int64), np.arange(len(bins)), 0, 1
    while True:
        m = made
        both = np.stack([np.bincount(at, w[rows] * (y[rows] == c), m) for c in (0, 1)], 1)
        weighted = both * weight
        share = weighted[:, 1] / np.maximum(weighted.sum(1), 1e-300)
        feature, cut, left = np.full(m, -1, np.int16), np.zeros(m, np.uint8), np.full(m, -1, np.int32)
        mixed = np.flatnonzero((both > 0).all(1)) if level < depth else np.zeros(0, int)
        if len(mixed):
            chosen = drawn(len(mixed), d, *seed, level)
            place = np.full(m, -1)
            place[mixed] = np.arange(len(mixed))
            of = place[at]
            rows, of = rows[of >= 0], of[of >= 0]
            order = np.argsort(of, kind="stable")
            rows, of = rows[order], of[order]
            for s in range(0, len(mixed), NODES):
                lo, hi = np.searchsorted(of, [s, s + NODES])
                r, mine = rows[lo:hi], chosen[s : s + NODES]
                j, c, g = best(histograms(bins[r], y[r], w[r], of[lo:hi] - s, mine), weight)
                f, ids = mine[np.arange(len(mine)), j], mixed[s : s + NODES]
                yes = g > 0
                feature[ids[yes]], cut[ids[yes]] = f[yes], c[yes]
                np.add.at(gains, f[yes], g[yes])
        split = np.flatnonzero(feature >= 0)
        left[split] = 2 * np.arange(len(split))  # within the next level
        out.append((feature, cut, left, share))
        if not len(split):
            break
        node = mixed[of]
        keep = feature[node] >= 0
        rows, node = rows[keep], node[keep]
        at = left[node] + (bins[rows, feature[node]] > cut[node])
        made, level = 2 * len(split), level + 1
    start = 0
    for feature, _, left, _ in out:
        start += len(feature)
        left[left >= 0] += start
    return [np.concatenate(v) for v in zip(*out)], gains


def walked(bins, feature, cut, left, share) -> np.ndarray:
    node = np.zeros(len(bins), np.int64)
    while True:
        go = np.flatnonzero(feature[node] >= 0)
        if not len(go):
            return share[node]
        n = node[go]
        node[go] = left[n] + (bins[go, feature[n]] > cut[n])


def unpacked(batch, k: int, d: int):
    ids, bins, y = (batch.column(i)[k].as_py() for i in range(3))
    return np.frombuffer(ids, np.int64), np.frombuffer(bins, np.uint8).reshape(-1, d), np.frombuffer(y, np.uint8)


def dealt(blocks: DataFrame, trees: int) -> DataFrame:
    """Each block once for every TREES trees, over the tasks."""
    each = blocks.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(trees - 1), F.lit(TREES))))
    return each.repartition(max(8, min(4096, each.count() // 4)))


def fit(train: DataFrame, weights: tuple[float, float], trees: int, seed: int, depth: int, key: str = "filename") -> Forest:
    """Rows carry the key, x and y; weights are those of the classes 0 and 1."""
    first = train.select("x").first()
    d = len(first[0]) if first else 0
    if not d:
        raise ValueError("a forest needs rows with features")
    train = stored(train.select(key, "x", "y"))
    edges, total, weight = edges_of(train, d), train.count(), np.array(weights)
    blocks = stored(packed(train, edges, key, "y"))
    top: dict = {}
    gains, splits = np.zeros((trees, d)), {}
    large = {t: np.ones(1, np.int64) for t in range(trees)} if total > LOCAL else {}
    several = dealt(blocks, trees) if trees else blocks
    draws = lambda t, ids: poisson([seed * 100_003 + t], ids)[0]

    for level in range(depth):
        if not large:
            break

        def counted(batches, top=dict(top), large=large):
            import pyarrow as pa

            for b in batches:
                for k in range(b.num_rows):
                    ids, bins, y = unpacked(b, k, d)
                    out = []
                    for t in range(b.column(3)[k].as_py(), min(b.column(3)[k].as_py() + TREES, trees)):
                        if t not in large:
                            continue
                        w, node = draws(t, ids), routed(bins, top.get(t))
                        at = np.minimum(np.searchsorted(large[t], node), len(large[t]) - 1)
                        r = np.flatnonzero((w > 0) & (large[t][at] == node))
                        if not len(r):
                            continue
                        chosen = np.concatenate([drawn(1, d, seed, t, int(n)) for n in large[t]])
                        h = histograms(bins[r], y[r], w[r].astype(float), at[r], chosen)
                        # rows too, by class and side of each bin: how large the children are
                        n = histograms(bins[r], y[r], np.ones(len(r)), at[r], chosen)
                        out += [(t, int(v), h[i].tobytes(), n[i].sum(-1).tobytes()) for i, v in enumerate(large[t])]
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], s) for i, s in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["tree", "node", "h", "n"])

        def choose(key, table):
            import pyarrow as pa

            t, node = (k.as_py() for k in key)
            chosen = drawn(1, d, seed, t, node)
            h, n = (sum(np.frombuffer(v.as_py()) for v in table.column(c)) for c in ("h", "n"))
            j, c, g = best(h.reshape(1, chosen.shape[1], BINS, 2), weight)
            n = n.reshape(chosen.shape[1], BINS)[j[0]]
            left = int(n[: c[0] + 1].sum())
            return pa.table({"tree": pa.array([t], pa.int32()), "node": [node], "feature": pa.array([int(chosen[0, j[0]])], pa.int32()), "cut": pa.array([int(c[0])], pa.int32()), "gain": [float(g[0])], "nl": [left], "nr": [int(n.sum()) - left]})

        sums = several.mapInArrow(counted, "tree int, node long, h binary, n binary")
        found = sums.groupBy("tree", "node").applyInArrow(choose, "tree int, node long, feature int, cut int, gain double, nl long, nr long").collect()  # a row a large node
        large = {}
        for r in found:
            if r.gain > 0:
                splits.setdefault(r.tree, {})[r.node] = (r.feature, r.cut)
                gains[r.tree, r.feature] += r.gain
                large.setdefault(r.tree, []).extend(c for c, n in ((2 * r.node, r.nl), (2 * r.node + 1, r.nr)) if n > LOCAL)
        large = {t: np.array(sorted(v), np.int64) for t, v in large.items() if v}
        top = {t: (np.array(sorted(s), np.int64), *(np.array([s[n][i] for n in sorted(s)], np.int64) for i in (0, 1))) for t, s in splits.items()}

    def below(batches):
        """The drawn rows of each block by tree and node."""
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                ids, bins, y = unpacked(b, k, d)
                for t in range(b.column(3)[k].as_py(), min(b.column(3)[k].as_py() + TREES, trees)):
                    w, node, out = draws(t, ids), routed(bins, top.get(t)), []
                    for n in np.unique(node[w > 0]):
                        r = (w > 0) & (node == n)
                        out.append((t, int(n), bins[r].tobytes(), y[r].tobytes(), w[r].astype(np.uint8).tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], s) for i, s in enumerate((pa.int32(), pa.int64(), *3 * [pa.binary()]))], ["tree", "node", "bins", "y", "w"])

    def subtree(key, table):
        import pyarrow as pa

        t, node = (k.as_py() for k in key)
        bins, y, w = (np.frombuffer(b"".join(v.as_py() for v in table.column(c)), np.uint8) for c in ("bins", "y", "w"))
        (feature, cut, left, share), g = grown(bins.reshape(-1, d), y, w.astype(float), weight, depth - (node.bit_length() - 1), (seed, t, node))
        return pa.table({"tree": pa.array([t], pa.int32()), "node": [node], **{n: pa.array([v.tobytes()], pa.binary()) for n, v in (("feature", feature), ("cut", cut), ("left", left), ("share", share))}, "gains": pa.array([g.tolist()], pa.list_(pa.float64()))})

    reached = several.mapInArrow(below, "tree int, node long, bins binary, y binary, w binary")
    return Forest(trees, depth, edges, top, gains, stored(reached.groupBy("tree", "node").applyInArrow(subtree, SUBTREE)))


def scores(model: Forest, rows: DataFrame) -> DataFrame:
    """The rows with score, the trees' mean share of class 1."""
    row = "_row"
    while row in rows.columns:
        row += "_"
    rows = stored(rows.withColumn(row, F.monotonically_increasing_id()))
    d, top, trees, edges = len(model.edges), model.top, model.trees, model.edges

    def reach(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                ids, bins, _ = unpacked(b, k, d)
                for t in range(b.column(3)[k].as_py(), min(b.column(3)[k].as_py() + TREES, trees)):
                    node, out = routed(bins, top.get(t)), []
                    for n in np.unique(node):
                        out.append((t, int(n), ids[node == n].tobytes(), bins[node == n].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], s) for i, s in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["tree", "node", "ids", "bins"])

    def vote(batches):
        import pyarrow as pa

        for b in batches:
            ids, votes = [np.zeros(0, np.int64)], [np.zeros(0)]
            for k in range(b.num_rows):
                i, x, f, c, l, s = (b.column(j)[k].as_py() for j in range(6))
                ids.append(np.frombuffer(i, np.int64))
                votes.append(walked(np.frombuffer(x, np.uint8).reshape(-1, d), np.frombuffer(f, np.int16), np.frombuffer(c, np.uint8), np.frombuffer(l, np.int32), np.frombuffer(s)))
            own, at = np.unique(np.concatenate(ids), return_inverse=True)
            units = np.zeros(len(own), np.int64)
            np.add.at(units, at, np.rint(np.concatenate(votes) / UNIT).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(units)], ["id", "units"])

    reached = dealt(stored(packed(rows, edges, row)), trees).mapInArrow(reach, "tree int, node long, ids binary, bins binary")
    # neither side may go through the driver: Spark's estimates see neither a row's copy for each tree nor how far subtrees are compressed
    both = reached.join(model.subtrees.hint("merge"), ["tree", "node"]).select("ids", "bins", "feature", "cut", "left", "share")
    votes = both.mapInArrow(vote, "id long, units long").groupBy(F.col("id").alias(row)).agg((F.sum("units") * F.lit(UNIT / trees)).alias("score"))
    return rows.join(votes, row).drop(row)
