"""RBF support vector machines (L09-L11): the kernel's own dual problem, solved by a cascade, for many points of a grid at once.

A *point* is (size, C, gamma). The training rows of a size are dealt into blocks of BLOCK rows at most, about; a task solves the dual problem of
its block, for every C if the block is small (they share its kernel), and keeps the support vectors. Blocks are merged in pairs and solved again from where
they stood, until one is left (Graf and others, 2004). Then all rows of the size are scored against the support vectors; rows that
violate the optimality conditions join them, in blocks that each hold all support vectors, for another turn, until no row does. What comes out is the solution of the whole problem, not of
a sample or an approximation of the kernel. All points go through each step together: one scan deals the rows of all of them.

Only support vectors travel after the first step. Those of one point meet in one task in the end, SUPPORT at most: beyond that the
function raises, and fourier_svm_scores in classical.py, which needs one scan a step, is the way. Kernel columns are made as they are needed beyond BLOCK rows.

Rows are standardised by the size's own means and deviations; classes are weighted to count alike; y is 1 or 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordering

#: Rows of a block; support vectors of a point; the optimality gap at which a solution stands, and what the check over all rows allows.
BLOCK, SUPPORT, GAP, SLACK = 8192, 50_000, 1e-4, 1e-3
#: Rows up to which a block's kernel is kept in double precision, and is shared by the points that have it; beyond, single.
DOUBLE = 2048
#: Rows up to which a leap solves for its step; iterations beyond, and the share of the residual at which they end.
DIRECT, LEAP, ENOUGH = 2000, 80, 0.02
#: Kernel columns kept by one solver; turns of the cascade.
CACHE_BYTES, TURNS = 256 << 20, 50
SV = "point int, block long, id long, y double, alpha double, intercept double, x array<double>"


class Kernel:
    """Columns of exp(-gamma |a - b|²), all at once for few rows, otherwise as asked for and kept while there is room."""

    def __init__(self, x: np.ndarray, gamma: float):
        self.x, self.gamma, self.square = x, gamma, (x * x).sum(1)
        self.room = max(2, CACHE_BYTES // (8 * max(len(x), 1)))
        self.kept: dict[int, np.ndarray] = {}
        self.whole = (self.against(x) if len(x) <= DOUBLE else self.single()) if len(x) <= BLOCK else None

    def single(self) -> np.ndarray:
        out = np.empty((len(self.x), len(self.x)), np.float32)
        for at in range(0, len(out), 512):
            out[:, at : at + 512] = self.against(self.x[at : at + 512])
        return out

    def against(self, other: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * np.maximum(self.square[:, None] + (other * other).sum(1) - 2 * self.x @ other.T, 0))

    def __getitem__(self, i: int) -> np.ndarray:
        if self.whole is not None:
            return self.whole[i]
        if i not in self.kept:
            if len(self.kept) >= self.room:
                self.kept.pop(next(iter(self.kept)))
            self.kept[i] = self.against(self.x[i : i + 1])[:, 0]
        return self.kept[i]


def slopes(kernel: Kernel, y: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The dual's slope where the solver starts; kernel values of the rows that have weight are made in blocks and not kept."""
    out, some = -np.ones(len(y)), np.flatnonzero(alpha)
    width = max(1, CACHE_BYTES // (32 * max(len(y), 1)))
    for at in range(0, len(some), width):
        k = some[at : at + width]
        out += y * (kernel.against(kernel.x[k]) @ (alpha[k] * y[k]))
    return out


def eased(x: np.ndarray, gamma: float):
    """Solves for the kernel's constant and linear parts, and what is left of its diagonal: the iterations' preconditioner."""
    u = np.exp(-gamma * (x * x).sum(1))[:, None] * np.concatenate([np.ones((len(x), 1)), np.sqrt(2 * gamma) * x], 1)
    rest = max(1 - (u * u).sum(1).mean(), 1e-3)
    inner = np.linalg.inv(u.T @ u + rest * np.eye(u.shape[1]))
    return lambda r: (r - u @ (inner @ (u.T @ r))) / rest


def leap(kernel: Kernel, y: np.ndarray, cap: np.ndarray, alpha: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moves all rows that are between their bounds at once: Newton's step for few, conjugate gradients for many lead to about where their
    slopes are equal; that point is brought back within the bounds and to the same sum of y·alpha, and the dual falls as far as it can on the line there."""
    v, some = -y * slope, np.flatnonzero((alpha > 0) & (alpha < cap))
    if len(some) < 2:
        return alpha, slope
    k = kernel.whole if 2 * len(some) > len(y) else kernel.whole[np.ix_(some, some)]
    held = np.zeros(len(k), k.dtype)

    def times(z):
        if len(k) == len(z):
            return k @ z.astype(k.dtype)
        held[some] = z
        return (k @ held)[some]

    if len(some) <= DIRECT:
        border = np.ones((len(some) + 1,) * 2)
        border[:-1, :-1], border[-1, -1] = kernel.whole[np.ix_(some, some)], 0
        border[np.arange(len(some)), np.arange(len(some))] += 1e-9
        z = np.linalg.solve(border, np.append(v[some], 0))[:-1]
    else:
        ease = eased(kernel.x[some], kernel.gamma)
        flat = ease(np.ones(len(some)))

        def eased_within(r):  # directions keep the sum of y·alpha
            e = ease(r)
            return e - flat * (e.sum() / flat.sum())

        z, r = np.zeros(len(some)), v[some] - v[some].mean()
        p = eased_within(r)
        rp = r @ p
        least = ENOUGH**2 * rp
        for _ in range(LEAP):
            kp = times(p)
            bend = p @ kp
            if bend <= 0 or rp <= least:
                break
            z += rp / bend * p
            r -= rp / bend * kp
            r -= r.mean()
            q = eased_within(r)
            p, rp = q + (r @ q) / rp * p, r @ q
    side, top, aim = y[some], cap[some], alpha[some] + y[some] * z
    want = side @ alpha[some]
    lo, hi = -np.abs(aim).max() - top.max(), np.abs(aim).max() + top.max()
    for _ in range(80):  # the shift that keeps the sum
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if side @ np.clip(aim - mid * side, 0, top) > want else (lo, mid)
    new = np.clip(aim - hi * side, 0, top)
    move = np.zeros(len(y))
    move[some] = new - alpha[some]
    change = y * (kernel.whole @ (y * move).astype(kernel.whole.dtype))
    down, bend = slope @ move, move @ change
    if down >= 0:
        return alpha, slope
    step = min(1.0, -down / max(bend, 1e-300))
    out = alpha + step * move
    out = np.where(out < 1e-10 * cap, 0.0, np.where(out > cap * (1 - 1e-10), cap, out))
    i = int(np.argmax(np.minimum(out, cap - out)))  # what rounding has left of the sum goes to the row with most room
    out[i] -= y[i] * (y @ out - y @ alpha)
    return (out, slope + step * change) if 0 <= out[i] <= cap[i] else (alpha, slope)


def solve(kernel: Kernel, y: np.ndarray, cap: np.ndarray, alpha: np.ndarray | None = None, gap: float = GAP) -> tuple[np.ndarray, float]:
    """alpha and the intercept of the dual problem: pairs of rows that violate optimality most (second-order choice) are moved
    along the line that keeps the sum of y·alpha, with a leap now and then if the kernel is at hand, until the violation is under the gap.
    Slopes are made anew before it counts if the kernel is kept in single precision. y is 1 or -1, cap each row's upper bound."""
    alpha = np.zeros(len(y)) if alpha is None else alpha.copy()
    v, exact, n = -y * slopes(kernel, y, alpha), True, 0

    def bars():
        """Added to v: which rows may go up, which down."""
        up, low = np.where(y > 0, alpha < cap, alpha > 0), np.where(y > 0, alpha > 0, alpha < cap)
        return np.where(up, 0.0, -np.inf), np.where(low, 0.0, np.inf)

    above, below = bars()
    far, gain, bend = np.empty_like(v), np.empty_like(v), np.empty_like(v)
    while len(y):
        i = int(np.argmax(np.add(v, above, out=far)))
        most = far[i]
        least = np.add(v, below, out=far).min()
        if most == -np.inf or least == np.inf:
            return alpha, float(y[0])
        if most - least < gap:
            if not exact:
                v, exact = -y * slopes(kernel, y, alpha), True
                continue
            free = (above == 0) & (below == 0)
            return alpha, float(v[free].mean() if free.any() else (most + least) / 2)
        exact, n = kernel.whole is None or len(y) <= DOUBLE, n + 1
        if kernel.whole is not None and n > len(y) and n % (len(y) // 8 + 50) == 0:
            alpha, slope = leap(kernel, y, cap, alpha, -y * v)
            v = -y * slope
            above, below = bars()
            continue
        own = kernel[i]
        np.subtract(most, far, out=far)  # -inf for rows that can't go down
        np.maximum(far, 0, out=gain)
        np.multiply(own, -2.0, out=bend)
        bend += 2.0
        np.maximum(bend, 1e-12, out=bend)
        gain *= gain
        gain /= bend
        j = int(np.argmax(gain))
        room_i = cap[i] - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else cap[j] - alpha[j]
        step = min(far[j] / bend[j], room_i, room_j)
        for k, move in ((i, y[i] * step), (j, -y[j] * step)):
            a, edge = alpha[k] + move, 1e-10 * cap[k]  # what rounding leaves beside a bound is the bound
            alpha[k] = 0.0 if a < edge else cap[k] if a > cap[k] - edge else a
            rise, fall = (alpha[k] < cap[k], alpha[k] > 0) if y[k] > 0 else (alpha[k] > 0, alpha[k] < cap[k])
            above[k], below[k] = 0.0 if rise else -np.inf, 0.0 if fall else np.inf
        np.subtract(own, kernel[j], out=gain)
        gain *= step
        v -= gain
    return alpha, 0.0


@dataclass
class Grid:
    """The points, each (size number, C, gamma); for each size: rows, its rows by class, means, deviations; and every point's
    support vectors (SV, one block each)."""

    points: list[tuple[int, float, float]]
    rows: list[int]
    classes: list[tuple[int, int]]
    mean: np.ndarray
    dev: np.ndarray
    vectors: DataFrame

    def cap(self, point: int, y: np.ndarray) -> np.ndarray:
        size, c, _ = self.points[point]
        n0, n1 = self.classes[size]
        return np.where(y > 0, c * (n0 + n1) / (2 * max(n1, 1)), c * (n0 + n1) / (2 * max(n0, 1)))


def levelled(train: DataFrame, sizes) -> tuple[DataFrame, list[int]]:
    """id, x, y, level (the first size, in rising order, that a row is in: stratified samples by hash, each within the next), and the sizes' rows."""
    rows = ordering.numbered(train.withColumn("_u", F.xxhash64("filename")), ["y"], "_u", ["filename"]).persist()
    total = rows.count()
    share = sorted({min(n or total, total) for n in sizes})
    level = F.coalesce(*[F.when(F.col("position") <= F.ceil(F.col("position_total") * F.lit(n / max(total, 1))), F.lit(i)) for i, n in enumerate(share)], F.lit(len(share)))
    return rows.select(F.col("filename").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"), level.alias("level")), share


def moments(rows: DataFrame, n_sizes: int) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Rows, classes, means and deviations of each size, in one scan; sums are taken around one row, so they keep their digits."""
    first = rows.select("x").first()
    about = np.array(first.x if first else [], float)
    d = len(about)

    def run(batches):
        import pyarrow as pa

        total = np.zeros((n_sizes, 2 + 2 * d))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d) - about
            y, level = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            cells = np.concatenate([(y == 0)[:, None], (y == 1)[:, None], x, x * x], 1)
            for k in range(n_sizes):
                total[k] += cells[level <= k].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    out = np.zeros(n_sizes * (2 + 2 * d))
    for r in rows.select("x", "y", "level").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # a size's numbers
        out[r.i] = r.v
    out = out.reshape(n_sizes, -1)
    n = np.maximum(out[:, :2].sum(1), 1)[:, None]
    mean = out[:, 2 : 2 + d] / n
    dev = np.sqrt(np.maximum(out[:, 2 + d :] / n - mean**2, 0))
    return [int(v) for v in out[:, :2].sum(1)], [(int(a), int(b)) for a, b in out[:, :2]], mean + about, np.where(dev > 0, dev, 1.0)


def solved(grid: Grid, rows: DataFrame) -> DataFrame:
    """The support vectors of every (points, block): points are one's number or, before the first step, all that share a kernel."""
    support, gap = SUPPORT, GAP

    def run(key, table):
        import pyarrow as pa

        ids, side, y, alpha = (table.column(c).to_numpy() for c in ("id", "side", "y", "alpha"))
        order = np.lexsort((side, ids))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]  # a row that came from both sides counts once
        if len(order) < len(ids):  # one side's solution is where to start then
            alpha = np.where(side == 0, alpha, 0.0)
        ids, y, alpha = ids[order], y[order], alpha[order]
        x = np.stack(table.column("x").to_numpy()[order]).astype(float)
        began = alpha if abs((alpha * y).sum()) < 1e-9 else None
        points = [int(p) for p in str(key[0].as_py()).split(",")]
        kernel, out = Kernel(x, grid.points[points[0]][2]), []
        for p in points:
            alpha, b = solve(kernel, y, grid.cap(p, y), began if len(points) == 1 else None, gap)
            keep = np.flatnonzero(alpha > 0)
            if len(keep) > support:
                raise ValueError(f"{len(keep)} support vectors in one task; the bound is {support}")
            if not len(keep):  # one class only: what stays is the intercept
                keep = np.zeros(1, int)
            out.append(pa.table({"point": pa.array(np.full(len(keep), p), pa.int32()), "block": pa.array(np.full(len(keep), key[1].as_py()), pa.int64()), "id": ids[keep], "y": y[keep], "alpha": alpha[keep], "intercept": np.full(len(keep), b), "x": pa.array(list(x[keep]), pa.list_(pa.float64()))}))
        return pa.concat_tables(out)

    return rows.groupBy("points", "block").applyInArrow(run, SV)


def decisions(grid: Grid, vectors: DataFrame, rows: DataFrame, points: list[int]) -> DataFrame:
    """point, id, score: the decision values of the rows (id, x, as they came) at the points; a row block meets each of a point's
    vector blocks, and the parts are summed."""
    packed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, rows.count() // 1024 + 1))).alias("rows")).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("x")).alias("xs"))
    of = F.pmod(F.xxhash64("id"), F.lit(max(1, max(grid.rows, default=1) // 1024 + 1)))
    held = vectors.groupBy("point", of.alias("part")).agg(F.flatten(F.collect_list("x")).alias("vs"), F.collect_list(F.col("alpha") * F.col("y")).alias("ws"), F.max("intercept").alias("b"))
    first = held.groupBy("point").agg(F.min("part").alias("one"))  # the intercept is added once
    held = held.join(first, "point").withColumn("b", F.when(F.col("part") == F.col("one"), F.col("b")).otherwise(0.0)).drop("one", "part").persist()
    each = packed.withColumn("point", F.explode(F.array(*[F.lit(p) for p in points])))
    both = each.join(ordering.measured(held, 1024 * 8 * (grid.mean.shape[1] + 1)), "point").select("point", "ids", "xs", "vs", "ws", "b")
    grid_points, mean, dev = grid.points, grid.mean, grid.dev

    def run(batches):
        import pyarrow as pa

        for t in batches:
            for k in range(t.num_rows):
                point, ids, xs, vs, ws, b = (t.column(i)[k] for i in range(6))
                point = point.as_py()
                size, _, gamma = grid_points[point]
                d = mean.shape[1]
                x = (xs.values.to_numpy(zero_copy_only=False).reshape(-1, d) - mean[size]) / dev[size]
                v = vs.values.to_numpy(zero_copy_only=False).reshape(-1, d)
                score = Kernel(x, gamma).against(v) @ ws.values.to_numpy(zero_copy_only=False) + b.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), point), pa.int32()), ids.values, pa.array(score)], ["point", "id", "score"])

    return both.mapInArrow(run, "point int, id long, score double").groupBy("point", "id").agg(F.sum("score").alias("score"))


def fit(train: DataFrame, points: list[tuple], stored) -> Grid:
    """Fits every point (rows or None for all, C, gamma) on train (filename, x, y). stored(df) cuts the lineage between steps, with
    a table or checkpoint that all executors reach."""
    rows, sizes = levelled(train, {p[0] for p in points})
    rows = stored(rows)
    total = sizes[-1]
    n, classes, mean, dev = moments(rows, len(sizes))
    grid = Grid([(sizes.index(min(s or total, total)), float(c), float(g)) for s, c, g in points], n, classes, mean, dev, None)
    blocks = [1 << max(0, int(np.ceil(np.log2(max(1, k / BLOCK))))) for k in n]
    # points that share a small kernel share a task; the others have one each
    shared: dict = {}
    for i, (s, _, g) in enumerate(grid.points):
        shared.setdefault((s, g, i if n[s] > DOUBLE * blocks[s] else None), []).append(str(i))
    kernels, names = list(shared), [",".join(v) for v in shared.values()]
    cells = [F.struct(F.lit(name).alias("points"), F.lit(s).alias("size"), F.lit(blocks[s]).alias("blocks"), F.array(*[F.lit(float(v)) for v in mean[s]]).alias("m"), F.array(*[F.lit(float(v)) for v in dev[s]]).alias("d")) for name, (s, *_) in zip(names, kernels)]
    normed = F.zip_with(F.zip_with("x", F.col("k.m"), lambda a, b: a - b), F.col("k.d"), lambda a, b: a / b)
    dealt = rows.select("*", F.explode(F.array(*cells)).alias("k")).where(F.col("level") <= F.col("k.size"))
    dealt = dealt.select(F.col("k.points").alias("points"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("k.blocks")).alias("block"), "id", F.lit(0).alias("side"), (F.col("y") * 2.0 - 1).alias("y"), F.lit(0.0).alias("alpha"), normed.alias("x"))
    tasks = 4 * sum(blocks[s] for s, *_ in kernels)  # so that long ones seldom share a task
    vectors = stored(solved(grid, dealt.repartition(min(tasks, 2000), "points", "block")))

    def by_point(ps, value):
        return F.create_map(*[c for p in ps for c in (F.lit(p), value(grid.points[p][0]))])[F.col("point")]

    def row(stat):
        return lambda size: F.array(*[F.lit(float(v)) for v in stat[size]])

    final, left, open_, most = [], vectors, list(range(len(grid.points))), max(blocks)
    for _ in range(TURNS):
        while most > 1:  # pairs of blocks
            half = F.floor(F.col("block") / 2)
            left = stored(solved(grid, left.select(F.col("point").cast("string").alias("points"), half.alias("block"), "id", F.pmod("block", F.lit(2)).cast("int").alias("side"), "y", "alpha", "x")))
            most //= 2
        check = [p for p in open_ if blocks[grid.points[p][0]] > 1]  # one block is the whole problem
        worse = {}
        if check:
            missed = decisions(grid, left, rows.select("id", "x"), check).join(rows, "id").where(F.col("level") <= by_point(check, F.lit))
            missed = missed.join(left.select("point", "id"), ["point", "id"], "left_anti").where((F.col("y") * 2 - 1) * F.col("score") < 1 - SLACK)
            missed = stored(missed.select("point", "id", "y", "x"))
            worse = {r.point: 1 << max(0, int(np.ceil(np.log2(r["count"] / BLOCK)))) for r in missed.groupBy("point").count().collect()}  # a row a point
        final.append(left.where(~F.col("point").isin(list(worse))) if worse else left)
        if not worse:
            break
        # every block of violators gets all support vectors, so no turn undoes another
        open_, most = sorted(worse), max(worse.values())
        into = F.create_map(*[F.lit(v) for kv in worse.items() for v in kv])[F.col("point")]
        x = F.zip_with(F.zip_with("x", by_point(open_, row(mean)), lambda a, b: a - b), by_point(open_, row(dev)), lambda a, b: a / b)
        more = missed.select("point", F.pmod(F.xxhash64("id"), into).alias("block"), "id", (F.col("y") * 2.0 - 1).alias("y"), F.lit(0.0).alias("alpha"), x.alias("x"))
        kept = left.where(F.col("point").isin(open_)).select("point", F.explode(F.sequence(F.lit(0), into - 1)).alias("block"), "id", "y", "alpha", "x")
        left = stored(solved(grid, kept.unionByName(more).select(F.col("point").cast("string").alias("points"), "block", "id", F.lit(0).alias("side"), "y", "alpha", "x")))
    else:
        raise RuntimeError(f"{len(open_)} points violate optimality after {TURNS} turns")
    grid.vectors = stored(reduce(DataFrame.unionByName, final))
    return grid


def resumed(train: DataFrame, c: float, gamma: float, vectors: DataFrame) -> Grid:
    """A point fitted on all of train before, from its support vectors."""
    rows, sizes = levelled(train, {None})
    n, classes, mean, dev = moments(rows, len(sizes))
    return Grid([(0, float(c), float(gamma))], n, classes, mean, dev, vectors)


def scores(grid: Grid, rows: DataFrame, key: str = "filename") -> DataFrame:
    """point, the key, score of rows (key, x) at every point."""
    out = decisions(grid, grid.vectors, rows.select(F.col(key).cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")), list(range(len(grid.points))))
    return out.withColumnRenamed("id", key)
