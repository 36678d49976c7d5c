"""Running sums and ranks over orders that no single task could hold.

The largest group is counted first. If one task can sort it (WHOLE rows), one window does. Beyond, a group's order is cut into slices by
quantiles of its key, as many as the count asks for; sums run within a slice, and the totals of the slices before it (a row a
slice) are added. Rows with equal keys are in one slice. What comes out does not depend on the cuts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Rows of a group that one window orders; of a slice, about; slices of a group at most.
WHOLE, SLICE_ROWS, SLICES = 1 << 20, 1 << 17, 4096
#: What may be broadcast, by count and the width of a row.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64


def measured(df: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """The table, marked to be broadcast if its rows, counted, are few enough; the count runs it, so it should be cached or stored."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def joined(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """a with b's other columns, by columns that may be null; with no columns, b has one row."""
    names = {c: f"_k{i}" for i, c in enumerate(by)}
    b = b.withColumnsRenamed(names)
    if not names:
        return a.crossJoin(F.broadcast(b))  # one row
    same = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[k]) for c, k in names.items()])
    return a.join(b, same, how).drop(*names.values())


def largest(df: DataFrame, by: Sequence[str]) -> int:
    """The rows of the largest group; a pass over the columns of by."""
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def sliced(df: DataFrame, by: Sequence[str], key: str, slices: int) -> DataFrame:
    """Adds _slice: in which of about so many even slices of its group's key a row is; they count upwards."""
    cuts = df.groupBy(*by).agg(F.percentile_approx(F.col(key), [i / slices for i in range(1, slices)], max(1000, 4 * slices)).alias("_cuts"))
    inside = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c <= F.col(key)))
    return joined(df, cuts, by).withColumn("_slice", F.when(F.col(key).isNotNull() & F.col("_cuts").isNotNull(), inside).otherwise(F.lit(0))).drop("_cuts")


def running_sums(df: DataFrame, by: Sequence[str], key: str, values: dict[str, Column], ascending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """Adds, for each value, its sum up to the row in the order of key and ties within the group, and with _total the group's.
    The input is read to count its groups, and again: store it if it is costly to make and small."""
    names = list(values)
    df = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    first = F.col(key) if ascending else F.col(key).desc()
    group = [*by] or [F.lit(0)]
    most = largest(df, by)
    if most <= WHOLE:
        own = Window.partitionBy(*group).orderBy(first, *ties).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*group)
        sums = {n: F.sum(f"_v_{n}").over(own) for n in names} | {f"{n}_total": F.sum(f"_v_{n}").over(whole) for n in names}
        return df.withColumns(sums).drop(*[f"_v_{n}" for n in names])
    df = sliced(df, by, key, min(SLICES, max(2, most // SLICE_ROWS)))
    totals = df.groupBy(*by, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    order = F.col("_slice") if ascending else F.col("_slice").desc()
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)  # at most SLICES rows a group
    totals = totals.select(*by, "_slice", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names], *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in names])
    own = Window.partitionBy(*by, "_slice").orderBy(first, *ties).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({n: F.sum(f"_v_{n}").over(own) for n in names}).drop(*[f"_v_{n}" for n in names])
    df = joined(df, totals, [*by, "_slice"])
    return df.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in names}).drop("_slice", *[f"_b_{n}" for n in names])


def numbered(df: DataFrame, by: Sequence[str], key: str, ties: Sequence[str] = (), ascending: bool = True, name: str = "position") -> DataFrame:
    """Adds position, from 1 in each group in the order of key and ties, and position_total, the group's rows."""
    return running_sums(df, by, key, {name: F.lit(1)}, ascending, ties)


def value_counts(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """by, key, n, below (rows of the group with a lesser key), total, avg_rank: of every distinct key; nulls take no part."""
    counts = stored(df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("n")), "counts")
    out = running_sums(counts, by, key, {"upto": F.col("n")})
    below = F.col("upto") - F.col("n")
    return out.select(*by, key, "n", below.alias("below"), F.col("upto_total").alias("total"), (below + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"))


def quantiles(df: DataFrame, by: Sequence[str], key: str, at: dict[str, float]) -> DataFrame:
    """by and a column for each quantile, interpolated between order statistics; a group's values never meet in one task."""
    counts = value_counts(df, by, key)
    aggs = []
    for name, q in at.items():
        place = (F.col("total") - 1) * F.lit(float(q))
        for end, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            aggs.append(F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("n")), F.col(key).cast("double"))).alias(f"_{name}_{end}"))
    out = counts.groupBy(*by).agg(F.first("total").alias("_n"), *aggs)
    part = lambda q: (F.col("_n") - 1) * F.lit(float(q)) - F.floor((F.col("_n") - 1) * F.lit(float(q)))
    return out.select(*by, *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * part(q)).alias(n) for n, q in at.items()])


def ranked(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Adds avg_rank, ties sharing the mean of their positions; nulls have none."""
    return joined(df, value_counts(df, by, key).select(*by, key, "avg_rank"), [*by, key], "left")
