"""Hierarchical weighted hash tree: rows descend regions, racks and shards by weighted hash draws.

At each level a row draws an exponential variate -ln(u)/weight for every child of the node it has reached, u being a hash of
(key, level, child) and the weight the sum of the child's shards' weights, and takes the least: a weighted choice. With R
regions of K racks of S shards that is R + K + S draws a row. A draw depends on nothing but key, child and the child's
weight, so a change of weights moves rows only into, out of and within the nodes on the path whose weights change; other
subtrees exchange no rows. A shard that opens a region of its own, as the 25th does, takes rows only into itself; one added to
a region that is there already may also move rows within that region.

Slots number a shard's rows by doc_id, then checksum and size. Slices of the doc_id range are numbered apart and shifted by
the counts before them, which gives the same numbers whatever the slices.

Defined cases: a null key draws as the empty string and is numbered first; rows with equal keys share a shard; equal rows get
slots in any order; a null text has size 8 and the checksum of the empty text; very long texts are read whole; an empty table
gives an empty table. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, table

#: Shards to a rack and racks to a region, filled in the order of the shard numbers.
RACK, REGION = 4, 3
#: About so many rows to a slice of the slot numbers; a shard's part of a slice is numbered by one task.
SLICE_ROWS, SLICES = 2_000_000, 512


def draw(key: str, level: str, first: str, last: str, weights: list[float]) -> F.Column:
    """The child of a level, from first to last, with the least draw: 52 bits of an MD5 digest, over the child's weight."""
    w = ", ".join(f"{float(x)!r}D" for x in weights)
    u = f"(cast(conv(substr(md5(concat(coalesce(cast(`{key}` as string), ''), ':{level}:', i)), 1, 13), 16, 10) as double) + 1) / 4503599627370497D"
    return F.expr(f"array_min(transform(sequence({first}, {last}), i -> struct(coalesce(-ln({u}) / nullif(get(array({w}), i), 0D), double('infinity')) AS d, i AS i))).i")


def place(df: DataFrame, key: str, weights: list[float], out: str, rack: int = RACK, region: int = REGION) -> DataFrame:
    """The table with the shard of each row as column out: the path of least draws from the root. No row goes to a shard of
    weight 0 while another has some."""
    sums = lambda xs, n: [sum(xs[i : i + n]) for i in range(0, len(xs), n)]
    racks = sums(weights, rack)
    regions = sums(racks, region)
    at_region, at_rack = fresh(df, "_region", "_rack")
    df = df.withColumn(at_region, draw(key, "region", "0", str(len(regions) - 1), regions))
    df = df.withColumn(at_rack, draw(key, "rack", f"{at_region} * {region}", f"least(({at_region} + 1) * {region}, {len(racks)}) - 1", racks))
    return df.withColumn(out, draw(key, "shard", f"{at_rack} * {rack}", f"least(({at_rack} + 1) * {rack}, {len(weights)}) - 1", weights)).drop(at_region, at_rack)


def with_slots(df: DataFrame, shard: str, order: str, cuts: list) -> DataFrame:
    """Gapless numbers from 0 in each shard, in the order of the column order, text_crc32 and size. cuts: where the slices of
    that column begin, but for the first. The table of counts has a row for each shard and slice."""
    before_cut = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    df = df.withColumn("_slice", F.coalesce(F.when(F.col(order).isNotNull(), before_cut), F.lit(0)))
    counts = df.groupBy(shard, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(shard, "_slice").orderBy(F.col(order).asc_nulls_first(), "text_crc32", "size")
    return df.withColumn("_own", F.row_number().over(own)).join(counts, [shard, "_slice"]).withColumn("slot", (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_slice", "_own", "_before")


def slices(docs: DataFrame, key: str) -> list:
    """Where a column of numbers is cut into slices of about SLICE_ROWS rows, SLICES at most."""
    rows = docs.count()
    n = min(SLICES, rows // SLICE_ROWS + 1)
    if n == 1 or dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        return []
    found = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10000)).first()[0]
    return sorted(set(found or []))


def shard_rows(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the placement on n_shards and on one shard more."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    rows = place(place(rows, key, [1.0] * n_shards, "shard"), key, [1.0] * (n_shards + 1), "grown_shard")
    return with_slots(rows, "shard", key, slices(docs, key)).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_hash_tree(spark, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 23; law `key`."""
    return shard_rows(table(spark, sf_dir, "documents"))


#: Two regions of three racks of four shards; the 25th shard is a region of its own.
OP6_SQL = """
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS tab
), d AS (
  SELECT doc_id, coalesce(text, '') AS body, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents
), root AS (
  SELECT doc_id, body, k, list_transform([12.0, 12.0, 1.0], lambda w, i: -ln((CAST(CAST('0x' || substr(md5(k || ':region:' || CAST(i - 1 AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 1) / CAST(4503599627370497 AS DOUBLE)) / CAST(w AS DOUBLE)) AS draws FROM d
), region AS (
  SELECT *, list_position(draws[1:2], list_min(draws[1:2])) - 1 AS r, list_position(draws, list_min(draws)) - 1 AS grown_r FROM root
), racks AS (
  SELECT *, list_transform(range(3), lambda j: -ln((CAST(CAST('0x' || substr(md5(k || ':rack:' || CAST(r * 3 + j AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 1) / CAST(4503599627370497 AS DOUBLE)) / CAST(4 AS DOUBLE)) AS rack_draws FROM region
), rack AS (
  SELECT *, r * 3 + list_position(rack_draws, list_min(rack_draws)) - 1 AS rack FROM racks
), shards AS (
  SELECT *, list_transform(range(4), lambda j: -ln((CAST(CAST('0x' || substr(md5(k || ':shard:' || CAST(rack * 4 + j AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 1) / CAST(4503599627370497 AS DOUBLE))) AS shard_draws FROM rack
), placed AS (
  SELECT doc_id, CAST(strlen(body) + 8 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) AS text_crc32,
    'key' AS law, CAST(rack * 4 + list_position(shard_draws, list_min(shard_draws)) - 1 AS INTEGER) AS shard, grown_r
  FROM shards, steps
)
SELECT doc_id, size, text_crc32, law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot,
  CASE WHEN grown_r = 2 THEN 24 ELSE shard END AS grown_shard FROM placed
"""
