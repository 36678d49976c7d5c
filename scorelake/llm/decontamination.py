"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity; DataFrame
functions only.

Texts become lower-cased words and shingles of SHINGLE words. A window is a run of as many shingles as an item has (a shorter
document is one window). It is similar to the item if the weighted Jaccard similarity of their shingles, repeats counted,
reaches THRESHOLD; a shingle weighs ln(1 + items / items with it), one in no item as if it were in one.

1. A window similar to an item of m shingles holds shingles of items of m shingles that weigh THRESHOLD times the least of
   these items at least. Windows below that are not laid; at every other start, in every document, one is.
2. Every window laid gets a SimHash of 64 bits, in 8 blocks. Fingerprints within RADIUS bits agree in one block up to 2
   bits, so items are indexed by length under all values within 2 bits of each block, and a window, which knows of no item
   yet, finds all items of its length within the radius. A pair is kept at the first block in which it agrees.
3. Candidates are verified: the exact similarity, every shingle with its own weight.

At the threshold fingerprints differ in about 10 of 64 bits, with a deviation of 3; what RADIUS 23 leaves out is measured in
the README. Windows are laid by stretches of a document, so that neither a long document nor a frequent passage meets in one
task; what is broadcast is measured first and joined by a shuffle beyond BROADCAST_BYTES.

Arrays are exploded with the outer form: from the inner one the optimizer infers a filter on the array and computes the array
again, element by element, to apply it.

Defined cases: items of fewer than SHINGLE words have one short shingle, matched with the documents' runs of as many words;
null, empty and word-free texts match nothing; rows with equal doc_id count as one document, rows with equal item_id as one
item each; of equal windows the first by start is named; either table may be empty; very long texts are taken whole; extra
columns are ignored by contaminated() and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, table

SHINGLE, THRESHOLD = 5, 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
WORD = r"[\p{L}\p{M}\p{N}]+"
#: Sides of up to so many bytes are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20
#: Counters of 16 bits serve windows of up to so many shingles.
PACKED = 60_000
EPS = 1e-9


def small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def grams_of(q: int) -> F.Column:
    """The hashes of the runs of q words in the array _w."""
    parts = ", ".join(f"get(_w, i + {j})" for j in range(q))
    return F.expr(f"CASE WHEN size(_w) >= {q} THEN transform(sequence(0, size(_w) - {q}), i -> xxhash64({parts})) ELSE cast(array() as array<bigint>) END")


def words(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def simhash(grams: str) -> F.Column:
    """64 bits, each set if set in over half of the hashes in a column. Four counters of 16 bits share a long."""
    lanes = "281479271743489L"  # the lowest bit of each lane
    sums = [f"aggregate({grams}, 0L, (s, h) -> s + (shiftrightunsigned(h, {k}) & {lanes}))" for k in range(16)]
    # every sum is computed once, as an element of an array
    packed = "aggregate(zip_with(array(" + ", ".join(sums) + f"), sequence(0, 15), (s, k) -> aggregate(sequence(0, 3), 0L, (fp, j) -> fp | CASE WHEN 2 * (shiftrightunsigned(s, 16 * j) & 65535) > size({grams}) THEN shiftleft(1L, k + 16 * j) ELSE 0L END)), 0L, (a, b) -> a | b)"
    ones = f"aggregate({grams}, 0, (s, h) -> s + cast(shiftrightunsigned(h, b) & 1L as int))"
    plain = f"aggregate(sequence(0, 63), 0L, (fp, b) -> fp | CASE WHEN 2 * {ones} > size({grams}) THEN shiftleft(1L, b) ELSE 0L END)"
    return F.expr(f"CASE WHEN size({grams}) <= {PACKED} THEN {packed} ELSE {plain} END")


def blocks(fp: str) -> F.Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("value")) for i in range(BLOCKS)])


def near_masks() -> list[int]:
    """All masks of up to BLOCK_RADIUS bits in a block."""
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= BLOCK_RADIUS]


def item_table(items: DataFrame) -> DataFrame:
    """One row per item: number (distinct even where item_id repeats), q, m (its shingles), grams."""
    base = items.select("item_id", F.xxhash64("item_id", "text").alias("number"), words(F.col("text")).alias("_w")).where("size(_w) > 0")
    base = base.withColumn("q", F.least(F.size("_w"), F.lit(SHINGLE)))
    grams = F.coalesce(*[F.when(F.col("q") == q, grams_of(q)) for q in range(1, SHINGLE + 1)])
    return base.withColumn("grams", grams).select("item_id", "number", "q", F.size("grams").alias("m"), "grams").dropDuplicates(["number"])


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, word_start, hamming, similarity: for each document and item the best window that reaches the threshold."""
    own = cut(item_table(items))
    n_items, n_grams = own.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    if not n_items:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, word_start int, hamming int, similarity double")
    qs = sorted(r.q for r in own.select("q").distinct().collect())  # at most SHINGLE values
    cells = own.select("number", "q", "m", F.explode_outer("grams").alias("gram"))
    weights = cells.groupBy("q", "gram").agg(F.log(1 + n_items / F.countDistinct("number")).alias("w"))
    weighed = cells.join(weights, ["q", "gram"])
    whole = weighed.groupBy("number").agg(F.sum("w").alias("whole"), F.sort_array(F.collect_list(F.struct("gram", "w"))).alias("own")).join(own, "number")
    whole = cut(whole.select("number", "item_id", "q", "m", "whole", "own", simhash("grams").alias("item_fp")))
    return best(verified(candidates(windows(docs, weighed, whole, qs, n_grams, threshold), whole, n_items), whole, weights, n_items, n_grams, threshold))


def windows(docs: DataFrame, weighed: DataFrame, whole: DataFrame, qs: list[int], n_grams: int, threshold: float) -> DataFrame:
    """doc_id, body, q, m, start, window: those that may be similar to an item of m shingles, of every document."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("body"))
    known = weighed.select("q", "m", "gram", "w").distinct()
    least = whole.groupBy("q", "m").agg((threshold * F.min("whole") - EPS).alias("least"))
    tokens = texts.select("doc_id", "body", words(F.col("text")).alias("_w"))
    cell = lambda q: lambda g, i: F.struct(F.lit(q).alias("q"), i.alias("pos"), g.alias("gram"), (F.size("_w") - q + 1).alias("n"))
    runs = F.concat(*[F.transform(grams_of(q), cell(q)) for q in qs])
    met = tokens.select("doc_id", "body", F.explode_outer(runs).alias("r")).select("doc_id", "body", "r.*").join(small(known, 40 * n_grams), ["q", "gram"])
    # a window that begins in one stretch of m shingles ends in the next at most
    stretch = F.floor(F.col("pos") / F.col("m")).cast("int")
    met = met.withColumn("stretch", F.explode_outer(F.array(stretch, stretch - 1))).where("stretch >= 0")
    sums = met.groupBy("doc_id", "body", "q", "m", "stretch").agg(F.sum("w").alias("w"), F.min("n").alias("n"), F.collect_list(F.struct("pos", "w")).alias("hits"))
    sums = sums.join(F.broadcast(least), ["q", "m"]).where("w >= least")  # a row for each length of an item
    mass = "aggregate(filter(hits, h -> h.pos >= s and h.pos < s + m), cast(0 as double), (a, h) -> a + h.w)"
    starts = F.expr(f"filter(sequence(stretch * m, stretch * m + m - 1), s -> s <= greatest(n - m, 0) and {mass} >= least)")
    laid = cut(sums.select("doc_id", "body", "q", "m", starts.alias("starts")).where("size(starts) > 0"))
    n, n_starts = laid.agg(F.count("*"), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    laid = laid.withColumnsRenamed({"doc_id": "_doc", "body": "_body"})
    hit = texts.join(small(laid, 48 * n + 8 * n_starts), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body")))
    hit = hit.withColumn("_w", words(F.col("text"))).withColumn("grams", F.coalesce(*[F.when(F.col("q") == q, grams_of(q)) for q in qs]))
    hit = hit.select("doc_id", "body", "q", "m", "grams", F.explode_outer("starts").alias("start"))
    return hit.select("doc_id", "body", "q", "m", "start", F.slice("grams", F.col("start") + 1, F.col("m")).alias("window"))


def candidates(laid: DataFrame, whole: DataFrame, n_items: int) -> DataFrame:
    """Windows with number, item_fp and hamming of every item of their length within the radius, found by the blocks."""
    masks = F.array(*[F.lit(m) for m in near_masks()])
    index = whole.select("number", "q", "m", "item_fp", F.explode_outer(blocks("item_fp")).alias("b"))
    index = index.select("number", "q", "m", "item_fp", "b.block", F.explode_outer(F.transform(masks, lambda m: F.col("b.value").bitwiseXOR(m))).alias("value"))
    probes = laid.withColumn("fp", simhash("window")).withColumn("b", F.explode_outer(blocks("fp"))).select(*laid.columns, "fp", "b.block", "b.value")
    met = probes.join(small(index, 48 * n_items * BLOCKS * len(near_masks())), ["q", "m", "block", "value"])
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    met = met.withColumn("hamming", F.bit_count(differ).cast("int")).where(F.col("hamming") <= RADIUS)
    agrees = lambda i: F.bit_count(F.shiftrightunsigned(differ, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))) <= BLOCK_RADIUS
    first = F.coalesce(*[F.when(agrees(i), F.lit(i)) for i in range(BLOCKS)])
    return met.where(F.col("block") == first).select(*laid.columns, "number", "hamming")


def verified(near: DataFrame, whole: DataFrame, weights: DataFrame, n_items: int, n_grams: int, threshold: float) -> DataFrame:
    """doc_id, item_id, start, hamming, similarity of the candidates that reach the threshold, by the exact similarity."""
    near = near.join(small(whole.select("number", "item_id", "whole", "own"), 80 * n_items + 24 * n_grams), "number")
    times = lambda h: F.size(F.filter("window", lambda x: x == h))
    shared = F.aggregate(F.array_distinct("own"), F.lit(0.0), lambda s, o: s + o["w"] * F.least(times(o["gram"]), F.size(F.filter("own", lambda x: x["gram"] == o["gram"]))))
    # no shingle weighs less than one that is in all items, so a window weighs so much at least: others can't pass
    near = near.withColumn("shared", shared).where(F.col("shared") >= threshold * (F.greatest(F.size("window") * F.log(F.lit(2.0)), F.col("shared")) + F.col("whole") - F.col("shared")) - EPS)
    near = near.withColumn("size", F.size("window"))
    grams = near.withColumn("gram", F.explode_outer("window")).drop("window", "own").join(small(weights, 32 * n_grams), ["q", "gram"], "left")
    most = F.log(F.lit(1.0) + n_items)
    sums = grams.groupBy("doc_id", "body", "number", "start").agg(*[F.first(c).alias(c) for c in ("item_id", "hamming", "whole", "shared")], (F.sum(F.coalesce("w", most)) * F.first("size") / F.count("*")).alias("weight"))  # a repeated row counts once
    sums = sums.withColumn("similarity", F.col("shared") / (F.col("weight") + F.col("whole") - F.col("shared")))
    return sums.where(F.col("similarity") >= threshold - 1e-12).select("doc_id", "item_id", "start", "hamming", "similarity")


def best(found: DataFrame) -> DataFrame:
    """The most similar window of each document and item, the first of equal ones."""
    one = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "hamming")).alias("b"))
    return one.select("doc_id", "item_id", (-F.col("b.back")).alias("word_start"), "b.hamming", "b.similarity")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no window reaches the threshold."""
    name = fresh(docs, "bad")
    bad = contaminated(docs, items, threshold).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")


def op9_simhash_windows(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
