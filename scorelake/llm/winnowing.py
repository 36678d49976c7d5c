"""Document fingerprints by winnowing, with DataFrame functions only.

A text becomes tokens: lower-cased runs of letters, marks and digits, single characters in scripts written without spaces.
Every token is hashed once; the rolling hash of K successive tokens is their cyclic polynomial: the hash before, rotated by
one bit, with the token that leaves and the token that enters taken out and in by exclusive or. Token hashes are rotated by
their place beforehand, so a step of the roll is an exclusive or. Of every WINDOW successive hashes the least is chosen, the
rightmost of equal ones, and kept with its token position. Any run of K + WINDOW - 1 tokens that two texts share holds a
chosen hash in both; runs under K tokens are never matched.

Defined cases: fewer than K tokens hash as one short gram, fewer than WINDOW grams are one window; null, empty and
token-free texts have the empty fingerprint. Two empty fingerprints have likeness 1, one empty and one not 0. Rows with
equal doc_id follow each other by text, rows without doc_id come last; very long texts are taken whole; an empty table gives
an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, table

K, WINDOW = 5, 4
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]+|[{UNSPACED}]"
#: A chosen gram is one long: 33 bits of hash over 30 bits that hold the position from the end of their range, so that the
#: least long is the least hash and, of equal ones, the rightmost. No text of 2 GB has more tokens than 30 bits count.
POS_BITS = 30
POS_MASK = (1 << POS_BITS) - 1
#: Rows to a slice of the document order, the most slices, and the quantiles between which slices are cut evenly.
SLICE_ROWS, SLICES, QUANTILES = 200, 1_000_000, 64


def winnow(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds the chosen grams of a text column, in the order of their positions."""
    tok, turned, gram = fresh(df, f"_{out}_t", f"_{out}_r", f"_{out}_g")
    df = df.withColumn(tok, F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0)))
    # rotations count modulo 64 bits: a token's hash goes right by its place, a gram's left again by its last token's place
    df = df.withColumn(turned, F.expr(f"transform(transform({tok}, t -> xxhash64(t)), (h, j) -> shiftrightunsigned(h, j) | shiftleft(h, -j))"))
    rolled = " ^ ".join(f"coalesce(get({turned}, i + {j}), 0L)" for j in range(k))
    left = f"(shiftleft(x, i + {k - 1}) | shiftrightunsigned(x, -i - {k - 1}))"
    grams = f"transform(transform(sequence(0, greatest(size({turned}) - {k}, 0)), i -> {rolled}), (x, i) -> shiftleft(shiftrightunsigned({left}, {POS_BITS + 1}), {POS_BITS}) | ({POS_MASK}L - i))"
    df = df.withColumn(gram, F.expr(f"CASE WHEN size({turned}) > 0 THEN {grams} ELSE cast(array() as array<bigint>) END"))
    least = ", ".join(f"get({gram}, i + {j})" for j in range(window))
    df = df.withColumn(out, F.expr(f"CASE WHEN size({gram}) > 0 THEN array_distinct(transform(sequence(0, greatest(size({gram}) - {window}, 0)), i -> least({least}))) ELSE cast(array() as array<bigint>) END"))
    return df.drop(tok, turned, gram)


def written(chosen: str) -> F.Column:
    """hash:position pairs, as text."""
    return F.expr(f"array_join(transform({chosen}, v -> concat(lower(hex(shiftright(v, {POS_BITS}))), ':', {POS_MASK} - (v & {POS_MASK}))), ' ')")


def hashes(chosen: str) -> F.Column:
    return F.expr(f"array_distinct(transform({chosen}, v -> shiftright(v, {POS_BITS})))")


def likeness(a: str, b: str) -> F.Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.greatest(union, F.lit(1)))


def with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, text, own (its chosen grams), next_text and next_own: those of the next document in descending doc_id; after
    the last comes the first.

    The order is cut into slices of about SLICE_ROWS rows (SLICES at most): quantiles of doc_id first, even cuts between
    them. One shuffle deals the texts to their slices, a window in each finds the next row, and the last row of a slice takes
    the first of the next slice: that join has a row per slice, and is made in two levels too, slices between two quantiles
    and then the quantiles, of which there are QUANTILES + 1.
    """
    rows, cuts = docs.agg(F.count("*"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10000)).first()
    cuts = sorted(set(cuts or [0]))
    per = max(1, min(rows // SLICE_ROWS, SLICES) // len(cuts))
    low = F.array(*[F.lit(c) for c in cuts])
    width = F.array(*[F.lit(max(1.0, (b - a) / per)) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1])])
    inside = F.floor((F.col("doc_id").cast("double") - F.get(low, F.col("_at")).cast("double")) / F.get(width, F.col("_at")))
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("_at", F.greatest(F.size(F.filter(low, lambda c: c <= F.col("doc_id"))) - 1, F.lit(0)))
    df = df.withColumn("_slice", F.col("_at") * per + F.coalesce(F.least(F.lit(per - 1), inside).cast("int"), F.lit(0)))

    mine = Window.partitionBy("_slice").orderBy(F.col("doc_id").desc(), "text")
    dealt = df.withColumn("_row", F.row_number().over(mine)).withColumn("next_text", F.lead("text").over(mine))
    inner = winnow(dealt, "text", "own", k, window).withColumn("next_own", F.lead("own").over(mine)).where("next_text is not null")
    # the first row of each slice, as what follows the slice above it
    heads = winnow(dealt.where("_row = 1"), "text", "own", k, window).select("_at", "_slice", F.struct("text", "own").alias("head"))
    within = heads.withColumn("_next", F.lead("head").over(Window.partitionBy("_at").orderBy(F.col("_slice").desc())))
    tops = heads.groupBy("_at").agg(F.max_by("head", "_slice").alias("head"))
    round_ = Window.partitionBy(F.lit(0)).orderBy(F.col("_at").desc())  # a row per quantile
    tops = tops.withColumn("_top", F.coalesce(F.lead("head").over(round_), F.first("head").over(round_))).select("_at", "_top")
    follow = within.join(tops, "_at").select("_slice", F.coalesce("_next", "_top").alias("_next"))
    ends = winnow(dealt.where("next_text is null"), "text", "own", k, window).join(follow, "_slice")
    cols = ("doc_id", "text", "own")
    return inner.select(*cols, "next_text", "next_own").unionByName(ends.select(*cols, F.col("_next.text").alias("next_text"), F.col("_next.own").alias("next_own")))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_chosen."""
    df = with_next(docs, k, window).withColumn("n_chars", F.char_length("text").cast("long"))
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    df = winnow(df, "edited", "cut", k, window)
    df = df.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "own", "cut", hashes("own").alias("own_h"), hashes("cut").alias("cut_h"), hashes("next_own").alias("next_h"))
    return df.select(
        "doc_id", "n_chars", "edited_sha256", written("own").alias("fingerprint"), written("cut").alias("edited_fingerprint"),
        likeness("own_h", "cut_h").alias("near_edited"), likeness("own_h", "next_h").alias("near_next"), F.size("own").alias("n_chosen"),
    )


def op1_winnowing(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
