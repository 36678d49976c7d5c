"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

Fingerprints of 64 bits that differ in at most RADIUS = 2 bits share at least SHARED = 6 of their 8 bytes, each at its
position. A posting list per single byte would hold 1/256 of all fingerprints, so the index is kept by prefix filtering: of
the four pairs of positions (0 1) (2 3) (4 5) (6 7), two bytes that differ touch two at most, so a pair that shares 6 bytes
shares both others, and meets in one of the 6 lists of a fingerprint, each under the bytes of two pairs of positions. In a list, the shared
positional bytes of each pair are tallied; pairs that reach the minimum are retained and their Hamming distance verified.
Long lists are joined through the masks of up to two of the 32 bits in which their members may differ, instead of by all
pairs, and then tallied and verified alike. Equal fingerprints are one entry. Each list yields a star per group, and groups
grow together by alternating large and small stars, checkpointed each round.

Defined cases: a null text is empty; texts without words have fingerprint zero, linked like any other; very long texts are
read whole; a null doc_id takes its fingerprint's component but is never a component's id and carries no link of its own;
rows with equal doc_id are one node; an empty table gives an empty table; extra columns are ignored by components() and kept
by keep_one(), which keeps every row without doc_id.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table

RADIUS, SHINGLE = 2, 3
#: Positional bytes that fingerprints within the radius share at least.
SHARED = 8 - RADIUS
#: The free byte positions of each kind of posting list: those of two of the four pairs.
FREE = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(4), 2)]
#: Lists of up to so many members are compared by pairs.
PAIRWISE = 128
#: Edges that a task reads in a round of stars, and tasks at least.
TASK_EDGES, LEAST_TASKS = 50_000, 8


def majority(h):
    """64 bits, signed, each set if set in over half of some hashes."""
    import numpy as np

    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        total += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(h), bitorder="little").view(np.int64)[0]


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 hashes (seed 42) of a text's 3-word shingles."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    return int(majority(np.fromiter((digest(join(s), 42) for s in zip(words, words[1:], words[2:])), np.uint64, len(words) - 2)).view(np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: signed 64-bit fingerprints."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def tally(differ):
    """How many positional bytes two fingerprints share, from the bits in which they differ; on arrays of any shape."""
    import numpy as np

    return (np.ascontiguousarray(differ)[..., None].view(np.uint8) == 0).sum(-1)


def masks(free: tuple[int, ...]) -> list[int]:
    """All masks of one or two of the bits in some bytes."""
    bits = [1 << (8 * byte + b) for byte in free for b in range(8)]
    return bits + [x | y for x, y in combinations(bits, 2)]


def stars(fps: list[int], reps: list[int], free: tuple[int, ...]) -> list[tuple[int, int]]:
    """(member, least member) of each group within a posting list; fps are distinct."""
    import numpy as np

    if len(fps) == 2:
        differ = (fps[0] ^ fps[1]) & (2**64 - 1)
        retained = sum(differ >> 8 * b & 255 == 0 for b in range(8)) >= SHARED
        return [(max(reps), min(reps))] if retained and differ.bit_count() <= RADIUS else []
    v, rep = np.array(fps, np.int64).view(np.uint64), np.array(reps, np.int64)
    if len(v) <= PAIRWISE:
        i, j = np.triu_indices(len(v), 1)
    else:
        order = np.argsort(v)
        v, rep = v[order], rep[order]
        ends = []
        for m in masks(free):
            at = np.minimum(np.searchsorted(v, v ^ np.uint64(m)), len(v) - 1)
            ends.append(np.nonzero(v[at] == v ^ np.uint64(m))[0])
            ends.append(at[ends[-1]])
        i, j = np.concatenate(ends[::2]), np.concatenate(ends[1::2])
    differ = v[i] ^ v[j]
    some = np.nonzero(tally(differ) >= SHARED)[0]
    some = some[np.bitwise_count(differ[some]) <= RADIUS]
    i, j = i[some], j[some]
    label = rep.copy()
    while True:
        old = label.copy()
        np.minimum.at(label, i, old[j])
        np.minimum.at(label, j, old[i])
        if (label == old).all():
            return [(int(r), int(x)) for r, x in zip(rep, label) if r != x]


def links(nodes: DataFrame) -> DataFrame:
    """a, b with b < a: stars of the fingerprints (fp, rep) that each posting list links."""
    whole = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keep = [signed(whole & ~sum(255 << 8 * i for i in free)) for free in FREE]
    postings = F.array(*[F.struct(F.lit(k).cast("byte").alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(keep)])
    rows = nodes.select("fp", "rep", F.explode(postings).alias("p")).select("p.kind", "p.key", "fp", "rep")
    rows = rows.repartition("kind", "key").sortWithinPartitions("kind", "key")

    def run(batches):
        import pyarrow as pa

        def found(kind, fps, reps):
            return stars(fps, reps, FREE[kind]) if len(fps) > 1 else ()

        last, fps, reps = None, [], []
        for b in batches:
            out = []
            kinds, keys, f, r = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            # runs of equal (kind, key) within the batch; the last one may go on in the next
            import numpy as np

            cuts = np.concatenate([[0], np.nonzero((kinds[1:] != kinds[:-1]) | (keys[1:] != keys[:-1]))[0] + 1, [len(keys)]]) if len(keys) else [0]
            for n, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                this = (int(kinds[s]), int(keys[s]))
                if this == last:
                    fps += f[s:e].tolist()
                    reps += r[s:e].tolist()
                    continue
                if last is not None:
                    out += found(last[0], fps, reps)
                if e - s == 1 and n < len(cuts) - 2:
                    last, fps, reps = None, [], []
                    continue
                last, fps, reps = this, f[s:e].tolist(), r[s:e].tolist()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
        out = found(last[0], fps, reps) if last is not None else ()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def components_of(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each node of the edges (a, b) reaches; large and small stars in turn
    (Kiveris and others, 2014). Its rounds grow as the logarithm of the longest path. The edges are read twice, in as many tasks
    as the round before has counted rows for."""
    edges, seen = edges.select("a", "b"), None
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    while True:
        both = edges.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(pair("v", "m"), pair("u", "m")))).where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
        seal = Observation()  # taken as the round is written, without a pass of its own
        edges = cut(small.observe(seal, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
        now = tuple(seal.get.values())
        edges = edges.coalesce(max(LEAST_TASKS, now[0] // TASK_EDGES + 1))
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    fps = cut(fingerprints(docs))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    groups = components_of(cut(links(nodes.where("rep is not null"))))
    # one doc_id may stand on several fingerprints (repeated rows with different texts): it is one node and links them
    named = nodes.join(groups, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, grouped=components) -> DataFrame:
    """One row of each component: that of its least doc_id, of repeated ones the first by text. Rows without doc_id stay.
    grouped(docs) gives the components: doc_id, component_id."""
    found = cut(grouped(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")))
    kept = docs.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if found.where("n > 1").limit(1).count():  # without repeated ids there is nothing to choose, and no need to sort texts
        row = fresh(kept, "_row")
        kept = kept.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(row) == 1).drop(row)
    return kept.unionByName(docs.where("doc_id is null"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
