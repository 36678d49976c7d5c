"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy (as in fastText).

A word is the mean of the vectors of its hashed character n-grams and its own; a text is the mean of its words and of PRIOR
words of a zero vector, which keep few words from deciding a short text. A linear softmax of two classes depends on the
difference of its two inputs only, so the model holds that one difference: one output vector and a sigmoid, the same function.
Unseen misspellings share n-gram vectors with the words they stem from. Since the means are linear, a trained model gives each
word one logit, a text the mean of its words' logits.

Training is on labelled rows outside the held-out fold, SAMPLE documents at most, taken in the order of a hash of doc_id.
Executors make their bags; the driver gets sparse rows, of BUCKETS cells at most whatever a text's length, and no text. All
rows are scored. Words are lower-cased runs of letters, marks, digits and apostrophes.

Defined cases: a null, empty or word-free text scores the model's bias; rows with null labels or ids are not learned from;
a doc_id with several labels is toxic if any says so, one with several texts is learned from by the least of them; without
labels of both classes every score is 0; very long texts are scored whole; an empty table gives an empty table; extra columns
are ignored by scored() and kept by keep_clean().
"""

from __future__ import annotations

import pickle
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import grams, numbered

#: Documented bound of the training sample, in rows.
SAMPLE = 3000
SIZES, BUCKETS, DIM = (3, 4, 5), 1 << 17, 8
EPOCHS, BATCH, RATE, FLOOR, DECAY = 20, 256, 4.0, 0.1, 0.03
#: Vectors shrink by DECAY an epoch, lest rows with a wrong label are learned by heart. Every mean counts so many words of a
#: zero vector, lest a few words decide a short text.
PRIOR = 30
THRESHOLD = 0.7
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Model:
    """vectors: bucket x DIM; out: DIM; bias. Their product is the difference of the softmax's two inputs."""

    def __init__(self, vectors=None, out=None, bias=0.0):
        self.table, self.bias = (None if vectors is None else vectors @ out), bias

    def word_logits(self, words: list[str]):
        import numpy as np

        if self.table is None:
            return np.zeros(len(words))
        at, to = grams(words, SIZES, BUCKETS, whole=True)
        n = np.bincount(at, minlength=len(words))
        return np.bincount(at, self.table[to], minlength=len(words)) / np.maximum(n, 1)

    def score(self, texts: list[str | None]):
        import numpy as np

        if self.table is None:
            return np.zeros(len(texts))
        ids, ends, words = numbered([words_of(t) for t in texts])
        n = np.diff(ends, prepend=0)
        sums = np.concatenate([[0.0], np.cumsum(self.word_logits(words)[ids])])
        mean = (sums[ends] - sums[ends - n]) / (n + PRIOR)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30)))


def bags(texts: list[str]):
    """The texts as sparse rows over the buckets: row ends, buckets, weights. Weights are those of a mean of word means."""
    import numpy as np

    ends, buckets, weights = [0], [], []
    for i in range(0, len(texts), 500):
        ids, stops, words = numbered([words_of(t) for t in texts[i : i + 500]])
        at, to = grams(words, SIZES, BUCKETS, whole=True)
        order = np.argsort(at, kind="stable")
        to, n = to[order].astype(np.int32), np.bincount(at, minlength=len(words))
        first = np.concatenate([[0], np.cumsum(n)])
        start = 0
        for stop in stops:
            w, c = np.unique(ids[start:stop], return_counts=True)
            size = n[w]
            where = np.repeat(first[w] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(w) else np.zeros(0, int)
            b, back = np.unique(to[where], return_inverse=True)
            buckets.append(b)
            weights.append(np.bincount(back, np.repeat(c / (stop - start + PRIOR) / size, size), minlength=len(b)).astype(np.float32) if len(w) else np.zeros(0, np.float32))
            ends.append(ends[-1] + len(b))
            start = stop
    return np.array(ends), np.concatenate(buckets) if buckets else np.zeros(0, np.int32), np.concatenate(weights) if weights else np.zeros(0, np.float32)


def train(ends, bucket, weight, labels: list[int], seed: int = 7) -> Model:
    """The model from bags() and the labels. Joint gradient descent on the n-gram vectors and the output layer, in shuffled batches. Step sizes follow Adagrad with
    a floor: a bucket that few rows touch takes small steps, so that rows are not learned by heart."""
    import numpy as np

    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model()
    r = np.random.default_rng(seed)
    vectors = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = r.choice([-1.0, 1.0], DIM).astype(np.float32)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    seen = np.zeros(BUCKETS, np.float32)
    floor = 0.0
    for epoch in range(EPOCHS):
        rate, mixed = RATE * (1 - epoch / EPOCHS), r.permutation(len(y))
        for s in range(0, len(mixed), BATCH):
            batch = mixed[s : s + BATCH]
            size = ends[batch + 1] - ends[batch]
            cells = np.repeat(ends[batch] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            d, b, w = np.repeat(np.arange(len(batch)), size), bucket[cells], weight[cells]
            z = np.bincount(d, (vectors @ out)[b] * w, minlength=len(batch)) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            g_bucket = np.bincount(b, (g[d] * w), minlength=BUCKETS).astype(np.float32)
            seen += g_bucket**2
            floor = floor or FLOOR * float(np.sqrt(seen.max()))
            step = rate * g_bucket / (np.sqrt(seen) + floor)
            g_out = g_bucket @ vectors
            vectors -= step[:, None] * out[None, :]
            out -= (0.1 * rate * g_out / (np.abs(g_out).max() + 1e-12)).astype(np.float32)
            bias -= rate * float(g.sum())
        vectors *= 1 - DECAY
    return Model(vectors, out, bias)


def held_out() -> F.Column:
    """The rows never learned from: crc32 of doc_id, as text, is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marks.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # SAMPLE rows at most

    def bagged(batches):
        import pyarrow as pa

        for b in (whole.slice(s, 200) for whole in batches for s in range(0, whole.num_rows, 200)):
            ends, bucket, weight = bags(b.column(2).to_pylist())
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(x)) for x in (bucket.astype("int32"), weight.astype("float32"))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["doc_id", "toxic", "bucket", "weight"])

    import numpy as np
    import pyarrow as pa

    t = rows.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(bagged, "doc_id long, toxic int, bucket array<int>, weight array<float>").toArrow()
    if not t.num_rows:
        return Model()
    order = np.argsort(t.column("doc_id").to_numpy())
    toxic = [t.column("toxic")[int(i)].as_py() for i in order]
    size = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in t.column("bucket").chunks])
    at, ends = np.cumsum(size) - size, np.concatenate([[0], np.cumsum(size[order])])
    cells = np.repeat(at[order] - ends[:-1], size[order]) + np.arange(ends[-1])
    cells = [np.concatenate([c.flatten().to_numpy() for c in t.column(name).chunks])[cells] for name in ("bucket", "weight")]
    del t
    pa.default_memory_pool().release_unused()
    return train(ends, *cells, toxic)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = pickle.loads(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(part.column(1).to_pylist()).astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, all columns kept; the text is scored where it stands, without a join."""
    model = fit(docs, labels)
    shared, schema, at = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model)), docs.schema, docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        m = pickle.loads(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                yield part.filter(pa.array(m.score(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, schema)


def op10_subword_bags(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
