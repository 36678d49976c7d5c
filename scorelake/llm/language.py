"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Learned from labelled rows outside the held-out fold: for each language the frequencies of hashed character n-grams of its
words, over SAMPLE distinct texts a language at most (a share of each language's rows by a hash of doc_id and text, then the
least hashes), and the scripts its words use, over the same rows. A word's score in a language is its n-grams' mean log probability times the square root of their number. Only
languages that use the script of a word's first letter compete for it; where no language does, all do and the word scores
the same in each. Viterbi then finds the labelling of a text's words that maximises the sum of scores less SWITCH for each
change of language: runs of one label are the spans. The prediction is the language of most letters; its score is the share
of letters in its spans, times the posterior of its words' summed scores against the other languages'.

Defined cases: null texts and texts without a letter (number forms such as one half or a Roman eight are none) are `und` with
score 0; null lang or doc_id is never learned from; rows repeated with equal doc_id and text are learned from once and
predicted each; without labelled rows every text is `und`; ties go to the language that sorts first; very long texts are
labelled whole; an empty table gives an empty table; extra columns are ignored. The model has BUCKETS numbers a language.
"""

from __future__ import annotations

import pickle
import re

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .words import grams, numbered

#: Documented bound of the training sample, in rows a language.
SAMPLE = 600
#: By how much more than SAMPLE rows a language the hash lets through, so that the least of them make it up.
MARGIN = 1.25
SIZES, BUCKETS, SWITCH, SMOOTH = (1, 2, 3, 4), 1 << 16, 8.0, 0.5
WORD = re.compile(r"[^\W\d_]+")
#: Numbers beyond ASCII that Python counts among the characters of words: they are no letters, and give way to spaces.
NUMBERS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha())
BLANKS = str.maketrans(dict.fromkeys(NUMBERS, " "))
#: Script ranges: first code point of each range and its script, in ascending order.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Latin"), (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "other"), (0xA640, "Cyrillic"), (0xA6A0, "other"),
    (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "other"), (0x20000, "Han"),
)


def letters_of(text: str | None) -> str:
    """The text with spaces for the numbers that WORD would take."""
    if not text or text.isascii() or NUMBERS.isdisjoint(text):
        return text or ""
    return text.translate(BLANKS)


def script_numbers(words: list[str]):
    import numpy as np

    names = sorted({s for _, s in SCRIPTS})
    starts = np.array([c for c, _ in SCRIPTS])
    of = np.array([names.index(s) for _, s in SCRIPTS])
    return of[np.searchsorted(starts, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), side="right") - 1]


class Model:
    """langs; logp: bucket x language; uses: script x language."""

    def __init__(self, langs, logp, uses):
        self.langs, self.logp, self.uses = langs, logp, uses

    def word_scores(self, words: list[str]):
        import numpy as np

        at, to = grams(words, SIZES, BUCKETS)
        n = np.maximum(np.bincount(at, minlength=len(words)), 1)
        score = np.stack([np.bincount(at, self.logp[to, k], minlength=len(words)) for k in range(len(self.langs))], 1) / np.sqrt(n)[:, None]
        may = self.uses[script_numbers(words)]
        score = np.where(may, score - score.max(1, keepdims=True), -60.0)
        return np.where(may.any(1)[:, None], score, 0.0)

    def label(self, texts: list[list[str]]):
        """Per text: the word labels of the best path, and the sums of the word scores by language."""
        import numpy as np

        ids, ends, words = numbered(texts)
        k = len(self.langs)
        scores = self.word_scores(words)[ids] if len(ids) else np.zeros((0, k))
        n = np.diff(ends, prepend=0)
        order = np.argsort(-n, kind="stable")  # longest first: the texts still running are a prefix
        start = (ends - n)[order]
        alive = np.searchsorted(-n[order], -np.arange(n.max(initial=0)), side="left") if len(n) else []
        best = np.zeros((len(n), k))
        came = np.zeros((len(ids), k), np.int8 if k < 128 else np.int32)
        cells = np.arange(k)
        for t, m in enumerate(alive):
            top = best[:m].argmax(1)
            switch = best[np.arange(m), top] - SWITCH
            stay = best[:m] >= switch[:, None]
            rows = start[:m] + t
            came[rows] = np.where(stay, cells, top[:, None])
            best[:m] = np.where(stay, best[:m], switch[:, None]) + scores[rows]
        labels = np.zeros(len(ids), np.int32)
        now = best.argmax(1)
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            rows = start[:m] + t
            labels[rows] = now[:m]
            now[:m] = came[rows, now[:m]]
        sums = np.zeros((len(n), k))
        full = np.nonzero(n)[0]
        if len(full):
            sums[full] = np.add.reduceat(scores, (ends - n)[full], axis=0)
        return labels, ends, sums


def held_out() -> F.Column:
    """The rows never learned from: crc32 of doc_id, as text, is 0 modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model, from n-gram counts made on the executors: a row for each language and bucket reaches the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # the count of a language's rows sets its share, so that few rows of a common language meet in the window's task
    share = known.groupBy("lang").agg((MARGIN * sample / F.count("*")).alias("share"))
    drawn = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) * 2.0**-53
    some = known.join(F.broadcast(share), "lang").where(drawn < F.col("share")).dropDuplicates(["lang", "h"])  # a row a language
    rows = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample).select("lang", "text")

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lang, text = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in sorted(set(lang)):
                ids, _, words = numbered([WORD.findall(letters_of(t).lower()) for t, x in zip(text, lang) if x == name])
                if not words:
                    continue
                times = np.bincount(ids, minlength=len(words))
                at, to = grams(words, SIZES, BUCKETS)
                n = np.concatenate([np.bincount(to, times[at], minlength=BUCKETS), np.bincount(script_numbers(words), times, minlength=len(SCRIPTS))]).astype(np.int64)
                keys = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(n[keys])], ["lang", "key", "n"])

    counts = rows.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    import numpy as np

    langs = sorted(counts["lang"].unique())
    n = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    n[counts["key"].to_numpy(), np.searchsorted(langs, counts["lang"].to_numpy(str))] = counts["n"].to_numpy()
    p = (n[:BUCKETS] + SMOOTH) / (n[:BUCKETS].sum(0) + SMOOTH * BUCKETS)
    scripts = n[BUCKETS:]
    return Model(langs, np.log(p), scripts >= 0.01 * np.maximum(scripts.sum(0), 1))


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, spans: arrays of (start, end, lang) in code points, from the first letter of a run to its last."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    out = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = pickle.loads(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                found = [list(WORD.finditer(letters_of(t))) for t in b.column(1).to_pylist()]
                if m is None:
                    preds, score, spans = ["und"] * len(found), [0.0] * len(found), [[] for _ in found]
                else:
                    labels, ends, sums = m.label([[x.group().lower() for x in f] for f in found])
                    preds, score, spans, at = [], [], [], 0
                    for f, end, total in zip(found, ends, sums):
                        own, at = labels[at:end], end
                        if not f:
                            preds.append("und"), score.append(0.0), spans.append([])
                            continue
                        edges = np.array([x.span() for x in f])
                        letters = np.bincount(own, edges[:, 1] - edges[:, 0], minlength=len(m.langs))
                        k = int(letters.argmax())
                        cuts = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1, [len(own)]])
                        preds.append(m.langs[k])
                        score.append(float(letters[k] / letters.sum() / np.exp(np.clip(total - total[k], -700, 50)).sum()))
                        spans.append([{"start": int(edges[a, 0]), "end": int(edges[z - 1, 1]), "lang": m.langs[int(own[a])]} for a, z in zip(cuts[:-1], cuts[1:])])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)


def op4_script_viterbi(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = table(spark, sf_dir, "documents")
    return identified(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
