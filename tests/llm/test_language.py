import itertools
import random
import zlib

import numpy as np
from scorelake.llm import language as g
from pyspark.sql import functions as F


def corpus(n=160):
    r = random.Random(6)
    kinds = {"en": "the of and ing tion er that with", "de": "der die und keit lich schen ung", "ru": "что это как она они был", "el": "και του την από είναι"}
    rows = []
    for i in range(n):
        lang = list(kinds)[i % 4]
        rows.append((i, " ".join(r.choice(kinds[lang].split()) + r.choice(["", r.choice(kinds[lang].split())]) for _ in range(r.randrange(3, 40))), lang))
    return rows


def test_held_out_accuracy_and_edge_cases(spark, make_docs):
    rows = corpus()
    docs = make_docs([(i, t) for i, t, _ in rows])
    lang = F.create_map(*itertools.chain.from_iterable((F.lit(i), F.lit(x)) for i, _, x in rows))[F.col("doc_id").cast("int")]
    docs = docs.withColumn("lang", lang).unionByName(make_docs([(900, None), (901, ""), (902, "12 ++ 34"), (None, "the of and with that"), (903, "漢字漢字")]).withColumn("lang", F.lit(None).cast("string")))
    model = g.fit(docs)
    got = {r.doc_id: r for r in g.identified(docs.withColumn("score", F.lit("clash")), model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 15 and all(got[i].lang_pred == rows[i][2] for i in held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[None].lang_pred == "en" and got[903].lang_pred in model.langs
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = make_docs([(1, "the of and with that the of and ing " * 3 + "что это как она они был " * 4)])
    (row,) = g.identified(mixed, model).collect()
    assert [s.lang for s in row.spans] == ["en", "ru"] and row.spans[0].start == 0


def test_viterbi_matches_brute_force():
    r = np.random.default_rng(1)
    m = g.Model(["a", "b"], np.zeros((g.BUCKETS, 2)), np.ones((len(g.SCRIPTS), 2), bool))
    words = [f"w{i}" for i in range(20)]
    table = dict(zip(words, r.normal(0, 6, (20, 2))))
    m.word_scores = lambda ws: np.array([table[w] for w in ws])
    texts = [[words[r.integers(20)] for _ in range(n)] for n in (0, 1, 5, 9, 3)]
    labels, ends, _ = m.label(texts)
    start = 0
    for t, end in zip(texts, ends):
        own, start = labels[start:end].tolist(), end
        value = lambda path: sum(table[w][x] for w, x in zip(t, path)) - g.SWITCH * sum(x != y for x, y in zip(path, path[1:]))
        if t:
            assert abs(value(own) - max(map(value, itertools.product((0, 1), repeat=len(t))))) < 1e-9


def test_no_labels_and_empty(make_docs):
    docs = make_docs([(1, "some words")]).withColumn("lang", F.lit(None).cast("string"))
    assert g.fit(docs) is None
    assert [(r.lang_pred, r.score) for r in g.identified(docs, None).collect()] == [("und", 0.0)]
    assert g.identified(docs.where(F.lit(False)), None).count() == 0


def test_numbers_are_no_letters(make_docs):
    rows = corpus()
    docs = make_docs([(i, x) for i, x, _ in rows])
    docs = docs.join(docs.sparkSession.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, l string"), "doc_id").drop("lang").withColumnRenamed("l", "lang")
    model = g.fit(docs)
    odd = make_docs([(1, "½ ² Ⅷ ①"), (2, "①the½of"), (3, "_ 12 ٣")])
    got = {r.doc_id: r for r in g.identified(odd, model).collect()}
    assert (got[1].lang_pred, got[1].score, got[3].lang_pred) == ("und", 0.0, "und") and got[2].lang_pred == "en"
    assert [(s.start, s.end) for s in got[2].spans] == [(1, 7)]


def test_many_languages_long_texts_and_repeated_rows(spark, make_docs):
    alphabet = "bcdfghjklmnpqrstvwxz"
    word = lambda k: f"{alphabet[k % 20]}{alphabet[k // 20]}a{alphabet[(k * 7) % 20]}"
    rows = [(i, " ".join([word(i % 300)] * 6), f"l{i % 300:03d}") for i in range(1500)]
    docs = spark.createDataFrame([(i, x, y, "s", 1) for i, x, y in [*rows, *rows[:40], *rows[:40]]], "doc_id long, text string, lang string, source string, n_chars long")
    model = g.fit(docs)
    assert len(model.langs) == 300
    got = {r.doc_id: r.lang_pred for r in g.identified(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == y for i, y in held) > 0.95 * len(held)
    long = (word(5) + " ") * 60_000 + "q" * 5000
    (row,) = g.identified(make_docs([(1, long)]), model).collect()
    assert row.lang_pred == "l005" and row.spans[-1].end == len(long)


def test_word_scores_match_plain_sums():
    r = np.random.default_rng(2)
    m = g.Model(["a", "b", "c"], r.normal(-9, 2, (g.BUCKETS, 3)), r.random((len(g.SCRIPTS), 3)) < 0.7)
    words = ["the", "что", "x" * 90, "漢", "Ω"]
    names = sorted({s for _, s in g.SCRIPTS})
    for w, got in zip(words, m.word_scores(words)):
        cells = []
        for n in g.SIZES:
            for i in range(len(w) + 2 - n + 1):
                cells.append(n)
        _, to = g.grams([w], g.SIZES, g.BUCKETS)
        assert len(to) == len(cells)
        raw = m.logp[to].sum(0) / np.sqrt(len(to))
        script = [s for c, s in g.SCRIPTS if c <= ord(w[0])][-1]
        may = m.uses[names.index(script)]
        want = np.where(may, raw - raw.max(), -60.0) if may.any() else np.zeros(3)
        assert np.allclose(got, want)
