import math
import random
import re
from collections import Counter

from scorelake.llm import decontamination as d
from pyspark.sql import functions as F


def shingles(text, q):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + q]) for i in range(len(w) - q + 1)]


def brute(docs, items, threshold=0.8):
    """Every window of every item's length in every document, by the definition alone: (similarity, start) of the best."""
    toks = {i: len(re.findall(r"[^\W_]+", t.lower())) for i, t in items}
    sh = {i: (min(5, toks[i]), shingles(t, min(5, toks[i]))) for i, t in items if toks[i]}
    n = len(sh)
    df = Counter((q, g) for q, s in sh.values() for g in set(s))
    out = {}
    for doc, text in docs:
        for i, (q, s) in sh.items():
            own, t = Counter(s), shingles(text, q)
            w = lambda g: math.log(1 + n / max(df[(q, g)], 1))
            for a in range(max(len(t) - len(s), 0) + 1):
                win = Counter(t[a : a + len(s)])
                if win & own:
                    sim = sum(w(g) * c for g, c in (win & own).items()) / sum(w(g) * c for g, c in (win | own).items())
                    if sim >= threshold and sim > out.get((doc, i), (0, 0))[0] + 1e-9:
                        out[doc, i] = (sim, a)
    return out


def test_finds_what_brute_force_finds(spark, make_docs):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.randrange(20, 45))) for i in range(12)] + [(50, "only three words"), (51, "..."), (52, "")]
    docs = []
    for i in range(60):
        t = items[i % 12][1].split()
        if i % 4 == 1:
            t[len(t) // 2] = "CHANGED"
        if i % 4 == 2:
            t = t[: len(t) // 2]
        if i % 4 == 3:
            t = [*t[:2], "put", *t[2:]]
        docs.append((i, f"{say(i % 30)} {' '.join(t).upper()}, {say(i % 17)}"))
    docs += [(100, None), (101, ""), (102, "x only three words y"), (103, say(6000)), (104, items[0][1] + " and " + items[0][1])]
    got = {(x.doc_id, x.item_id): x for x in d.contaminated(make_docs(docs, start=1, number=2), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and len(want) > 25
    for k, (sim, _) in want.items():
        assert abs(got[k].similarity - sim) < 1e-9 and got[k].hamming <= d.RADIUS


def test_clean_keeps_the_rest_and_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = make_docs([(1, "so one two three four five six seven eight nine ten."), (2, "clean text"), (None, None), (3, "one two three four five")])
    assert sorted(str(r.doc_id) for r in d.clean(docs, items).collect()) == ["2", "3", "None"]
    assert d.clean(docs, items.where(F.lit(False))).count() == 4
    assert d.contaminated(docs.where(F.lit(False)), items).count() == 0


def test_shingles_of_other_items_have_their_own_weight(spark, make_docs):
    n = 400
    template = ["r34", "r35", "r36", "r37", "t0", "t1", "t2", "t3", "t4", "t5"]  # 6 shingles, in half of the items
    items = [(0, " ".join(f"r{i}" for i in range(44)))]  # 40 shingles of its own
    items += [(i, " ".join([*(template if i % 2 else []), *(f"i{i}x{k}" for k in range(8))])) for i in range(1, n)]
    text = " ".join([*(f"r{i}" for i in range(38)), *template[4:]])
    w, w_template = math.log(1 + n), math.log(1 + n / (n // 2))
    (row,) = d.contaminated(make_docs([(1, text)]), spark.createDataFrame(items, "item_id long, text string")).where("item_id = 0").collect()
    assert abs(row.similarity - 34 * w / (40 * w + 6 * w_template)) < 1e-9 and row.similarity > 0.8


def check(spark, make_docs, docs, items, threshold):
    got = {(x.doc_id, x.item_id): x for x in d.contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), threshold).collect()}
    want = brute(docs, items, threshold)
    assert set(got) == set(want)
    for k, (sim, start) in want.items():
        assert abs(got[k].similarity - sim) < 1e-9 and got[k].word_start == start
    return want


def test_starts_that_no_common_shingle_points_at(spark, make_docs):
    """Two words put into an item of 20 + 20: the start between the two that its ends imply is the best."""
    a, b = ["w0", *(f"a{i}" for i in range(19))], ["w0", *(f"b{i}" for i in range(19))]
    item = " ".join(["f0 f1 f2 f3 f4", *a[5:], *b[5:], "z0 z1 z2 z3 z4"])
    text = " ".join(["f0 f1 f2 f3 f4", *a[5:], "x y", *b[5:], "z0 z1 z2 z3 z4"])
    for threshold in (0.6, 0.7, 0.72, 0.74):
        check(spark, make_docs, [(1, text), (2, f"{text} {text}")], [(1, item)], threshold)


def test_a_run_common_to_other_items_weighs_as_it_does(spark, make_docs):
    run = " ".join(f"c{i}" for i in range(11))
    item = " ".join(f"i{i}" for i in range(100))
    items = [(0, item), *((k, f"o{k}a o{k}b o{k}c {run} o{k}d o{k}e") for k in range(1, 41))]
    text = " ".join(item.split()[:89]) + " " + run
    want = check(spark, make_docs, [(1, text)], items, 0.8)
    assert 0.8 < want[1, 0][0] < 0.9


def test_long_documents_repeated_ids_and_hashes_of_many_shingles(spark, make_docs):
    r = random.Random(8)
    say = lambda n: " ".join(f"v{r.randrange(50)}" for _ in range(n))
    items = [(i, say(r.choice((8, 20, 31)))) for i in range(25)] + [(3, say(20))]
    docs = [(1, say(3000) + " " + items[3][1] + " " + say(3000)), (1, say(5)), (1, items[5][1]), (2, " ".join(t for _, t in items)), (2, " ".join(t for _, t in items))]
    rows = d.contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(doc, i) for doc, i in brute([(k, t) for k, (_, t) in enumerate(docs)], [(k, t) for k, (_, t) in enumerate(items)])}
    assert {(x.doc_id, x.item_id) for x in rows} == {(docs[a][0], items[b][0]) for a, b in want} and len(rows) == len({(x.doc_id, x.item_id) for x in rows})
    big = spark.range(1).selectExpr("transform(sequence(1, 70000), i -> xxhash64(i)) AS g", "transform(sequence(1, 50000), i -> xxhash64(i)) AS h")
    for name, n in (("g", 70000), ("h", 50000)):
        grams = [x & (2**64 - 1) for x in big.select(name).first()[0]]
        fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in grams) > n)
        assert big.select(d.simhash(name)).first()[0] & (2**64 - 1) == fp


def test_clashing_columns_stay(spark, make_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    docs = make_docs([(1, "one two three four five six seven"), (2, "other")], _bad=1, bad=2, number=3, _w=4, body=5)
    (row,) = d.clean(docs, items).collect()
    assert row.asDict() == {**row.asDict(), "doc_id": 2, "_bad": 1, "bad": 2, "number": 3, "_w": 4, "body": 5}
