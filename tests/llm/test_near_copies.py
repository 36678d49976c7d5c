import random
import time

import corpus_pipeline
from scorelake.llm import near_copies as nc
from scorelake.llm import simhash


def brute(rows):
    """Least id reachable over pairs whose 5-word shingle sets have Jaccard similarity 0.8."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else {()}
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return {i: root(i) for i in sets}


def planted():
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(r.choice(words) for _ in range(30))
    base = [[r.choice(words) for _ in range(r.randrange(20, 150))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for k in range(90):  # copies with one to four words changed: above and below the threshold
        b = list(base[k % 12])
        for _ in range(1 + k % 4):
            b[r.randrange(len(b))] = "new"
        texts.append(" ".join(b))
    for k in range(60):  # a large group about one text, and texts that only share a line
        b = list(base[0])
        b[r.randrange(len(b))] = r.choice(words)
        texts += [" ".join(b), f"{line} {' '.join(r.choice(words) for _ in range(r.randrange(3, 30)))}"]
    texts += ["", None, " \n", "one two", "One  two", "a b c d e", texts[3].upper()]
    return list(enumerate(texts))


def test_components_match_brute_force(make_docs):
    rows = planted()
    got = {x.doc_id: x.component_id for x in nc.components(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_stage_drops_near_copies_that_few_bits_do_not_link(spark, make_docs):
    rows = planted()
    want = set(brute(rows).values())
    docs = make_docs(rows)
    kept = {x.doc_id for x in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == want and len(kept) < simhash.keep_one(docs).count()


def test_long_lists_go_by_pairs_of_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(nc, "CELL", 3)
    monkeypatch.setattr(nc, "TURNS", 0)
    monkeypatch.setattr(nc, "BROADCAST_BYTES", 0)
    rows = planted()
    got = {x.doc_id: x.component_id for x in nc.components(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_sketches_keep_pairs_at_the_threshold():
    """Of pairs of random texts with a similarity between 0.8 and 0.9 none is lost to either sketch."""
    import numpy as np

    r = random.Random(3)
    words = [b"w%d" % i for i in range(3000)]
    far = 0
    pairs = []
    while len(pairs) < 800:
        a = [r.choice(words) for _ in range(r.choice([12, 30, 80, 300, 1200]))]
        b = list(a)
        while True:
            b[r.randrange(len(b))] = r.choice(words)
            x, y = nc.shingles(a, 5), nc.shingles(b, 5)
            common = len(np.intersect1d(x, y))
            j = common / (len(x) + len(y) - common)
            if j < 0.8:
                break
            if j < 0.9:
                pairs.append((x, y))
    for x, y in pairs:
        bits = [bin((int(f(x)) ^ int(f(y))) & (2**64 - 1)).count("1") for f in (simhash.majority, nc.minima)]
        far += bits[0] > nc.NEAR or bits[1] > nc.MINIMA
    assert far == 0


def test_a_pair_goes_on_from_the_first_list_only(spark, monkeypatch):
    """Texts alike but under the threshold share many lists: each pair is made once, in cells of one block or of several."""
    for cell in (1000, 5):
        monkeypatch.setattr(nc, "CELL", cell)
        rows = [(g, node, 40, g, node, 0, 0) for g in range(8) for node in range(1, 13) if (g + node) % 3]
        lists = spark.createDataFrame([(g + 1, *r) for g, *r in rows], "gram long, node long, n int, at int, group long, fp long, sk long")
        raw = []
        distinct = type(lists).distinct
        monkeypatch.setattr(type(lists), "distinct", lambda df: raw.append(df) or df)
        nc.all_pairs(lists, 0.5)
        monkeypatch.setattr(type(lists), "distinct", distinct)
        got = sorted((r.a, r.b) for r in raw[0].repartition(1).collect())
        held = {}
        for g, node, *_ in rows:
            held.setdefault(node, set()).add(g)
        want = sorted((a, b) for a in held for b in held if a < b and held[a] & held[b])
        assert got == want


def test_fingerprints_meet_in_the_index_first(spark):
    """Pairs within the index's two bits come from it, and those beyond do not."""
    named = spark.createDataFrame([(1, 10, 0), (2, 20, 3), (3, 30, 0), (4, 40, 255)], "doc_id long, node long, fp long")
    assert sorted((r.a, r.b) for r in nc.by_index(named).collect()) == [(10, 20), (10, 30)]


def test_stage_leaves_no_shuffle_files_of_its_steps(spark, make_docs):
    """They stayed until the driver's garbage went, some 240 MB of small files on check_h (pipeline)."""
    words = random.Random(5)
    texts = [" ".join(str(words.randrange(50)) for _ in range(40)) for _ in range(20)]
    docs = make_docs([(i, t) for i, t in enumerate(texts + [t + " more" for t in texts])])
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    spark.sparkContext._jvm.System.gc()  # what earlier tests left goes first
    time.sleep(2)
    before = files()
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert files() - before < 20
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(20))


def test_a_large_group_goes_on_as_links_not_as_pairs(make_docs, monkeypatch):
    """All pairs of a group of near copies were verified and grouped as rows (pipeline on check_h: 303,626 pairs, 16,533 of them near)."""
    monkeypatch.setattr(nc, "TURNS", 0)
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(100):
        words = list(base)
        words[r.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(words)))
    made = []
    verified, grouped = nc.verified, nc.components_of
    monkeypatch.setattr(nc, "verified", lambda pairs, *a: made.append(pairs.count()) or verified(pairs, *a))
    monkeypatch.setattr(nc, "components_of", lambda edges: made.append(edges.count()) or grouped(edges))
    got = {x.doc_id: x.component_id for x in nc.components(make_docs(rows)).collect()}
    assert got == brute(rows) and set(got.values()) == {0}
    assert sum(made) < 10 * len(rows)  # of 4,950 pairs


def test_cells_of_few_shingles_lose_no_link(make_docs, monkeypatch):
    """Members that carry their sets are dealt by the sets' sizes too; links of several cells and turns grow together."""
    monkeypatch.setattr(nc, "CELL_GRAMS", 300)
    rows = planted()
    for turns in (0, 1):
        monkeypatch.setattr(nc, "TURNS", turns)
        got = {x.doc_id: x.component_id for x in nc.components(make_docs(rows)).collect()}
        assert got == brute(rows)
