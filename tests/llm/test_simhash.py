import random

import xxhash
from scorelake.llm import simhash as s
from pyspark.sql import functions as F


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fp) with distinct ids; least id reachable by links of up to 2 bits."""
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return {i: root(i) for i, _ in rows}


def test_fingerprints_and_components_match_brute_force(make_docs):
    r = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    for i in range(60):
        t = texts[r.randrange(len(texts))].split()
        t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    texts += ["", None, " \t\n", texts[3], texts[3].upper(), "É é", "one", "one two"]
    rows = list(enumerate(texts))
    got = {x.doc_id: x for x in s.components(make_docs(rows, component_id=7, fp=1)).collect()}
    fps = [(i, brute_fp(t)) for i, t in rows]
    assert all(got[i].fp & (2**64 - 1) == f for i, f in fps)
    assert {i: got[i].component_id for i, _ in rows} == brute_components(fps)


def chain(spark, fps):
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    got = {x.node: x.component for x in s.components_of(s.links(nodes)).collect()}
    return {i: got.get(i, i) for i in range(len(fps))}


def test_long_chains_and_large_lists(spark, monkeypatch):
    r = random.Random(8)
    base = r.getrandbits(64)
    fps, x = [base], base
    for _ in range(60):  # a chain of small steps: ends far apart
        x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
        fps.append(x)
    fps += [base ^ m for m in r.sample(range(1, 1 << 16), 120)]  # one posting list of many
    fps = list(dict.fromkeys(fps))
    want = brute_components(list(enumerate(fps)))
    assert chain(spark, fps) == want
    assert dict(s.stars(fps[61:], list(range(61, len(fps))), (0, 1, 2, 3))) is not None
    monkeypatch.setattr(s, "PAIRWISE", 4)
    few, many = fps[61:], list(range(61, len(fps)))
    masks = dict(s.stars([f - (1 << 64) if f >> 63 else f for f in few], many, (0, 1, 2, 3)))
    own = brute_components(list(zip(many, few)))
    assert {i: masks.get(i, i) for i in many} == own


def test_keep_one_and_empty(make_docs):
    docs = make_docs([(5, "a b c d e"), (2, "A b c d e"), (9, "quite another text here"), (None, "no id"), (2, "A b c d e")])
    assert sorted(str(r.doc_id) for r in s.keep_one(docs).collect()) == ["2", "9", "None"]
    assert s.components(docs.where(F.lit(False))).count() == 0


def test_every_pair_of_enough_shared_bytes_meets_and_is_tallied():
    import numpy as np

    r = random.Random(2)
    for _ in range(300):
        a = r.getrandbits(64)
        gone = r.sample(range(8), r.randrange(4))
        b = a ^ sum(r.randrange(1, 256) << 8 * i for i in gone)
        assert s.tally(np.array([a ^ b], np.uint64))[0] == 8 - len(gone)
        meets = [f for f in s.FREE if all(a >> 8 * i & 255 == b >> 8 * i & 255 for i in range(8) if i not in f)]
        assert meets or len(gone) > 2


def test_clashing_columns_repeated_rows_and_long_texts(make_docs):
    docs = make_docs([(5, "a b c d e"), (5, "a b c d e"), (5, "a b"), (6, "z y x " * 200_000)], _row=1, fp=2, component_id=3, n=4)
    kept = s.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == [5, 6] and all((r._row, r.fp, r.component_id, r.n) == (1, 2, 3, 4) for r in kept)
    assert s.fingerprint("z y x " * 200_000) == brute_fp("z y x " * 200_000)


def test_rounds_of_stars_take_few_tasks(spark, monkeypatch):
    """A round was 11 times the shuffle partitions in tasks; now fewer than 6 (pipeline)."""
    rounds, cut, sc = [], s.cut, spark.sparkContext
    monkeypatch.setattr(s, "cut", lambda df: rounds.append(1) or cut(df))
    edges = [(i, i + 1) for i in range(40) if i != 20] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    edges = cut(spark.createDataFrame(edges, "a long, b long"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sc.setJobGroup("stars", "stars")
        groups = s.components_of(edges)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker, tasks = sc.statusTracker(), 0
    for job in tracker.getJobIdsForGroup("stars"):
        for stage in tracker.getJobInfo(job).stageIds:
            info = tracker.getStageInfo(stage)
            tasks += info.numCompletedTasks if info else 0
    assert 0 < tasks < 6 * 60 * len(rounds), (tasks, len(rounds))
    got = {(r.node, r.component) for r in groups.collect()}
    assert got == {(i, 0 if i <= 20 else 21) for i in range(1, 41) if i != 21} | {(i, 100) for i in range(101, 160)}
