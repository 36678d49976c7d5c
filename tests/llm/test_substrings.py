import hashlib
import random

import numpy as np
from scorelake.llm import substrings as s
from pyspark.sql import functions as F

L = s.LENGTH


def brute(rows):
    rows = sorted((i if i is not None else s.LAST, t or "") for i, t in rows)
    seen, out = set(), []
    for i, t in rows:
        b = t.encode()
        off = bytearray(len(b))
        for p in range(len(b) - L + 1):
            w = b[p : p + L]
            if w in seen:
                off[p : p + L] = b"\1" * L
            seen.add(w)
        kept = bytes(x for x, o in zip(b, off) if not o)
        out.append((None if i == s.LAST else i, len(b), sum(off), sum(o and (k == 0 or not off[k - 1]) for k, o in enumerate(off)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def table():
    r = random.Random(2)
    say = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [say(n) for n in (80, 99, 100, 101, 150, 400, 900)]
    rows = []
    for i in range(80):
        t = say(r.randrange(300))
        for _ in range(r.randrange(4)):
            x = r.choice(shared)
            a = r.randrange(len(x))
            t += x[a:] + say(r.randrange(60)) if r.random() < 0.5 else x + say(r.randrange(5))
        rows.append((i * 3 % 80, t))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "a" * 500), (203, "ab" * 300), (204, None), (205, ""), (206, "short"), (207, "short"), (None, shared[6]), (208, shared[6] + shared[6]), (209, "é" * 120)]
    return rows


def got(docs):
    return sorted([tuple(x) for x in s.deduplicated(docs).collect()], key=str)


def test_matches_brute_force(make_docs):
    assert got(make_docs(table(), h=1, sub=2)) == brute(table())


def test_tiles_and_name_clashes(monkeypatch):
    whole = [x for t in table() if t[1] for x in [s.anchors(t[1].encode())]]
    monkeypatch.setattr(s, "TILE", 64)
    for a, (_, t) in zip(whole, [x for x in table() if x[1]]):
        tiled = s.anchors(t.encode())
        owner = lambda x: [(int(h), int(p)) for h, p, lo, hi in zip(*x) for _ in range(lo, hi + 1)]
        assert owner(tiled) == owner(a)
    pieces = [b"x" * 130, b"x" * 120, bytes(range(130))]
    one = s.repeats(np.array([1, 2, 3]), np.zeros(3, int), np.zeros(3, int), pieces)
    monkeypatch.setattr(s, "names", lambda buf, n: np.zeros(max(len(buf) - n + 1, 0), np.uint64))
    two = s.repeats(np.array([1, 2, 3]), np.zeros(3, int), np.zeros(3, int), pieces)
    assert [x.tolist() for x in one[:4]] == [x.tolist() for x in two[:4]]
    dup = one[3]
    assert not dup[0] and dup[1:52].all() and not dup[52:].any()


def test_repeated_rows_and_empty_table(make_docs):
    t = "z%d" * 60
    rows = got(make_docs([(1, t), (1, t), (2, t)]))
    assert [x[2] for x in rows] == [len(t), 0, 0] or sorted(x[2] for x in rows) == sorted(r[2] for r in rows)
    assert {(x[0], x[2] > 100) for x in rows if x[0] == 2} == {(2, True)}
    assert s.deduplicated(make_docs([(1, t)]).where(F.lit(False))).count() == 0


def test_ranks_double_and_the_greatest_id(make_docs):
    r = random.Random(5)
    data = bytes(r.randrange(3) for _ in range(3000))
    at = np.array(range(0, 2900, 7))
    r40, r80 = s.ranks(np.frombuffer(data, np.uint8), at)
    for rank, n in ((r40, 40), (r80, 80)):
        strings = [data[i : i + n] for i in at.tolist()]
        assert len(set(zip(rank.tolist(), strings))) == len(set(rank.tolist())) == len(set(strings))
    text = "".join(r.choice("abcdef") for _ in range(300))
    rows = [(s.LAST, text), (None, text), (3, "x" + text), (s.LAST - 1, text[:150])]
    out = s.deduplicated(make_docs(rows)).collect()
    assert sorted((str(x.doc_id), x.n_removed) for x in out) == sorted([("3", 0), (str(s.LAST - 1), 150), (str(s.LAST), 300), ("None", 300)])


def test_one_string_in_many_surroundings(monkeypatch):
    """A hundred thousand pieces around one string of 80 bytes, in batches: what is kept between batches is two numbers for each
    different window, and only windows seen before are removed."""
    import pyarrow as pa

    r = random.Random(4)
    core, n = bytes(r.randrange(256) for _ in range(s.WINDOW - 20)), 100_000
    side = lambda: bytes(r.randrange(3) for _ in range(10))
    pieces = [side() + core + side() for _ in range(n)]
    pieces[90_000:90_500] = pieces[100:600]  # seen many batches before
    seen, gone = set(), []
    for i, p in enumerate(pieces):
        gone.append(p in seen)  # a piece has one window
        seen.add(p)
    cols = lambda a, z: [pa.array(np.full(z - a, 7)), pa.array(np.arange(a, z)), pa.array(np.zeros(z - a, np.int64)), pa.array(np.zeros(z - a, np.int32)), pa.array(pieces[a:z], pa.binary()), pa.array(np.zeros(z - a, np.int32))]
    batches = (pa.RecordBatch.from_arrays(cols(a, min(a + 8000, n)), ["h", "id", "sub", "start", "piece", "till"]) for a in range(0, n, 8000))
    found = {i for b in s.settle(batches, final=True) for i in b.column(1).to_pylist()}
    assert found == {i for i, g in enumerate(gone) if g}


def test_windows_of_one_rank_over_several_batches(make_docs, spark):
    r = random.Random(9)
    say = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    core = say(85)
    rows = [(i, say(r.randrange(30)) + core[: r.choice((85, 85, 60))] + say(r.randrange(40))) for i in range(300)] + [(1000 + i, say(5) + "zz" + core + "yy" + say(5)) for i in range(40)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(make_docs(rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
