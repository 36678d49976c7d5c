import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from scorelake.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows, rebuild=True):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    if not rebuild:
        return own
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + v[h:]
    return out


def plainly(seqs):
    """Every node by its whole sequence, every sum over its whole subtree."""
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rows(seed, n=160):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.randrange(1, 9)):
            out.append((c if c % 40 != 20 else 5000 + c, t, r.choice(["user", "assistant"]) if r.random() < 0.2 else "user", r.choice(["hello there", "a", "b b", " ", "né\x0bx\x1cy"])))
    out += [(3, None, "user", "first"), (3, None, None, "first"), (4, 1, "user", None), (4, 1, "user", None), (None, 0, "user", "nobody's"), (None, None, None, None)]
    out += [(c, 0, "user", "the same first turn") for c in range(20_000, 20_120)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_match_brute_force_and_sql(spark, tmp_path, seed):
    given = rows(seed)
    spark.createDataFrame(given, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = tries.op11_prefix_trie(spark, str(tmp_path))
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == plainly(sequences(given))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(tries.OP11_SQL)
    assert got.columns == [c[0] for c in want.description] and sorted(want.fetchall(), key=str) == found


def test_long_conversations_go_by_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(tries, "LONG", 50)
    monkeypatch.setattr(tries, "BLOCK", 8)
    monkeypatch.setattr(tries, "PIECE", 4)
    r = random.Random(3)
    given = rows(4, 40) + [(c, t, "user", r.choice("ab") if t > 30 * c % 70 else "a") for c in range(100, 112) for t in range(90 + c % 3)]
    got = tries.prefix_trie(spark.createDataFrame(given, SCHEMA).withColumn("depth", F.lit("mine")).withColumn("place", F.lit(1)))
    assert sorted(map(tuple, got.collect()), key=str) == plainly(sequences(given, rebuild=False))


def test_turnless_conversations_and_empty_table(spark):
    """Conversations of one turn that take more from absent ones: a root without children, of two members."""
    taken = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1001, 1019)}
    two = [c for c, h in taken.items() if h][:2]
    given = [(c, 0, "user", "x") for c in two]
    df = spark.createDataFrame(given, SCHEMA)
    found = [tuple(x) for x in tries.trie(*tries.rebuilt(tries.ordered(df))).collect()]
    assert found == plainly(sequences(given)) and found[0][3:6] == (2, 0, 1)
    assert tries.prefix_trie(df.where(F.lit(False))).count() == 0
