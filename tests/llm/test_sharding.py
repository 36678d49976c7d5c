import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest
from scorelake.llm import sharding
from pyspark.sql import functions as F


def brute(key, weights, rack=4, region=3):
    """The path of least draws, level by level."""

    def least(level, nodes, weigh):
        u = lambda i: (int(hashlib.md5(f"{'' if key is None else key}:{level}:{i}".encode()).hexdigest()[:13], 16) + 1) / 4503599627370497
        return min(nodes, key=lambda i: (-math.log(u(i)) / weigh(i) if weigh(i) else math.inf, i))

    n, leaf = len(weights), lambda i: weights[i]
    racks = -(-n // rack)
    of_rack = lambda k: sum(weights[k * rack : (k + 1) * rack])
    of_region = lambda r: sum(weights[r * rack * region : (r + 1) * rack * region])
    r = least("region", range(-(-racks // region)), of_region)
    k = least("rack", range(r * region, min((r + 1) * region, racks)), of_rack)
    return least("shard", range(k * rack, min((k + 1) * rack, n)), leaf)


def test_matches_brute_force_and_law(make_docs):
    docs = make_docs([(i, f"text {i % 7}" * (i % 3)) for i in range(400)] + [(None, None), (5, "again"), (5, "again"), (6, "x" * 3_000_000)], shard=1, law="x", _rack=2)
    rows = sharding.shard_rows(docs).collect()
    assert len(rows) == 404
    text = Counter(zlib.crc32((f"text {i % 7}" * (i % 3)).encode()) for i in range(400))
    assert text - Counter(r.text_crc32 for r in rows) == Counter()
    for r in rows:
        assert r.shard == brute(r.doc_id, [1] * 24) and r.grown_shard == brute(r.doc_id, [1] * 25)
        assert r.grown_shard in (r.shard, 24)
    for s in range(24):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size) for r in own]
        assert keys == sorted(keys)
    assert [r.size for r in rows if r.doc_id is None] == [8]


@pytest.mark.parametrize("n", [5, 11, 12, 13, 24, 30])
def test_growth_and_weights_move_rows_only_within_what_changes(spark, n):
    df = spark.range(2000).withColumnRenamed("id", "k")
    w = [1.0] * n
    grown = sharding.place(sharding.place(df, "k", w, "a"), "k", [*w, 1.0], "b").where("a <> b").collect()
    region = lambda s: s // 12
    assert all(region(x.b) == region(n) for x in grown)  # into the region of the new shard, or within it
    if n % 12 == 0:
        assert {x.b for x in grown} == {n}
    v = [*w[:3], 3.0, *w[4:]]
    moved = sharding.place(sharding.place(df, "k", w, "a"), "k", v, "b").where("a <> b").collect()
    assert moved and all(region(x.b) == 0 for x in moved)
    for x in df.transform(lambda d: sharding.place(d, "k", [*w[:-1], 0.0], "a")).limit(50).collect():
        assert x.a == brute(x.k, [*w[:-1], 0.0]) != n - 1


def test_slots_do_not_depend_on_the_slices(spark, make_docs, monkeypatch):
    docs = make_docs([(i * i % 997, f"x{i % 5}") for i in range(1000)] + [(None, "y"), (None, "z")])
    want = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard_rows(docs).collect()}
    monkeypatch.setattr(sharding, "SLICE_ROWS", 90)
    assert len(sharding.slices(docs, "doc_id")) > 5
    assert {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard_rows(docs).collect()} == want
    assert sharding.shard_rows(make_docs([(1, "x")]).where(F.lit(False))).count() == 0


def test_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = sorted(c.execute(f"SELECT doc_id, size, text_crc32, law, shard, slot, grown_shard FROM ({sharding.OP6_SQL})").fetchall())
    assert sorted(map(tuple, sharding.op6_hash_tree(spark, sf).collect())) == want
