import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from scorelake.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    """The contract, unit by unit."""
    t = text or ""
    units = UNIT.findall(t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    p, m = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, z = "".join(units[:p]), "".join(units[p:m]), "".join(units[m:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    if h4 % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}"


def rows():
    r = random.Random(13)
    bits = ["word", " ", "  ", "\t", "\n", "\x1c", "\xa0", "é", "𝔘", "<", ">", "<S", "P>", "<P>", "end.", "\r\n"]
    out = [(i, "".join(r.choice(bits) for _ in range(r.randrange(60)))) for i in range(300)]
    out += [(1000 + i, "the same text on many rows") for i in range(200)]
    return out + [(900, None), (901, ""), (902, "   "), (903, "x"), (904, "ab " * 60_000), (950, "twice"), (950, "twice"), (950, "other one"), (None, "no key here at all"), (None, None)]


def test_outputs_match_the_plain_rule_and_are_restored(make_docs):
    docs = make_docs(rows(), output="mine", _key=1, n_units=2)
    df = infill.fill_in_middle(docs)
    assert df.columns == [*docs.columns, "_n_units", "form", "prefix_chars", "middle_chars", "_output"]
    got = [tuple(r) for r in df.select("doc_id", "text", "_n_units", "form", "prefix_chars", "middle_chars", "_output", infill.restored("_output", "form"), "output").collect()]
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted([(i, t, *plainly(i, t), t or "", "mine") for i, t in rows()], key=key)
    assert {g[3] for g in got} == {"plain", "spm", "psm"}


def test_index_holds_each_text_once(make_docs):
    found = infill.index(make_docs(rows())).collect()
    texts = {t or "" for _, t in rows()}
    assert len(found) == len(texts) and sorted(r.n for r in found) == sorted(len(UNIT.findall(t)) for t in texts)


def test_sql_gives_the_same_rows(make_docs, spark, tmp_path):
    make_docs(rows()).write.parquet(str(tmp_path / "documents.parquet"))
    got = infill.op13_distinct_text_index(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(infill.OP13_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_other_parameters_and_empty_table(make_docs):
    docs = make_docs(rows())
    none = infill.fill_in_middle(docs, rate=0)
    assert none.where("form <> 'plain' or output <> coalesce(text, '')").count() == 0
    every = infill.fill_in_middle(docs, rate=100, spm=0, seed=7)
    assert every.where("form = 'spm'").count() == 0 and every.where(infill.restored("output", "form") != F.coalesce("text", F.lit(""))).count() == 0
    assert infill.fill_in_middle(docs.where(F.lit(False))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=200))
def test_lists_select_every_number(gaps):
    ends = np.cumsum(np.array(gaps, np.int64))
    blob = infill.packed(ends)
    assert infill.select(blob, list(range(len(gaps) + 1))) == [0, *ends.tolist()]
    with pytest.raises(IndexError):
        infill.select(blob, [len(gaps) + 1])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n\x1c\x85éx𝔘"), max_size=40))
def test_units_are_the_patterns_matches(text):
    assert infill.ends_of(text).tolist() == np.cumsum([len(u) for u in UNIT.findall(text)]).astype(int).tolist()


def test_lists_are_small():
    ends = infill.ends_of("some words of a text " * 10_000)
    assert 8 * len(infill.packed(ends)) < 5 * len(ends)
