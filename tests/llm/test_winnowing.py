import hashlib

import regex
import xxhash
from scorelake.llm import winnowing as w
from pyspark.sql import functions as F

UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
TOKEN = regex.compile(rf"(?V1)[[\p{{L}}\p{{M}}\p{{N}}]--[{UNSPACED}]]+|[{UNSPACED}]")


def chosen(text):
    t = TOKEN.findall(text.lower())
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & (2**64 - 1)
    hashes, grams, roll = [xxhash.xxh64_intdigest(x.encode(), 42) for x in t], [], 0
    for j, h in enumerate(hashes):  # the roll: one token enters, one leaves
        roll = turn(roll, 1) ^ h
        if j >= w.K:
            roll ^= turn(hashes[j - w.K], w.K)
        if j >= w.K - 1:
            grams.append((roll >> 31, j - w.K + 1))
    if 0 < len(t) < w.K:
        grams = [(turn(roll, w.K - len(t)) >> 31, 0)]
    out = []
    for s in range(max(len(grams) - w.WINDOW, 0) + 1 if grams else 0):
        h, i = min(grams[s : s + w.WINDOW], key=lambda x: (x[0], -x[1]))
        if (h, i) not in out:
            out.append((h, i))
    return out


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt, n = rows[(k + 1) % len(rows)][1], len(t)
        e = t[: n - n // 2] + nxt[: n // 2]
        a, b = chosen(t), chosen(e)
        text = lambda c: " ".join(f"{h:x}:{p}" for h, p in c)
        out.append((i, n, hashlib.sha256(e.encode()).hexdigest(), text(a), text(b), round(like(a, b), 9), round(like(a, chosen(nxt)), 9)))
    return sorted(out, key=str)


def run(docs):
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in w.fingerprints(docs).collect()], key=str)


def test_matches_brute_force(make_docs):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(words[(i * j * j + j) % 10] for j in range(i % 40))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "漢字かな混じり文とabc123漢字"), (1003, "..., !"), (1004, "x" * 300), (-5, "𝔘 nicode 𝔘𝔘 é è ü ß Straße"), (None, "no key at all"), (7, "twice"), (7, "twice")]
    rows += [(2000, " ".join(words[(j * j * 7 + j // 3) % 10] for j in range(5000)))]
    got = run(make_docs(rows, fingerprint="clash", own=1))
    assert got == brute(rows)
    assert len({r[3] for r in got if r[:2] == (7, 5)}) == 1


def test_slices_of_the_order_do_not_matter(make_docs, monkeypatch):
    rows = [(i * i, f"word{i} common words here number {i % 5} and again {i}") for i in range(300)]
    whole = run(make_docs(rows))
    monkeypatch.setattr(w, "SLICE_ROWS", 2)
    monkeypatch.setattr(w, "QUANTILES", 5)
    assert run(make_docs(rows)) == whole == brute(rows)
    monkeypatch.setattr(w, "SLICES", 20)
    assert run(make_docs(rows)) == whole


def test_long_tokens_and_texts(make_docs):
    rows = [(1, "x" * 100_000 + " tail of words here and there"), (2, "many words " * 30_000), (3, "y " * 200)]
    assert run(make_docs(rows)) == brute(rows)


def test_one_row_and_no_row(make_docs):
    assert run(make_docs([(3, "just one row of text here")])) == brute([(3, "just one row of text here")])
    assert w.fingerprints(make_docs([(3, "x")]).where(F.lit(False))).count() == 0
