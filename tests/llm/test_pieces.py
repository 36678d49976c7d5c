import math
from collections import Counter
from functools import lru_cache

import pytest
from scorelake.llm import pieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary()


@pytest.fixture
def lattice(vocabulary):
    return P.Lattice(vocabulary)


def brute(text, v):
    """All segmentations of a text over the whole vocabulary, cut nowhere, with their probabilities."""
    s = "▁" + text.replace(" ", "▁")

    @lru_cache(None)
    def paths(i):
        if i == len(s):
            return {(): 1.0}
        out = {}
        for n in range(1, v.longest + 1):
            k = v.id.get(s[i : i + n]) if i + n <= len(s) else None
            ids = (k,) if k is not None else tuple(v.byte[b] for b in s[i].encode()) if n == 1 and s[i] not in v.id else None
            if ids:
                w = math.exp(sum(v.logp[x] for x in ids))
                for rest, p in paths(i + n).items():
                    out[ids + rest] = out.get(ids + rest, 0) + w * p
        return out

    all_ = paths(0)
    total = sum(all_.values())
    return {k: p / total for k, p in all_.items()}


def test_samples_follow_the_lattice_and_inclusion_scores_are_fair(vocabulary, lattice):
    want, n = brute("theses", vocabulary), 4000
    got = P.sample(["theses"] * n, [P.seed_of(i) for i in range(n)], lattice, 3)
    first = Counter(tuple(r[0][0].tolist()) for r in got)
    for ids, p in sorted(want.items(), key=lambda x: -x[1])[:5]:
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p / n) + 1e-3
    total = sum(math.exp(x[1]) / x[3] for r in got for x in r) / n
    assert abs(total - 1) < 0.02  # Horvitz-Thompson: the inclusion scores make probabilities sum to 1
    for r in got:
        assert len({tuple(x[0].tolist()) for x in r}) == 3
        assert r[0][2] > r[1][2] > r[2][2]
        assert all(abs(math.exp(x[1]) - want[tuple(x[0].tolist())]) < 1e-9 for x in r)


def test_few_segmentations_are_exhausted(vocabulary, lattice):
    want = brute("é", vocabulary)
    (rows,) = P.sample(["é"], [5], lattice, 50)
    assert {tuple(x[0].tolist()) for x in rows} == set(want) and all(x[3] == 1.0 for x in rows)
    assert abs(sum(math.exp(x[1]) for x in rows) - 1) < 1e-9


def test_round_trip_and_batches_do_not_matter(vocabulary, lattice):
    texts = ["Hello  two spaces ", "line\nbreak\ttab", "漢字 😀 x" * 3, "a" * 500, " ", "", "  lead", "\n  indented\n\n x", "two  \nends ", "▁ own", "no\0nul", "w " * 3000, "é̈ü"]
    seeds = [P.seed_of(i) for i in range(len(texts))]
    whole = P.sample(texts, seeds, P.Lattice(vocabulary), 4)
    for t, s, rows in zip(texts, seeds, whole):
        (alone,) = P.sample([t], [s], lattice, 4)
        assert [x[0].tolist() for x in alone] == [x[0].tolist() for x in rows]
        assert all(vocabulary.decode(x[0].tolist()) == t.replace("▁", " ") for x in rows)
    import numpy as np

    ids = [x[0] for rows in whole for x in rows]
    held = [t for t, rows in zip(texts, whole) for _ in rows]
    size = np.array([len(x) for x in ids])
    assert vocabulary.round_trips(np.concatenate(ids), size, held) == [True] * len(ids)
    assert vocabulary.round_trips(np.concatenate(ids), size, [*held[:-1], "other"]) == [True] * (len(ids) - 1) + [False]


@pytest.mark.parametrize("text", ["a   b", "x\ny", "  q", "zz \n  z", "é \t é"])
def test_all_segmentations_of_texts_with_spaces_and_lines(vocabulary, lattice, text):
    want = brute(text, vocabulary)
    (rows,) = P.sample([text], [9], lattice, len(want) + 5)
    got = {tuple(x[0].tolist()): math.exp(x[1]) for x in rows}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_long_words_follow_the_uncut_lattice(vocabulary, lattice):
    """A word of 60 characters: the chances that each piece is used, against sums over the whole lattice."""
    text, n = "internationalization" * 3, 3000
    s = "▁" + text
    size, v = len(s), vocabulary
    w = {(i, j): math.exp(v.logp[v.id[s[i:j]]]) for i in range(size) for j in range(i + 1, min(size, i + v.longest) + 1) if s[i:j] in v.id}
    ahead, behind = [1.0] + [0.0] * size, [0.0] * size + [1.0]
    for j in range(1, size + 1):
        ahead[j] = sum(ahead[i] * x for (i, e), x in w.items() if e == j)
    for i in range(size - 1, -1, -1):
        behind[i] = sum(x * behind[j] for (b, j), x in w.items() if b == i)
    used = Counter()
    for rows in P.sample([text] * n, [P.seed_of(i) for i in range(n)], lattice, 1):
        at = 0
        for x in rows[0][0].tolist():
            used[at, at + len(v.pieces[x])] += 1
            at += len(v.pieces[x])
    for (i, j), x in w.items():
        p = ahead[i] * x * behind[j] / ahead[size]
        assert abs(used[i, j] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_every_key_has_its_own_draws():
    """32 bits would repeat among so many keys."""
    assert len({P.seed_of(i) for i in range(300_000)}) == 300_000


def test_very_long_texts_and_an_empty_table(make_docs, vocabulary, lattice):
    text = "漢字かな" * 20_000 + "ab" * 5_000
    (rows,) = P.sample([text], [3], lattice, 2)
    assert len(rows) == 2 and all(vocabulary.decode(x[0]) == text for x in rows)
    assert P.sampled(make_docs([])).count() == 0


def test_table(make_docs):
    rows = P.sampled(make_docs([(1, "some text here"), (2, None), (3, ""), (None, "x y"), (1, "some text here")], sample=4, ids="q")).collect()
    assert all(r.decoded for r in rows) and not [r for r in rows if r.doc_id == 2]
    assert Counter(r.doc_id for r in rows)[1] == 4 and sum(r.doc_id == 3 for r in rows) == 1
    assert len({tuple(r.ids) for r in rows if r.doc_id == 1}) == 2


def test_what_the_lattice_forgets_does_not_matter(vocabulary, monkeypatch):
    monkeypatch.setattr(P, "KEPT", 400)
    small, texts = P.Lattice(vocabulary), [f"word{i} other{i * i} the and {'long' * (i % 9)}" for i in range(120)]
    got = []
    for i, t in enumerate(texts):
        small.shrink()
        got += P.sample([t], [i], small, 2)
    want = P.sample(texts, range(len(texts)), P.Lattice(vocabulary), 2)
    assert small.nodes < 600
    assert [[(x[0].tolist(), *x[1:]) for x in rows] for rows in got] == [[(x[0].tolist(), *x[1:]) for x in rows] for rows in want]
