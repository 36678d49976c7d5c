import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F
from scorelake.llm import personal as p

WS = r"\x20\x09-\x0D"
RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def valid(kind, piece):
    d = [int(c) for c in piece if c.isascii() and c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in piece.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base(text):
    """(start, kind, end) by the contract."""
    return sorted((m.start(), k, m.end()) for k, (kind, rx) in enumerate(RULES) for m in re.finditer(rx, text or "") if valid(kind, m[0]))


def listed(spans):
    return ",".join(f"{p.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def lowered(t):
    return re.sub("[1-9]", "0", t.lower())


def learned(texts, high=p.HIGH, support=p.SUPPORT, rounds=p.ROUNDS):
    """Row number: spans (start, 4, end), by the definition: whole corpus, plain loops."""
    places, count = [], defaultdict(int)
    for row, t in enumerate(texts):
        t = t or ""
        w = re.split(f"[{WS}]+", lowered(t))
        for i, x in enumerate(w):
            count[x,] += 1
            if i:
                count[w[i - 1], x] += 1
        found = list(re.finditer(rf"(?<![^{WS}])[^{WS}]*[0-9@][^{WS}]*(?:\x20[().0-9-]+(?![^{WS}]))*", t))
        ends = [0, *[m.end() for m in found]]
        starts = [*[m.start() for m in found], len(t)]
        known = base(t)
        for j, m in enumerate(found):
            s = m.start() + len(m[0]) - len(re.sub(r"^[!-'*,-/:-?\[-`{-~]+", "", m[0]))
            e = m.end() - len(m[0]) + len(re.sub(r"[!-(*-/:-@\[-`{-~]+$", "", m[0]))
            if not (re.search("[^@]@[^@]|([0-9][^0-9]*){4}", t[s:e])):
                continue
            left = [x for x in re.split(f"[{WS}]+", lowered(t[ends[j] : m.start()][-80:])) if x]
            right = [x for x in re.split(f"[{WS}]+", lowered(t[m.end() : starts[j + 1]][:80])) if x]
            pats = [("before", tuple(left[-1:]))] * bool(left) + [("before2", tuple(left[-2:]))] * (len(left) > 1) + [("after", tuple(right[:1]))] * bool(right)
            seed = next((k for a, k, b in known if a < e and b > s), None)
            places.append((row, s, e, t[s:e].lower(), seed, pats))
    edges, seeds = defaultdict(lambda: defaultdict(int)), {}
    for _, _, _, v, seed, pats in places:
        for x in pats:
            edges[x][v] += 1
    for _, _, _, v, seed, pats in places:
        if seed is not None and any(len(edges[x]) >= support for x in pats):
            seeds[v] = max(seed, seeds.get(v, seed))
    scores, good = {v: (k, 1.0) for v, k in seeds.items()}, {}
    for _ in range(rounds):
        good = {}
        for x, vs in edges.items():
            if len(vs) < support:
                continue
            for k in range(4):
                hits = sum(n * scores[v][1] for v, n in vs.items() if v in scores and scores[v][0] == k)
                mass = sum(scores[v][1] for v in vs if v in scores and scores[v][0] == k)
                if mass >= support and hits / (max(count[x[1]], hits) + 1) >= high:
                    good[x, k] = hits / (max(count[x[1]], hits) + 1)
        if not good:
            break
        new = {}
        for v in {v for x, _ in good for v in edges[x]} - set(seeds):
            kinds = {k: 1 - math.prod(1 - c for (x, kk), c in good.items() if kk == k and v in edges[x]) for k in range(4)}
            k = max(kinds, key=lambda k: (kinds[k], -k))
            new[v] = (k, kinds[k])
        scores = {**{v: (k, 1.0) for v, k in seeds.items()}, **new}
    out = defaultdict(set)
    for row, s, e, _, seed, pats in places:
        if seed is None and any((x, k) in good for x in pats for k in range(4)):
            out[row].add((s, 4, e))
    return out


def check(docs, rows, **learning):
    got = p.report(docs, **learning).collect()
    extra = learned([t for _, t in rows], **learning)
    want = []
    for r, (i, t) in enumerate(rows):
        b = base(t)
        want.append((i, *[sum(k == n for _, k, _ in b) for n in range(4)], hashlib.sha256(listed(b).encode()).hexdigest(), listed(sorted([*b, *extra[r]])), len(extra[r])))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return extra


def test_base_matches_brute_force(make_docs):
    r = random.Random(7)
    bits = ["a@b.c", "_x", "@", ".", "1.2.3.4", "256.1.1.1", "001.0002.3.4", "+1 (123) 555-0199", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "12", "7 ", "-", " ", "\n", "é𝔘", "b.co", "%", "(", ")", "word", "x1", "+44 20 7946 0018", "٣٤٥٦"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(30)))) for i in range(500)]
    rows += [(900, None), (901, ""), (902, "1 " * 20_000), (903, "a" * 50_000 + "@b.c"), (904, "x@" * 5000), (950, "again a@b.cd"), (950, "again a@b.cd"), (None, "+1 (123) 555-0199")]
    check(make_docs(rows, personal=1, _body="x", spans=2), rows)


def story(r):
    """Numbers after a trigger, some of forms that no pattern knows; a second trigger that shares only learned values."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    words = lambda: " ".join(r.choice("the of a house stands near river 2024 and 17".split()) for _ in range(r.randrange(3, 9)))
    rows, unseen = [], [f"0{digits(3)}/{digits(6)}" for _ in range(12)]
    for i in range(60):
        rows.append(f"{words()} call Phone: +1 ({digits(3)}) 555-{digits(4)} today {words()}")
        rows.append(f"{words()} the {digits(8)} of {words()}")
    for i, u in enumerate(unseen):
        rows.append(f"{words()} phone: {u}, or {words()}")
        rows.append(f"{words()} reach-them-on {u} or {words()}")
    rows.append(f"{words()} reach-them-on 0999/123123 or {words()}")
    rows += [f"one passage with reference-number {digits(0)}77123456 in it"] * 40
    return rows, unseen


def test_contexts_find_unseen_identifiers(make_docs):
    texts, unseen = story(random.Random(12))
    rows = list(enumerate(texts))
    extra = check(make_docs(rows), rows)
    hit = [texts[r][s:e] for r, spans in extra.items() for s, _, e in spans]
    assert set(unseen) <= set(hit) and hit.count("0999/123123") == 1  # the second trigger is learned from what the first one found
    assert not any("77123456" in x for x in hit) and all("/" in x for x in hit)


def test_words_are_joined_where_there_are_too_many_to_send(make_docs, monkeypatch):
    monkeypatch.setattr(p, "BROADCAST_BYTES", 0)
    rows = list(enumerate(story(random.Random(5))[0]))
    assert check(make_docs(rows), rows)


def test_columns_stay_and_empty_table(make_docs):
    docs = make_docs([(1, "mail a@b.cd now"), (2, None)], personal="mine", _row=3, _tokens=4)
    got = {r.doc_id: r for r in p.scan(docs).collect()}
    assert got[1].personal == "mine" and got[1]._row == 3 and [(x.start, x.end, x.piece) for x in got[1]._personal] == [(5, 11, "a@b.cd")] and got[2]._personal == []
    assert p.report(docs.where(F.lit(False))).count() == 0
