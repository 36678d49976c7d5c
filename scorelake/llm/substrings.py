"""Suffix-array dedup of repeated byte strings: prefix doubling over sorted rank pairs, with early discarding.

Every byte covered by a string of LENGTH bytes that also starts earlier (smaller doc_id; in one document, earlier start) is
removed; matches stay within documents and are judged on the input.

Textbook prefix doubling sorts a (rank, rank) pair for every byte position in every round: at 24 bytes a pair that is tens
of times the input in each shuffle. What the result needs is less: whether the LENGTH-byte prefix of a suffix has been seen.
So positions are discarded before they are ever sorted, and the rounds run on those that stay:

1. Whole texts that occur again are settled by their digest; only the first copy goes on.
2. A window of LENGTH bytes is represented by its anchor, the least hash among its SEED-byte strings (rightmost of equal
   ones): equal windows have equal anchors at equal offsets. Spark sorts the anchors, the ranks of SEED = 20 bytes; unique
   ones are discarded with all their windows.
3. Rounds: a rank at length 2h is made from the pair of ranks (rank[i], rank[i + h]). At h = 20, then 40, Spark sorts the
   pairs of all positions i on the anchors' grids that lie in such windows; positions whose pair is unique are discarded,
   the others go on with their new rank. A frequent anchor so falls apart by what surrounds it.
4. Past 80 bytes the threshold is an overlap away: windows that share a rank of 80 bytes are sorted by it and by place, and
   compared: two names of these 80 bytes, 128 bits together, and the 20 others byte by byte. The first of equal ones stays.

Before each shuffle a batch settles its own repeats: ranks that are frequent in it need no counting, are dealt by their place
and leave one marker, and of equal windows it sends on only what it saw first. So a string in a third of all texts sends a
few rows a batch to its task. What the anchors and the rounds leave is written to the shared folder, and their shuffles end.

Defined cases: a null text is empty; texts under LENGTH bytes keep all; a null doc_id comes after all others; rows with equal
doc_id and text are one document, with equal doc_id and other texts they follow each other by digest; very long texts are
taken whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffles_freed, stored, table

LENGTH, SEED = 100, 20
#: The length of the last rank, after two doublings.
LAST_RANK = 4 * SEED
#: A piece holds 128 bits for its 80 bytes and the bytes beside them, so a window is this long in it.
WINDOW = LENGTH - LAST_RANK + 16
#: Ranks that a batch holds so often are known to be repeated and need no counting.
OFTEN = 8
#: Documents above this size are cut into tiles that overlap by a window.
TILE = 1 << 23
#: Texts are cut into pieces together up to so many bytes, which bounds the arrays over their windows.
TOGETHER = 2_000_000
LAST = 2**63 - 1
BASE = 0x100000001B3


def names(buf, length: int):
    """64-bit names of all strings of a length in a byte array, by doubling: each from a pair of shorter ones."""
    if len(buf) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        cur, power, n = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), np.uint64(BASE), 1
        out, size = None, 0
        bits = length
        while bits:
            if bits & 1:
                out, size = (cur, n) if out is None else (out[: len(buf) - size - n + 1] * power + cur[size : len(buf) - n + 1], size + n)
            bits >>= 1
            if bits:
                cur = cur[:-n] * power + cur[n:] if len(cur) > n else cur[:0]
                power, n = power * power, 2 * n
        out = out[: len(buf) - length + 1]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))


def anchors(data: bytes, length: int = LENGTH, seed: int = SEED):
    """name, position, first and last window start of each anchor of a text."""
    found = []
    span = length - seed + 1
    for t in range(0, max(len(data) - length + 1, 0), TILE):
        buf = np.frombuffer(data, np.uint8)[t : t + TILE + length - 1]
        h = names(buf, seed)
        key = (h & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(len(h), dtype=np.uint64))
        n, least = 1, key
        while 2 * n <= span:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        if n < span:
            least = np.minimum(least[: len(h) - span + 1], least[span - n : len(h) - n + 1])
        owner = (np.uint64(0xFFFFFF) - (least & np.uint64(0xFFFFFF))).astype(np.int64)
        cut = np.nonzero(np.diff(owner))[0]
        first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(owner) - 1]])
        found.append((h[owner[first]].view(np.int64), owner[first] + t, first + t, last + t))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4


def ranks(buf, at):
    """The ranks at 40 and at 80 bytes of the strings that begin at some places of a byte array: doubled from ranks of SEED
    bytes, each from the pair at offsets 0 and half its length."""
    powers = np.cumprod(np.full(SEED, BASE, np.uint64))
    view = np.lib.stride_tricks.sliding_window_view(buf, LAST_RANK)
    out = np.empty((2, len(at)), np.uint64)
    for s in range(0, len(at), 50_000):
        cells = view[at[s : s + 50_000]].reshape(-1, LAST_RANK // SEED, SEED).astype(np.uint64) + np.uint64(1)
        rank = scrambled((cells * powers).sum(-1, dtype=np.uint64))
        for k in range(2):
            rank = scrambled(rank[:, 0::2] * np.uint64(0xD6E8FEB86659FD93) + rank[:, 1::2])
            out[k, s : s + 50_000] = rank[:, 0]
    return out.view(np.int64)


def scrambled(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def repeats(ids, subs, starts, pieces, length: int = LENGTH, twice: bool = False):
    """For pieces of texts: their order by place (id, sub, start), and for all their windows in that order the ordinal of
    the piece, the window's start in its text, whether an earlier window of another place holds the same bytes, and a name
    of its bytes; with twice, a second one."""
    order = np.lexsort((starts, subs, ids))
    ids, subs, starts = ids[order], subs[order], starts[order]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))[order]
    buf = np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8)
    begin, wins = np.cumsum(sizes) - sizes, sizes - length + 1
    of = np.repeat(np.arange(len(order)), wins)
    at = np.arange(len(of)) - np.repeat(np.cumsum(wins) - wins, wins)
    where, pos = begin[of] + at, starts[of] + at
    name = names(buf, length)[where]
    other = names(PERMUTED[buf], length)[where] if twice else None
    by = np.argsort(name, kind="stable")
    new = np.concatenate([[True], name[by][1:] != name[by][:-1]]) if len(by) else np.zeros(0, bool)
    first = np.empty(len(by), np.int64)
    first[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    later = np.nonzero(first != np.arange(len(first)))[0]
    head = first[later]
    same = (ids[of[later]] == ids[of[head]]) & (subs[of[later]] == subs[of[head]]) & (pos[later] == pos[head])
    later = later[~same]
    view = np.lib.stride_tricks.sliding_window_view(buf, length) if len(buf) >= length else None
    dup, exact = np.zeros(len(first), bool), True
    for s in range(0, len(later), 20_000):
        part = later[s : s + 20_000]
        exact &= bool((view[where[part]] == view[where[first[part]]]).all())
    if exact:
        dup[later] = True
    else:  # two strings with one name: compare bytes alone
        seen: dict[bytes, tuple] = {}
        for w in range(len(first)):
            p = (int(ids[of[w]]), int(subs[of[w]]), int(pos[w]))
            dup[w] = seen.setdefault(view[where[w]].tobytes(), p) != p
    return order, of, pos, dup, name, other


#: Bytes in another order, for a second, independent name.
PERMUTED = np.argsort([(i * 167 + 89) * (i * 3 + 1) % 1021 for i in range(256)], kind="stable").astype(np.uint8)
#: Pieces, whose windows begin at start and after, or, without piece, removed bytes from start to till.
FOUND = "h long, id long, sub long, lo int, more int, off int, known boolean"
#: Pieces of a text from start, or, without piece, removed bytes from start to till.
PIECE = "h long, id long, sub long, start int, piece binary, till int"


def find_anchors(batches):
    """(id, sub, body) to anchors. Those repeated in a batch are known; each of these leaves one marker row to be counted."""
    import pyarrow as pa

    for whole in batches:
        for s in range(0, whole.num_rows, 2000):
            b = whole.slice(s, 2000)
            ids, subs = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            parts = [anchors(x) for x in b.column(2).to_pylist()]
            n = np.array([len(p[0]) for p in parts])
            if not n.sum():
                continue
            h, at, lo, hi = (np.concatenate([p[i] for p in parts]) for i in range(4))
            who, sub = np.repeat(ids, n), np.repeat(subs, n)
            yield marked(h, {"id": who, "sub": sub, "lo": lo.astype(np.int32), "more": (hi - lo).astype(np.int32), "off": (at - lo).astype(np.int32)})


def marked(h, cols: dict):
    """A batch of rows with h and known: whether h is there OFTEN; each such h leaves a marker, a row with off < 0."""
    import pyarrow as pa

    _, first, back, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    mark = first[times >= OFTEN]
    pick = np.concatenate([np.arange(len(h)), mark])
    cols = {k: v[pick] for k, v in cols.items()}
    cols["off"][len(h) :] = -1
    known = np.concatenate([times[back] >= OFTEN, np.zeros(len(mark), bool)])
    return pa.RecordBatch.from_arrays([pa.array(h[pick]), *map(pa.array, cols.values()), pa.array(known)], ["h", *cols, "known"])


def refine(batches):
    """(id, sub, body, found: list of lo, more, off) to the ranks at 40 and 80 bytes that hold the anchors: of the windows from
    lo to lo + more, those with the anchor up to 19 bytes after a place of its grid share the 80 bytes from there."""
    import pyarrow as pa

    for whole in batches:
        for s in range(0, whole.num_rows, 2000):
            b = whole.slice(s, 2000)
            found = b.column(3)
            n = np.diff(found.offsets.to_numpy())
            cells = found.flatten()
            lo, more, off = (cells.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            if not len(lo):
                continue
            bodies = b.column(2).to_pylist()
            sizes = np.array([len(x) for x in bodies])
            begin = np.repeat(np.cumsum(sizes) - sizes, n)
            ids, subs = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), n) for i in (0, 1))
            p, parts = lo + off, []
            for a in range(0, LAST_RANK, SEED):
                first = np.maximum(lo, p - a - (SEED - 1 if a + SEED < LAST_RANK else LENGTH - LAST_RANK))
                last = np.minimum(lo + more, p - a)
                k = np.nonzero(first <= last)[0]
                parts.append((k, first[k], last[k], (p - a)[k]))
            k, first, last, x = (np.concatenate(c) for c in zip(*parts))
            r40, r80 = ranks(np.frombuffer(b"".join(bodies), np.uint8), begin[k] + x)
            yield marked(r40, {"h2": r80, "id": ids[k], "sub": subs[k], "lo": first.astype(np.int32), "more": (last - first).astype(np.int32), "off": (x - first).astype(np.int32)})


def again(batches):
    """Rows that the first round kept, under their next rank."""
    for b in batches:
        if b.num_rows:
            h2, *rest = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            yield marked(h2, dict(zip(("id", "sub", "lo", "more", "off"), [*rest[:4], np.array(rest[4])])))


def keep_repeated(batches, more: tuple = ()):
    """Rows sorted by h: passes known rows and those whose h a neighbour shares; markers go."""
    import pyarrow as pa

    held = None  # the last row so far that waits for its successor, with whether its predecessor shared its h
    cols = [*more, "id", "sub", "lo", "more", "off"]
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held[0], t])
        h, known = t.column("h").to_numpy(), t.column("known").to_numpy(zero_copy_only=False)
        count = ~known
        idx = np.nonzero(count)[0]
        eq = np.zeros(len(idx), bool)
        if len(idx):
            same = h[idx][1:] == h[idx][:-1]
            eq[1:] |= same
            eq[:-1] |= same
            if held is not None and held[1] is not None and h[idx[0]] == held[1]:
                eq[0] = True
        ok = known.copy()
        ok[idx] = eq
        tail = idx[-1] if len(idx) else None
        emit = ok & (t.column("off").to_numpy() >= 0)
        if tail is not None:
            emit[tail] = False  # it waits
        out = t.filter(pa.array(emit)).select(cols).combine_chunks()
        yield from out.to_batches()
        if tail is not None:
            before = h[idx[-2]] if len(idx) > 1 else (held[1] if held is not None else None)
            held = (t.slice(int(tail), 1), before)
    if held is not None:
        row, before = held
        if before is not None and row.column("h")[0].as_py() == before and row.column("off")[0].as_py() >= 0:
            yield from row.select(cols).to_batches()


def settle(batches, final: bool):
    """Rows of PIECE: a piece with its windows. Windows that an earlier one of the batch equals become removed intervals
    (piece null, start to till); before the shuffle the other windows go on, after it they are done. After the shuffle rows
    come by h and place, and of the windows of an h that goes on in the next batch the names are remembered: two numbers for
    each different window around one string of 80 bytes."""
    import pyarrow as pa

    seen: list = [None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)]  # an h, and its windows' names in order

    def remembered(h, dup, name, other):
        known = np.nonzero(h == seen[0])[0] if seen[0] is not None and len(seen[1]) else np.zeros(0, np.int64)
        if len(known):
            k = np.minimum(np.searchsorted(seen[1], name[known]), len(seen[1]) - 1)
            dup[known[(seen[1][k] == name[known]) & (seen[2][k] == other[known])]] = True
        last = h.max() if len(h) else None
        if last is None:
            return
        new = (h == last) & ~dup
        kept = (seen[1], seen[2]) if last == seen[0] else (np.zeros(0, np.uint64),) * 2
        a, b = np.concatenate([kept[0], name[new]]), np.concatenate([kept[1], other[new]])
        order = np.argsort(a, kind="stable")
        seen[:] = last, a[order], b[order]

    def work(t):
        h, ids, subs, start = (t.column(c).to_numpy() for c in ("h", "id", "sub", "start"))
        pieces = t.column("piece").to_pylist()
        order, of, pos, dup, name, other = repeats(ids, subs, start, pieces, WINDOW, twice=final)
        h, ids, subs, start = h[order], ids[order], subs[order], start[order]
        if final:
            remembered(h[of], dup, name, other)
        # removed: runs of windows that follow each other in one text, over pieces
        w = np.nonzero(dup)[0]
        cut = (pos[w][1:] != pos[w][:-1] + 1) | (ids[of[w]][1:] != ids[of[w]][:-1]) | (subs[of[w]][1:] != subs[of[w]][:-1])
        a, z = w[np.concatenate([[True], cut])[: len(w)]], w[np.concatenate([cut, [True]])[: len(w)]]
        rows = [np.zeros(len(a), np.int64), ids[of[a]], subs[of[a]], pos[a], [None] * len(a), pos[z] + LENGTH]
        if not final:  # what no earlier window of the batch equals goes on, by runs within pieces
            w = np.nonzero(~dup)[0]
            cut = (w[1:] != w[:-1] + 1) | (of[w][1:] != of[w][:-1])
            a, z = w[np.concatenate([[True], cut])[: len(w)]], w[np.concatenate([cut, [True]])[: len(w)]]
            k, s, e = of[a], pos[a] - start[of[a]], pos[z] - start[of[a]] + WINDOW
            kept = [pieces[i][x:y] for i, x, y in zip(order[k].tolist(), s.tolist(), e.tolist())]
            more = [h[k], ids[k], subs[k], pos[a], kept, np.zeros(len(a), np.int64)]
            rows = [x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(rows, more)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c if isinstance(c, list) else c.astype(np.int64), pa.binary()) if k == pa.binary() else pa.array(c.astype(np.int64)).cast(k) for c, k in zip(rows, kinds)], ["h", "id", "sub", "start", "piece", "till"])

    for b in batches:
        if b.num_rows:
            yield work(pa.Table.from_batches([b]))


def cut_pieces(batches):
    """(id, sub, body, found: list of lo, more, off) to pieces, settled within batches."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def pieces():
        for whole in batches:
            size, s = np.cumsum(pc.binary_length(whole.column(2)).to_numpy(zero_copy_only=False)), 0
            while s < whole.num_rows:
                stop = max(s + 1, int(np.searchsorted(size, (size[s - 1] if s else 0) + TOGETHER, side="right")))
                b, s = whole.slice(s, stop - s), stop
                n = pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False)
                found = b.column(3).flatten()
                lo, more, off = (found.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                if not len(lo):
                    continue
                bodies = b.column(2).to_pylist()
                sizes = np.array([len(x) for x in bodies])
                whole_body = b"".join(bodies)
                buf, first = np.frombuffer(whole_body, np.uint8), np.repeat(np.cumsum(sizes) - sizes, n) + lo
                _, h = ranks(buf, first + off)
                digest = np.stack([h, ranks(PERMUTED[buf], first + off)[1]], 1).tobytes()
                parts = [whole_body[x : x + o] + digest[16 * i : 16 * i + 16] + whole_body[x + o + LAST_RANK : x + m + LENGTH] for i, (x, o, m) in enumerate(zip(first.tolist(), off.tolist(), more.tolist()))]
                ids, subs = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), n) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(subs), pa.array(lo.astype(np.int32)), pa.array(parts, pa.binary())], ["h", "id", "sub", "start", "piece"])

    yield from settle(pieces(), final=False)


def remove(batches):
    """(id, sub, body, gone: list of start, till) to the result's columns, and the kept text."""
    import hashlib

    import pyarrow as pa

    for b in batches:
        out = [[], [], [], [], [], []]
        for i, sub, body, gone in zip(*(b.column(k).to_pylist() for k in range(4))):
            n_removed = n_spans = 0
            kept = body
            if gone:
                d = np.zeros(len(body) + 1, np.int32)
                np.add.at(d, [g["start"] for g in gone], 1)
                np.add.at(d, [g["till"] for g in gone], -1)
                off = np.cumsum(d)[:-1] > 0
                n_removed, n_spans = int(off.sum()), int(off[:1].sum() + (off[1:] & ~off[:-1]).sum())
                kept = np.frombuffer(body, np.uint8)[~off].tobytes()
            for c, x in zip(out, (i, sub & 1, len(body), n_removed, n_spans, hashlib.sha256(kept).hexdigest())):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["id", "lost", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


ROW = "id long, sub long, lo int, more int, off int"


def by_text(texts: DataFrame, found: DataFrame) -> DataFrame:
    """id, sub, body and the list of what was found in it."""
    per_text = found.groupBy("id", "sub").agg(F.collect_list(F.struct("lo", "more", "off")).alias("found")).withColumnRenamed("sub", "_sub")
    return texts.join(per_text, "id").where("(sub ^ _sub) = 0").select("id", "sub", "body", "found")


def repeated_ranks(texts: DataFrame) -> DataFrame:
    """ROW: the windows from lo to lo + more whose 80 bytes from lo + off occur again; by anchors, then two rounds of doubling."""
    # known ranks are dealt by their place, the others by their value
    dealt = F.when(F.col("known"), F.xxhash64("id", "lo")).otherwise(F.col("h"))

    def first_round(batches):
        return keep_repeated(batches, ("h2",))

    found = stored(texts.mapInArrow(find_anchors, FOUND).repartition(dealt).sortWithinPartitions("h").mapInArrow(keep_repeated, ROW))
    found = by_text(texts, found).mapInArrow(refine, f"h long, h2 long, {ROW}, known boolean").repartition(dealt).sortWithinPartitions("h").mapInArrow(first_round, f"h2 long, {ROW}")
    return stored(found.mapInArrow(again, FOUND).repartition(dealt).sortWithinPartitions("h").mapInArrow(keep_repeated, ROW))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("long")
    base = docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("id"), doc_id.isNull().cast("long").alias("lost"), body.alias("body"))
    digest = F.sha2("body", 256).alias("digest")
    keys = base.select("id", "lost", digest, F.octet_length("body").cast("long").alias("n_bytes"))
    first = keys.groupBy("digest").agg(F.min(F.struct("id", "lost")).alias("f")).select("digest", F.col("f.id").alias("first"), F.col("f.lost").alias("first_lost"))
    # one exchange of the texts, by id, serves the three passes over them
    # joins are by id alone, as the texts are dealt: sub is compared so that it is no key of theirs
    # sub tells the texts of one doc_id apart, and in its last bit those without one; without repeated ids the rest is 0 and
    # costs the shuffles nothing
    rows, ids = keys.agg(F.count("*"), F.countDistinct("id")).first()
    sub = lambda lost: F.xxhash64("digest").bitwiseAND(F.lit(-2)).bitwiseOR(F.col(lost)) if rows != ids else F.col(lost)
    texts = base.repartition("id").withColumn("digest", F.sha2("body", 256)).withColumn("sub", sub("lost"))
    mine = first.select(F.col("first").alias("id"), sub("first_lost").alias("_sub"))
    texts = texts.join(mine, "id").where("(sub ^ _sub) = 0").select("id", "sub", "body")
    with shuffles_freed(docs.sparkSession):
        found = repeated_ranks(texts)
    pieces = by_text(texts, found).mapInArrow(cut_pieces, PIECE)
    # removed bytes are dealt by their text, what goes on by its rank; one exchange holds both
    dealt = pieces.repartition(F.when(F.col("piece").isNull(), F.xxhash64("id")).otherwise(F.col("h"))).sortWithinPartitions("h", "id", "sub", "start")

    def after(batches):
        import pyarrow.compute as pc

        def waiting():
            for b in batches:
                done = pc.is_null(b.column(4))
                ready.append(b.filter(done))
                yield b.filter(pc.invert(done))

        ready: list = []
        for out in settle(waiting(), final=True):
            while ready:
                yield ready.pop()
            yield out
        while ready:
            yield ready.pop()

    gone = dealt.mapInArrow(after, PIECE).groupBy("id", "sub").agg(F.collect_list(F.struct("start", "till")).alias("gone")).withColumnRenamed("sub", "_sub")
    kept = texts.join(gone, (texts["id"] == gone["id"]) & (texts["sub"].bitwiseXOR(gone["_sub"]) == 0), "left").select(texts["id"], "sub", "body", "gone").mapInArrow(remove, "id long, lost long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    # further copies of a text: all of it goes, or nothing if it is short
    copies = keys.join(first, "digest").where("id <> first or lost <> first_lost")
    long = F.col("n_bytes") >= LENGTH
    copies = copies.select("id", "lost", "n_bytes", F.when(long, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"), long.cast("long").alias("n_spans"), F.when(long, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("digest")).alias("kept_sha256"))
    rows = kept.unionByName(copies)
    return rows.select(F.when(F.col("lost") == 0, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_prefix_doubling(spark, sf_dir: str) -> DataFrame:
    """Repeated byte strings of all documents."""
    return deduplicated(table(spark, sf_dir, "documents"))
