"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text's segmentations are the paths of a lattice of vocabulary pieces. A path's weight is the product of its pieces'
weights, 1 / (rank + OFFSET) by their rank in the vocabulary; characters without a piece pass as their UTF-8 bytes. The
perturbed A* search keeps a queue of regions, disjoint sets of paths, each under the greatest Gumbel perturbed log
probability of any path in it: exact, as backward sums give every region's mass. A region is either what leaves a known path
at some of its steps, or what leaves it at one step by some of the pieces there. The best region yields a path: the step
and the piece by which it leaves are drawn by their masses, its rest from the lattice; the other steps, the other pieces
and what leaves the new path later stay as regions, with draws of their own below the path's value. So paths come in the order of their perturbed values, without repeats: a Gumbel top-k sample. With the k + 1st value as
threshold t, a path of log probability l has the inclusion score 1 - exp(-exp(l - t)), for Horvitz-Thompson sums. All draws
come from a 64-bit hash of the row's key, the path's number and the place in the text: neither batches nor partitions
change them.

The lattice is a chain of units between places that no piece of the vocabulary crosses: before a space that follows
another character, around line ends, and in long runs between characters that follow each other in no piece. Nothing else
cuts it. A unit's part is built once and kept for later texts, as is allowed by KEPT.

Defined cases: null stays null, with no samples; the empty text has one empty segmentation; a text with fewer than k
segmentations yields them all, then with inclusion score 1; paths of equal weight are as likely as each other, and equal
perturbed values (which 53-bit draws all but exclude) keep the order in which the search made them; rows with equal keys and
texts draw the same; an empty table gives an empty table; a very long text is taken alone, its lattice in memory. The
character U+2581 decodes as a space, as in the library. Extra columns are ignored by sampled().
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import defaultdict
from itertools import count, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import MIX

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED, OFFSET = 2, 11, 10.0
#: Texts are taken together up to so many characters, which bounds a batch in memory; a longer text goes alone.
TOGETHER = 400_000
#: Units' lattices are kept for the task's later texts while they have so many nodes; then the later half is forgotten.
KEPT = 400_000
#: Sums over units of up to so many characters stay in the range of doubles; longer ones are summed by logarithms.
LINEAR = 30
MASK = (1 << 20) - 1
BYTES = 1 << 20  # ids from here on stand for a character that passes as several bytes
SPACE = "▁"
WHOLE = (1 << 64) - 1


def mix(x):
    """splitmix64's finisher, on arrays."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def draw(seed: int, *parts: int) -> float:
    """A uniform draw in (0, 1) for a seed and some small numbers."""
    x = seed
    for p in (*parts, 0):
        x = (x + (p + 1) * 0x9E3779B97F4A7C15) & WHOLE
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WHOLE
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WHOLE
        x ^= x >> 31
    return ((x >> 11) + 0.5) * 2.0**-53


def log(x: float) -> float:
    """The logarithm; of what has become too small for a double, that of the least one."""
    return math.log(max(x, 5e-324))


class Vocabulary:
    """The pieces and the index over them, as plain arrays that can be broadcast."""

    def __init__(self, path: str = VOCABULARY):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        own = [(p, i) for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.longest = max(len(p) for p, _ in own)
        self.id = dict(own)
        #: neighbours inside of pieces: between others no piece reaches across
        self.joined = {x for p, _ in own for x in zip(p, p[1:])}
        self.chained = all(a == SPACE or b != SPACE for a, b in self.joined)
        self.lines = not any("\n" in x for x in self.joined)
        chains = [self.keys_of(p) for p, _ in own]
        keys = np.array([c[-1] for c in chains], np.uint64)
        order = np.lexsort((keys, keys & np.uint64(MASK)))
        self.keys, self.ids = keys[order], np.array([i for _, i in own], np.int32)[order]
        assert len(np.unique(self.keys)) == len(self.keys)
        # a table over the low bits of keys: the first key with them, and by how many more it is followed
        low = (self.keys & np.uint64(MASK)).astype(np.int64)
        self.slot = np.full(MASK + 1, -1, np.int32)
        self.slot[low[::-1]] = np.arange(len(low), dtype=np.int32)[::-1]
        self.deepest = int(np.bincount(low).max())
        self.begins = np.zeros(MASK + 1, bool)  # what may begin a piece
        self.begins[np.array([k for c in chains for k in c[:-1]], np.uint64) & np.uint64(MASK)] = True
        self.logp = -np.log(np.arange(len(self.pieces)) + OFFSET)
        #: texts of the pieces; bytes above ASCII are decoded together with their neighbours
        self.shown = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        bodies = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(p.replace(SPACE, " ") for p in self.pieces)]
        self.body, self.body_size = np.frombuffer(b"".join(bodies), np.uint8), np.fromiter(map(len, bodies), np.int64, len(bodies))
        self.body_at = np.cumsum(self.body_size) - self.body_size
        self.wide = np.array([self.byte_of.get(i, 0) > 127 for i in range(len(self.pieces))])

    @staticmethod
    def keys_of(piece: str) -> list[int]:
        """The keys of a piece's prefixes, its own last."""
        h, out = 1, []
        for c in piece:
            h = ((h ^ ord(c)) * int(MIX)) & WHOLE
            h ^= h >> 29
            out.append(h)
        return out

    def found(self, keys):
        """The ids of the pieces with these keys, -1 for none."""
        import numpy as np

        at = self.slot[keys & np.uint64(MASK)]
        out = np.full(len(keys), -1, np.int32)
        live = np.nonzero(at >= 0)[0]
        k = at[live]
        for _ in range(self.deepest):
            hit = self.keys[k] == keys[live]
            out[live[hit]] = self.ids[k[hit]]
            live, k = live[~hit], k[~hit] + 1
            on = k < len(self.keys)
            live, k = live[on], k[on]
            if not len(live):
                break
        return out

    def spelled(self, character: int) -> list[int]:
        return [self.byte[b] for b in chr(character).encode("utf-8", "replace")]

    def decode(self, ids) -> str:
        """The text of some pieces; runs of byte pieces are read as UTF-8."""
        import numpy as np

        ids = np.asarray(ids, np.int64)
        shown = list(map(self.shown.__getitem__, ids.tolist()))
        at = np.nonzero(self.wide[ids])[0] if len(ids) else ids
        if len(at):
            new = np.concatenate([[True], np.diff(at) > 1])
            for a, z in zip(at[new].tolist(), (at[np.concatenate([new[1:], [True]])] + 1).tolist()):
                shown[a:z] = [bytes(self.byte_of[i] for i in ids[a:z].tolist()).decode("utf-8", "replace")] + [""] * (z - a - 1)
        return "".join(shown)[1:]

    def round_trips(self, ids, lengths, texts: list[str]) -> list[bool]:
        """For runs of ids of some lengths one after another: whether each decodes to its text. Bytes are compared, all at once."""
        import numpy as np

        want = [(" " + (t.replace(SPACE, " ") if SPACE in t else t)).encode("utf-8", "surrogatepass") if n else t.encode() for t, n in zip(texts, lengths.tolist())]
        size = self.body_size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.body_at[ids] - (ends - size), size)
        at += np.arange(len(at))
        got = self.body[at]
        if got.tobytes() == b"".join(want):
            stop = np.concatenate([[0], ends])[np.cumsum(lengths)]
            if np.array_equal(np.diff(stop, prepend=0), np.fromiter(map(len, want), np.int64, len(want))):
                return [True] * len(want)
        stop = np.concatenate([[0], ends])[np.cumsum(lengths)]
        return [got[z - n : z].tobytes() == w for z, n, w in zip(stop.tolist(), np.diff(stop, prepend=0).tolist(), want)]

    def units(self, text: str) -> list:
        """A text's units: strings that stand for themselves after a space, and one-tuples of what stands alone."""
        if not self.chained:
            return [text.replace(" ", SPACE)]
        if self.lines and "\n" in text:
            first, *more = text.split("\n")
            out = self.words(first)
            for line in more:
                out.append(("\n",))
                if line:
                    head, *rest = self.words(line)
                    out += self.parts((head,)) if len(head) > LINEAR else [(head,)]
                    out += rest
        else:
            out = self.words(text)
        if len(text) > LINEAR and max(map(len, out)) > LINEAR:
            out = [part for u in out for part in (self.parts(u) if len(u) > LINEAR else (u,))]
        return out

    @staticmethod
    def words(line: str) -> list:
        """The words of a line, each after one space; further spaces before a word are part of it, as U+2581."""
        if "  " not in line and line[:1] != " ":
            return line.split(" ")
        out, spaces = [], 0
        for w in line.split(" "):
            spaces += 1
            if w:
                out.append(SPACE * (spaces - 1) + w)
                spaces = 0
        if spaces:
            out.append(SPACE * (spaces - 1))
        return out

    def parts(self, unit) -> list:
        """A long unit, cut where no piece reaches across."""
        alone = isinstance(unit, tuple)
        text = unit[0] if alone else SPACE + unit
        cuts = [i for i, x in enumerate(zip(text, text[1:]), 1) if x not in self.joined]
        if not cuts:
            return [unit]
        out = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        return [(out[0],) if alone else out[0][1:], *[(p,) for p in out[1:]]]


class Lattice:
    """The pieces of units, as edges sorted by node and falling length; grows by the units it meets.

    p is an edge's probability given its node, logp its logarithm; aside is the logarithm of that of its node's other edges.
    """

    def __init__(self, v: Vocabulary):
        import numpy as np

        self.v, self.number, self.nodes, self.edges, self.stay = v, defaultdict(count().__next__), 0, 0, None
        room, more = KEPT, KEPT * 5 // 2
        self.start = np.empty(room, np.int64)
        self.first, self.last, self.ends = np.empty(room, np.int32), np.empty(room, np.int32), np.empty(room, bool)
        self.id, self.to, self.p, self.logp, self.aside = np.empty(more, np.int32), np.empty(more, np.int32), np.empty(more), np.empty(more), np.empty(more)

    def meet(self, texts: list):
        """For texts given by their units: the numbers of all units in order, and each text's end among them."""
        import numpy as np

        known, at = len(self.number), self.number.__getitem__
        ids: list[int] = []
        ends = np.empty(len(texts), np.int64)
        for k, units in enumerate(texts):
            ids.extend(map(at, units))
            ends[k] = len(ids)
        new = list(islice(reversed(self.number), len(self.number) - known))[::-1]
        if new:
            self.add([SPACE + u if isinstance(u, str) else u[0] for u in new])
        return np.array(ids, np.int64), ends

    def put(self, name: str, at: int, values) -> None:
        import numpy as np

        a = getattr(self, name)
        if at + len(values) > len(a):
            a = np.concatenate([a[:at], np.empty(max(len(values), at // 2 + 1024), a.dtype)])
            setattr(self, name, a)
        a[at : at + len(values)] = values

    def add(self, texts: list[str]) -> None:
        import numpy as np

        v = self.v
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size + 1) - size - 1
        cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        nodes = len(cp)
        wide = cp.astype(np.uint64)
        left = (np.repeat(begin + size, size + 1) - np.arange(nodes)).astype(np.int32)
        found, single = [], np.zeros(nodes, bool)
        live = np.nonzero(left)[0].astype(np.int32)  # nodes where a longer piece may still begin
        h = np.ones(len(live), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, v.longest + 1):
                if not len(live):
                    break
                h = (h ^ wide[live + (n - 1)]) * MIX
                h ^= h >> np.uint64(29)
                ids = v.found(h)
                hit = ids >= 0
                at = live[hit]
                if n == 1:
                    single[at] = True
                found.append((at, ids[hit], n))
                on = v.begins[h & np.uint64(MASK)] & (left[live] > n)
                live, h = live[on], h[on]
        alone = np.nonzero(~single & (left >= 1))[0].astype(np.int32)
        own = cp[alone].astype(np.int32)
        ascii_ids = np.array([v.byte[b] for b in range(128)], np.int32)
        found.append((alone, np.where(own < 128, ascii_ids[np.minimum(own, 127)], BYTES + own), 1))
        degree = np.zeros(nodes, np.int32)
        for at, _, _ in found:
            degree[at] += 1
        first = (np.cumsum(degree) - degree).astype(np.int32)
        edges = int(degree.sum())
        id_, to, node = (np.empty(edges, np.int32) for _ in range(3))
        fill = first.copy()
        for at, ids, n in reversed(found):
            e = fill[at]
            id_[e], to[e], node[e] = ids, at + n, at
            fill[at] += 1
        logw = v.logp[np.minimum(id_, len(v.logp) - 1)]
        for e in np.nonzero(id_ >= BYTES)[0]:
            logw[e] = sum(v.logp[x] for x in v.spelled(int(id_[e]) - BYTES))
        p = np.empty(edges)
        long = np.repeat(size > LINEAR, size + 1)[node] if edges else np.zeros(0, bool)
        for slow in (False, True):
            e = np.nonzero(long == slow)[0]
            if len(e):
                p[e] = self.shares(node[e], to[e], logw[e], left, slow)
        self.put("start", len(self.number) - len(texts), begin + self.nodes)
        self.put("first", self.nodes, first + self.edges)
        self.put("last", self.nodes, first + self.edges + degree - 1)
        self.put("ends", self.nodes, left == 0)
        several = degree[node] > 1
        aside = 1 - p
        most = np.nonzero(several & (aside < 1e-6))[0]  # too little for a difference: the sum itself, of one such edge a node
        if len(most):
            others = p.copy()
            others[most] = 0.0
            full = np.nonzero(degree)[0]
            sums = np.empty(nodes)
            sums[full] = np.add.reduceat(others, first[full])
            aside[most] = np.maximum(sums[node[most]], 5e-324)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.log(p), np.where(several, np.log(aside), -np.inf)
        for name, values in (("id", id_), ("to", to + self.nodes), ("p", p), ("logp", logs[0]), ("aside", logs[1])):
            self.put(name, self.edges, values)
        self.nodes += nodes
        self.edges += edges
        if self.stay is None and self.nodes > KEPT // 2:
            self.stay = len(self.number), self.nodes, self.edges

    def shrink(self) -> None:
        """Forgets the units met last, if there are too many; those met first, the common ones among them, stay."""
        if self.nodes > KEPT:
            units, self.nodes, self.edges = self.stay
            if self.nodes > KEPT:  # one batch alone had as many
                units, self.nodes, self.edges, self.stay = 0, 0, 0, None
            while len(self.number) > units:
                self.number.popitem()
            self.number.default_factory = count(units).__next__

    @staticmethod
    def shares(node, to, logw, left, logs: bool):
        """Edges' probabilities given their nodes, from the sums over all paths to the units' ends, by characters left."""
        import numpy as np

        w = logw if logs else np.exp(logw)
        mass = np.zeros(len(left)) if logs else np.ones(len(left))
        level = left[node] if logs else left[node].astype(np.uint8)  # few levels are sorted by radix
        order = np.argsort(level, kind="stable")
        stop = np.concatenate([[0], np.nonzero(np.diff(level[order]))[0] + 1, [len(order)]])
        for lo, hi in zip(stop[:-1], stop[1:]):
            e = order[lo:hi]
            of = node[e]
            head = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0]
            if logs:
                x = w[e] + mass[to[e]]
                top = np.maximum.reduceat(x, head)
                size = np.diff(np.concatenate([head, [len(x)]]))
                mass[of[head]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, size)), head))
            else:
                mass[of[head]] = np.add.reduceat(w[e] * mass[to[e]], head)
        return np.exp(w + mass[to] - mass[node]) if logs else w * mass[to] / mass[node]

    def pick(self, node, u):
        """An edge for each node, drawn in proportion."""
        import numpy as np

        e, last = self.first[node], self.last[node]
        acc = self.p[e]
        more = np.nonzero((u >= acc) & (e < last))[0]
        while len(more):
            e[more] += 1
            acc[more] += self.p[e[more]]
            more = more[(u[more] >= acc[more]) & (e[more] < last[more])]
        return e

    def walk(self, node, key):
        """Draws every unit's path from its node to its end: the edges, ordered by unit, and their number in each."""
        import numpy as np

        at, live, parts = node.copy(), np.nonzero(~self.ends[node])[0], []
        counts = np.zeros(len(node), np.int64)
        step = np.uint64(0xA24BAED4963EE407)
        while len(live):
            with np.errstate(over="ignore"):
                mixed = mix(key[live] + np.uint64(len(parts) + 1) * step)
            e = self.pick(at[live], ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            parts.append((live, e))
            counts[live] += 1
            on = self.to[e]
            at[live] = on
            live = live[~self.ends[on]]
        begin = np.cumsum(counts) - counts
        edge = np.empty(counts.sum(), np.int32)
        for n, (w, e) in enumerate(parts):
            edge[begin[w] + n] = e
        return edge, counts


class Path:
    """edges; per_unit: the number of edges in each unit; logp; leave: log masses of the paths that first leave at a step."""

    def __init__(self, lat: Lattice, edges, per_unit, logp: float):
        self.lat, self.edges, self.per_unit, self.logp, self._leave = lat, edges, per_unit, logp, None

    @property
    def leave(self):
        if self._leave is None:
            import numpy as np

            steps = self.lat.logp[self.edges]
            self._leave = np.cumsum(steps) - steps + self.lat.aside[self.edges]
        return self._leave

    def beside(self, i: int, gone) -> tuple[list[int], list[float]]:
        """The edges of step i's node that are not gone, and their probabilities."""
        lat, edge = self.lat, int(self.edges[i])
        node = int(lat.to[edge]) - 1
        while not lat.first[node] <= edge <= lat.last[node]:
            node -= 1
        rest = [e for e in range(int(lat.first[node]), int(lat.last[node]) + 1) if e not in gone]
        return rest, lat.p[rest].tolist()


class Search:
    """The queue of one text's regions. A region: value, tie breaker, kind, path, step, what is gone (steps or edges)."""

    def __init__(self, seed: int):
        self.seed, self.made, self.queue = seed, count(1), []

    def put(self, mass: float, bound: float | None, kind: str, path, step: int, gone=frozenset()) -> None:
        """Adds a region of that log mass with a Gumbel draw, not above the bound."""
        n = next(self.made)
        e = math.log(-math.log(draw(self.seed, n)))
        if bound is None:
            value = mass - e
        else:
            d = mass - bound
            value = mass - max(d, e) - math.log1p(math.exp(-abs(d - e)))
        heapq.heappush(self.queue, (-value, n, kind, path, step, gone))

    def put_beside(self, path: Path, step: int, gone, bound: float) -> None:
        """The paths that leave a path at a step from there on that is not gone."""
        x = self.left(path, step, gone)
        top = float(x.max()) if len(x) else -math.inf
        if top > -math.inf:
            import numpy as np

            self.put(top + math.log(float(np.exp(x - top).sum())), bound, "beside", path, step, gone)

    @staticmethod
    def left(path: Path, step: int, gone):
        x = path.leave[step:]
        if gone:
            x = x.copy()
            x[[i - step for i in gone]] = -math.inf
        return x

    def pop(self):
        """The best path's value, and the region it is drawn from as (path, step, edge), None for the whole lattice; None if
        no path is left."""
        import numpy as np

        if not self.queue:
            return None
        value, n, kind, path, step, gone = heapq.heappop(self.queue)
        value = -value
        if kind == "whole":
            return value, None
        if kind == "beside":
            x = self.left(path, step, gone)
            sums = np.cumsum(np.exp(x - x.max()))
            i = step + int(np.searchsorted(sums, draw(self.seed, n, 1) * sums[-1], side="right"))
            self.put_beside(path, step, gone | {i}, value)
            step, gone = i, frozenset([int(path.edges[i])])
        rest, p = path.beside(step, gone)
        u, k = draw(self.seed, n, 2) * sum(p), 0
        while k + 1 < len(rest) and u >= p[k]:
            u -= p[k]
            k += 1
        if len(rest) > 1:
            mass = float(path.leave[step]) - float(path.lat.aside[path.edges[step]]) + log(sum(p[:k]) + sum(p[k + 1 :]))
            self.put(mass, value, "node", path, step, gone | {rest[k]})
        return value, (path, step, rest[k])


def sample(texts: list[str], seeds, lat: Lattice, k: int = SAMPLES):
    """For each text up to k tuples (ids, log probability, perturbed value, inclusion score), in falling perturbed value."""
    import numpy as np

    v = lat.v
    ids, ends = lat.meet([v.units(t) if t else [] for t in texts])
    begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    with np.errstate(over="ignore"):
        place = np.arange(len(ids), dtype=np.uint64) - np.repeat(begin, ends - begin).astype(np.uint64)
        key = mix(np.repeat(np.asarray(seeds, np.uint64), ends - begin) + place * np.uint64(0x9FB21C651E98DF25))
    starts = lat.start[ids]
    searches: list = [Search(int(s)) if t else None for t, s in zip(texts, seeds)]
    for s in searches:
        if s:
            s.put(0.0, None, "whole", None, 0)
    found: list[list] = [[] for _ in texts]
    threshold: list = [None] * len(texts)
    live = [d for d, s in enumerate(searches) if s]
    for turn in range(k + 1):
        best = [(d, x) for d in live if (x := searches[d].pop())]
        if turn == k:  # the next value only
            for d, (value, _) in best:
                threshold[d] = value
            break
        if not best:
            break
        jobs = []  # text, value, cut, its unit, edges of the unit before it
        for d, (value, cut) in best:
            unit = 0 if cut is None else int(np.searchsorted(np.cumsum(cut[0].per_unit), cut[1], side="right"))
            jobs.append((d, value, cut, unit))
        where = [np.arange(begin[d] + unit, ends[d]) for d, _, _, unit in jobs]
        flat = np.concatenate(where)
        nodes = starts[flat]
        n_units = np.fromiter(map(len, where), np.int64, len(where))
        head = np.cumsum(n_units) - n_units
        for (_, _, cut, _), at in zip(jobs, head):
            if cut:
                nodes[at] = lat.to[cut[2]]
        with np.errstate(over="ignore"):
            edge, counts = lat.walk(nodes, key[flat] + np.uint64(turn) * np.uint64(0x632BE59BD9B4E019))
        per = np.add.reduceat(counts, head)
        stop = np.cumsum(per)
        logs = lat.logp[edge]
        for (d, value, cut, unit), a, z, h, n in zip(jobs, (stop - per).tolist(), stop.tolist(), head.tolist(), n_units.tolist()):
            own, per_unit, logp, step = edge[a:z], counts[h : h + n], float(logs[a:z].sum()), 0
            if cut:
                path, step, chosen = cut
                own = np.concatenate([path.edges[:step], np.array([chosen], np.int32), own])
                per_unit = np.concatenate([path.per_unit[:unit], per_unit])
                per_unit[unit] += step + 1 - int(path.per_unit[:unit].sum())
                logp, step = float(lat.logp[own].sum()), step + 1
            path = Path(lat, own, per_unit, logp)
            found[d].append((path, value))
            searches[d].put_beside(path, step, frozenset(), value)
        live = [d for d, _ in best]
    out = []
    for d, paths in enumerate(found):
        if not texts[d]:
            out.append([(np.zeros(0, np.int32), 0.0, 0.0, 1.0)])
            continue
        t, rows = threshold[d], []
        for path, value in paths:
            piece = lat.id[path.edges]
            if len(piece) and piece.max() >= BYTES:
                piece = np.array([x for i in piece.tolist() for x in ([i] if i < BYTES else v.spelled(i - BYTES))], np.int32)
            rows.append((piece, path.logp, value, 1.0 if t is None else -math.expm1(-math.exp(min(path.logp - t, 50.0)))))
        out.append(rows)
    return out


def seed_of(key: int | None) -> int:
    """64 bits from a row's key."""
    import xxhash

    return xxhash.xxh64_intdigest(str(key), SEED)


SCHEMA = "doc_id long, sample int, n_pieces int, logp double, perturbed double, inclusion double, ids array<int>, decoded boolean"


def sampled(docs: DataFrame, k: int = SAMPLES, vocabulary: str = VOCABULARY) -> DataFrame:
    """SCHEMA: k distinct segmentations of every text; decoded tells whether its pieces decode to the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Vocabulary(vocabulary)))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lat = Lattice(pickle.loads(shared.value))
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(whole.column(1)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < whole.num_rows:
                before = size[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(size, before + TOGETHER, side="right")))
                b, start = whole.slice(start, stop - start), stop
                keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                have = [i for i, t in enumerate(texts) if t is not None]
                lat.shrink()
                rows = [(keys[i], m, texts[i], *one) for i, some in zip(have, sample([texts[i] for i in have], [seed_of(keys[i]) for i in have], lat, k)) for m, one in enumerate(some)]
                lengths = np.array([len(r[3]) for r in rows], np.int32)
                ids = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int32)
                good = lat.v.round_trips(ids, lengths, [r[2] for r in rows])
                cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(lengths)]
                cols += [pa.array([r[c] for r in rows], pa.float64()) for c in (4, 5, 6)]
                cols += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids)), pa.array(good, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sample", "n_pieces", "logp", "perturbed", "inclusion", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op3_gumbel_topk(spark, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, the ids as a 64-bit digest."""
    return sampled(table(spark, sf_dir, "documents")).withColumn("ids_xxh64", F.xxhash64("ids")).drop("ids")
