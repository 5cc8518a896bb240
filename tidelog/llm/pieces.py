"""Operator 1: SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text's segmentations are the paths of its piece lattice. Their log-probabilities come from the
vocabulary: a piece of rank r weighs -temperature * log(r + 1), a character without a piece becomes
byte pieces. Backward sums turn the lattice into choices of the next piece with exact probabilities,
so a path's probability is a product.

Sampling is an A* search for the paths with the highest Gumbel-perturbed log-probability. The root's
perturbed maximum is one Gumbel; a path keeps it, and all siblings of a step together get one Gumbel
cut off at that maximum. The best of those open sets is where the next path turns aside. The
k paths that come out are distinct and the k first of the perturbed order: a sample without replacement.
The best open set left is the threshold kappa; a path's inclusion score is 1 - exp(-exp(logp - kappa)).

All random numbers are functions of (seed, row key, sample, place), so results do not depend on
partitions, batches or retries.

Defined cases: a null text is an empty one; an empty text has one segmentation without pieces and
inclusion 1; a text with fewer segmentations than k gives all of them with inclusion 1; a null key
counts as key 0; U+2581 is the same as a space, as in the vocabulary. Texts with the same key
and content get the same samples.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.shared import GOLDEN, U64, mix64, slices, small_batches

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NEG = -np.inf


class Vocabulary:
    """Pieces of a model file with their weights; nothing is trained."""

    def __init__(self, model: str, temperature: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.byte = np.zeros(256, np.int32)
        self.text: list[bytes] = [b""] * n
        self.score: dict[str, tuple[int, float]] = {}
        rank = 0
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                rank += 1
                self.score[piece] = i, -temperature * math.log(rank + 1)
                self.text[i] = piece.replace(SPACE, " ").encode()
        self.byte_score = -temperature * math.log(rank + 2)
        self.longest = max(map(len, self.score))
        # as many arcs can meet in a node as a piece has characters; lattices count them in 6 bits
        assert self.longest <= 63, "a piece is longer than 63 characters"
        self.tables()
        # A unit is what no piece crosses: a run of spaces with what follows it up to the next one.
        assert not any(SPACE in p.lstrip(SPACE) for p in self.score), "a piece holds a space inside"

    def tables(self) -> None:
        """Hashes of pieces and of all their beginnings, sorted, to match places of many units at once."""
        ends = {hash_text(p): (i, w) for p, (i, w) in self.score.items()}
        starts = {hash_text(p[:n]) for p in self.score for n in range(1, len(p) + 1)}
        assert len(ends) == len(self.score), "two pieces have one hash"
        self.starts = np.array(sorted(starts), U64)
        self.start_piece = np.array([ends.get(int(h), (-1, 0.0))[0] for h in self.starts], np.int64)
        self.start_weight = np.array([ends.get(int(h), (-1, 0.0))[1] for h in self.starts], float)
        self.width = np.array([len(t) for t in self.text])
        self.offset = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)
        slot = (self.starts * GOLDEN >> U64(43)).astype(np.int64)
        self.slots = np.full(1 << 21, -1, np.int32)  # -1: none; -2: more than one, to be searched
        self.slots[slot] = np.arange(len(slot))
        names, n = np.unique(slot, return_counts=True)
        self.slots[names[n > 1]] = -2

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where hashes are in ``starts``; -1 for those that are not."""
        i = self.slots[(h * GOLDEN >> U64(43)).astype(np.int64)]
        more = np.flatnonzero(i == -2)
        if len(more):
            i[more] = np.minimum(np.searchsorted(self.starts, h[more]), len(self.starts) - 1)
        i[self.starts[i] != h] = -1
        return i


BASE = 0x9E3779B97F4A7C15 | 1


def hash_text(text: str) -> int:
    h = 0
    for c in text:
        h = (h * BASE + ord(c) + 1) & (2**64 - 1)
    return h


@lru_cache(maxsize=2)
def vocabulary(model: str, temperature: float) -> Vocabulary:
    return Vocabulary(model, temperature)


def normalise(text: str) -> str:
    """The vocabulary's form: a space in front, spaces marked; nothing of nothing."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def units(text: str) -> list[str]:
    """Cuts before each run of spaces that follows something else."""
    if not text:
        return []
    return UNIT.findall(text)


#: A unit is a run of spaces with what follows it.
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")


class Lattices:
    """Choices in a set of units: node -> arcs (piece, next node, log-probability), flat, likeliest first.

    A node is a place in a unit; node -1 is a unit's end. Matching, backward sums and the order of arcs are
    made for all units together; each unit's numbers depend on it alone.
    """

    ARCS = {"to": np.int32, "piece": np.int32, "logp": np.float64, "rest": np.float32, "cum": np.float32}
    NODES = {"pair": np.int64, "length": np.int32}  # pair: first arc, and the number of arcs after it in the lowest 6 bits

    def __init__(self) -> None:
        self.first: dict[str, int] = {}
        self.nodes = self.arcs = 0
        for kind, t in {**self.ARCS, **self.NODES}.items():
            setattr(self, kind, np.zeros(0, t))

    def room(self, kinds: dict, n: int) -> None:
        for kind, t in kinds.items():
            old = getattr(self, kind)
            if len(old) < n:
                new = np.zeros(n + n // 4, t)
                new[: len(old)] = old
                setattr(self, kind, new)

    def of(self, vocab: Vocabulary, texts: list[list[str]], keep: int) -> np.ndarray:
        """First nodes of the units of texts, made where they aren't known; new ones are kept while there are under ``keep`` arcs."""
        flat = list(chain.from_iterable(texts))
        out = np.fromiter(map(self.first.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(out < 0)
        absent = [flat[i] for i in missing.tolist()]
        fresh: dict[str, int] = dict.fromkeys(absent)
        names = list(fresh)
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        begin = np.cumsum(lengths) - lengths + self.nodes
        arcs, nodes = self.make(vocab, names, lengths)
        self.length[begin] = lengths
        fresh = dict(zip(names, begin.tolist(), strict=True))
        out[missing] = np.fromiter(map(fresh.__getitem__, absent), np.int64, len(absent))
        if self.arcs < keep:
            self.first.update(fresh)
            self.arcs, self.nodes = arcs, nodes
        return out

    def make(self, vocab: Vocabulary, names: list[str], lengths: np.ndarray) -> tuple[int, int]:
        """Writes the units behind those that are kept; the numbers of arcs and nodes with them."""
        chars = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int32)
        ends = np.cumsum(lengths)
        end = np.repeat(ends, lengths).astype(np.int32)
        src, to, piece, weight = self.match(vocab, chars, end)
        best = np.zeros(len(chars) + 1)
        last = to == end[src]
        goal = np.where(last, len(chars), to)
        left = end[src] - src
        by = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        value = np.zeros(len(src))
        ordered = left[by]
        edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True]) if len(src) else np.zeros(1, np.int64)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):  # places by distance from their unit's end
            i = by[lo:hi]
            v, from_ = weight[i] + best[goal[i]], src[i]
            at = np.flatnonzero(np.r_[True, from_[1:] != from_[:-1]])
            top = np.maximum.reduceat(v, at)
            n = np.diff(np.r_[at, hi - lo])
            whole = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, n)), at))
            best[from_[at]] = whole
            value[i] = v - np.repeat(whole, n)
        count = np.bincount(src, minlength=len(chars))
        run = np.cumsum(count)
        start = run - count
        p = np.exp(value)
        rest, cum = np.full(len(src), NEG), p.copy()
        if len(src):
            place = (np.arange(len(src), dtype=np.int32) - start[src].astype(np.int32)).astype(np.int8)
            for k in range(1, int(count.max())):  # within a node, a place at a time, so that sums don't depend on other nodes
                i = np.flatnonzero(place == k)
                cum[i] += cum[i - 1]
            cum[run - 1] = 2.0  # the last arc takes all that is left
            many = np.flatnonzero(count[src] > 1)
            likely = p > 0.5  # what the others share, without cancellation
            low = np.add.reduceat(np.where(likely, 0.0, p), start)[src[many]]
            with np.errstate(divide="ignore"):
                rest[many] = np.log(np.where(likely[many], low, np.maximum(1.0 - p[many], 0.0)))
        a, n = self.arcs + len(src), self.nodes + len(chars)
        self.room(self.ARCS, a)
        self.room(self.NODES, n)
        here, nodes = slice(self.arcs, a), slice(self.nodes, n)
        self.to[here], self.piece[here], self.logp[here], self.rest[here], self.cum[here] = np.where(last, -1, to + self.nodes), piece, value, rest, cum
        self.pair[nodes] = (start + self.arcs) << 6 | (count - 1)
        return a, n

    @staticmethod
    def match(vocab: Vocabulary, chars: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Arcs (source, target, piece, weight) of every piece at every place; characters without a piece become bytes."""
        at = np.arange(len(chars), dtype=np.int32)
        h = np.zeros(len(chars), U64)
        found = []
        base = U64(BASE)
        bare = np.zeros(len(chars), bool)
        for n in range(1, vocab.longest + 1):
            ok = at + n <= end[at]
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = h * base + chars[at + n - 1].astype(U64) + U64(1)
            i = vocab.find(h)
            known = i >= 0
            piece = np.where(known, vocab.start_piece[i], -1)
            hit = piece >= 0
            if n == 1:
                bare[at[~hit]] = True
            found.append((at[hit], at[hit] + n, piece[hit], vocab.start_weight[i[hit]]))
            at, h = at[known], h[known]
        lone = np.flatnonzero(bare)
        c = chars[lone]
        size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        found.append((lone, lone + 1, -c - 1, size * vocab.byte_score))
        src, *rest = (np.concatenate(x) for x in zip(*found[::-1], strict=True))
        order = np.argsort(src, kind="stable")  # by place, the longest piece first
        return src[order], *(x[order] for x in rest)


def uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """In (0, 1), a function of its arguments."""
    return ((mix64(key + (place.astype(U64) + U64(1)) * GOLDEN) >> U64(11)).astype(float) + 0.5) / float(1 << 53)


def walk(lat: Lattices, node: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples each unit from its node to its end: (unit, arc) of every step, units in order.

    All units take a step at a time together, so the steps are as many as the longest unit has pieces.
    """
    alive, at, step = np.arange(len(node)), node, 0
    out_unit, out_arc = [], []
    while len(alive):
        both = lat.pair[at]
        arc = both >> 6
        open_ = np.flatnonzero(both & 63)
        u = uniform(key[alive[open_]], place[alive[open_]] + step) if len(open_) else None
        while len(open_):
            more = u > lat.cum[arc[open_]]
            open_, u = open_[more], u[more]
            arc[open_] += 1
        out_unit.append(alive)
        out_arc.append(arc)
        at = lat.to[arc]
        go = at >= 0
        alive, at, step = alive[go], at[go], step + 1
    steps = np.zeros(len(node), np.int32)
    for alive in out_unit:
        steps[alive] += 1
    begin = np.cumsum(steps) - steps
    arcs = np.empty(int(steps.sum()), np.int64)
    for i, (alive, arc) in enumerate(zip(out_unit, out_arc, strict=True)):
        arcs[begin[alive] + i] = arc
    return np.repeat(np.arange(len(node)), steps), arcs


def truncated(phi: np.ndarray, top: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """A Gumbel of location phi given that it is at most ``top``."""
    with np.errstate(all="ignore"):
        return np.where(phi == NEG, NEG, phi - np.logaddexp(phi - top, np.log(-np.log(u))))


class Path:
    """A sampled path: its arcs, and the open sets that branch off it from ``turn`` on."""

    __slots__ = ("arcs", "logp", "score", "open", "phi", "unit", "shut", "turn", "before")


class Sampler:
    """Perturbed A* over the texts of a batch: paths are walked for all texts at once, agendas are per text."""

    def __init__(self, vocab: Vocabulary, texts: list[str], keys: list[int], k: int, seed: int, lat: Lattices | None = None) -> None:
        """``lat``: lattices of units that earlier batches have made; which they are doesn't change results."""
        self.vocab, self.k, self.lat = vocab, k, lat or Lattices()
        parts = [units(normalise(t)) for t in texts]
        self.node = self.lat.of(vocab, parts, KNOWN_ARCS)
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.key = mix64(np.array([x & (2**64 - 1) for x in keys], U64) ^ mix64(np.full(len(keys), seed, U64)))
        self.roots = -np.log(-np.log(uniform(self.key, np.full(len(keys), -2))))
        length = self.lat.length[self.node]
        done = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(texts)), self.counts)
        self.place = done - done[self.begin[owner]] if len(owner) else done
        self.owner, self.local = owner, np.arange(len(owner)) - self.begin[owner]

    def run(self) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text its samples: (arcs, logp, perturbed score, inclusion), best first."""
        paths: list[list[Path]] = [[] for _ in self.counts]
        turns: list[tuple] = [(d, None) for d in range(len(paths))]
        job = self.owner, self.local, self.node, self.place
        for r in range(self.k):
            salt = mix64(self.key + U64((2 * r + 1) * int(GOLDEN) & (2**64 - 1)))
            unit, arc = walk(self.lat, job[2], salt[job[0]], job[3])
            doc, local = job[0][unit], job[1][unit]
            which = [d for d, _ in turns]
            lo, hi = np.searchsorted(doc, which), np.searchsorted(doc, which, side="right")
            fresh = [self.path(d, turn, arc[a:b], local[a:b]) for (d, turn), a, b in zip(turns, lo.tolist(), hi.tolist(), strict=True)]
            self.open_sets(fresh, which, mix64(salt ^ U64(0x5851F42D4C957F2D)))
            for d, p in zip(which, fresh, strict=True):
                paths[d].append(p)
            if r + 1 == self.k:
                break
            pick = mix64(salt ^ U64(0x2545F4914F6CDD1D))
            turns = [t for d in which if (t := self.turn(d, paths[d], pick[d : d + 1]))]
            if not turns:
                break
            job = self.suffixes(turns)
        return [self.emit(ps) for ps in paths]

    def path(self, d: int, turn: tuple | None, tail: np.ndarray, local: np.ndarray) -> Path:
        p = Path()
        if turn is None:
            p.arcs, p.unit, p.turn, p.shut, p.before = tail, local, 0, (), 0.0
            p.score = float(self.roots[d])
        else:
            parent, p.turn, p.score, chosen, p.shut = turn
            p.arcs = np.concatenate([parent.arcs[: p.turn], [chosen], tail])
            p.unit = np.concatenate([parent.unit[: p.turn + 1], local])
            p.before = float(parent.phi[p.turn - parent.turn])
        return p

    def open_sets(self, paths: list[Path], which: list[int], side: np.ndarray) -> None:
        """The siblings of every step from the turn on, with their Gumbels: of all paths at once, but for sums along a path."""
        n = np.array([len(p.arcs) - p.turn for p in paths], np.int64)
        end = np.cumsum(n)
        arcs = np.concatenate([p.arcs[p.turn :] for p in paths]) if paths else np.zeros(0, np.int64)
        logs, rest = self.lat.logp[arcs], self.lat.rest[arcs].astype(float)
        lead = np.empty(len(arcs))
        for p, e, m, d in zip(paths, end.tolist(), n.tolist(), which, strict=True):
            if not m:
                p.logp = p.before
                continue
            run = np.cumsum(logs[e - m : e])
            p.logp = p.before + float(run[-1])
            lead[e - m] = p.before
            lead[e - m + 1 : e] = run[:-1] + p.before
            if p.shut:
                rest[e - m] = self.left(self.node_of(p, p.turn, d), {*p.shut, int(p.arcs[p.turn])})
        place = np.arange(len(arcs)) - np.repeat(end - n - np.array([p.turn for p in paths], np.int64), n)
        # a set less likely than e^-60 of a path's likeliest one cannot be told from none in double precision
        phi = lead + rest
        found = np.full(len(phi), NEG)
        some = np.flatnonzero(n)
        if len(some):
            near = np.flatnonzero(phi > np.repeat(np.maximum.reduceat(phi, (end - n)[some]) - 60.0, n[some]))
            by = np.repeat(np.arange(len(paths)), n)[near]
            found[near] = truncated(phi[near], np.array([p.score for p in paths])[by], uniform(side[which][by], place[near]))
        for p, e, m in zip(paths, end.tolist(), n.tolist(), strict=True):
            p.open, p.phi = found[e - m : e], lead[e - m : e]

    def turn(self, d: int, paths: list[Path], pick: np.ndarray) -> tuple | None:
        """The best open set of a text, and the arc by which the next path leaves."""
        score, j = max(((float(p.open.max()), -j) for j, p in enumerate(paths) if len(p.open)), default=(NEG, 0))
        if score == NEG:
            return None
        p = paths[-j]
        o = int(p.open.argmax())
        i = p.turn + o
        shut = {int(p.arcs[i])} | (set(p.shut) if o == 0 else set())
        chosen = self.draw(self.node_of(p, i, d), shut, float(uniform(pick, np.array([i]))[0]))
        p.open[o] = NEG  # the new path takes over what is left of this set
        return d, (p, i, score, chosen, tuple(sorted(shut)))

    def suffixes(self, turns: list[tuple]) -> tuple[np.ndarray, ...]:
        """What is to be walked anew: the rest of the unit of each turn, and the units after it."""
        out = []
        for d, (p, i, _, chosen, _) in turns:
            u, begin, end = int(p.unit[i]), int(self.begin[d]), int(self.begin[d] + self.counts[d])
            if (nxt := int(self.lat.to[chosen])) >= 0:
                out.append((np.array([d]), np.array([u]), np.array([nxt]), self.place[begin + u : begin + u + 1] + (nxt - self.node[begin + u])))
            s = slice(begin + u + 1, end)
            out.append((self.owner[s], self.local[s], self.node[s], self.place[s]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def emit(self, paths: list[Path]) -> list[tuple[np.ndarray, float, float, float]]:
        kappa = max((float(p.open.max()) for p in paths if len(p.open)), default=NEG)
        inclusion = lambda p: 1.0 if kappa == NEG else float(-np.expm1(-np.exp(min(700.0, p.logp - kappa))))
        return [(p.arcs, p.logp, p.score, inclusion(p)) for p in sorted(paths, key=lambda p: -p.score)]

    def ids(self, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of paths, one after the other, and where each ends; characters without a piece are written as their bytes."""
        piece = self.lat.piece[np.concatenate(paths)] if paths else np.zeros(0, np.int32)
        ends = np.cumsum([len(x) for x in paths], dtype=np.int64)
        bare = np.flatnonzero(piece < 0)
        if len(bare):
            codes, back = np.unique(piece[bare], return_inverse=True)
            spelt = [self.vocab.byte[list(chr(-c - 1).encode())] for c in codes.tolist()]
            size = np.ones(len(piece), np.int64)
            size[bare] = np.array([len(x) for x in spelt])[back]
            to = np.cumsum(size)
            out = np.repeat(piece, size)
            for j in range(max(map(len, spelt))):
                jth = np.array([x[j] if j < len(x) else -1 for x in spelt])[back]
                has = jth >= 0
                out[(to - size)[bare][has] + j] = jth[has]
            ends, piece = np.r_[0, to][ends], out
        return piece, ends

    def node_of(self, p: Path, i: int, d: int) -> int:
        """The node from which step i of a path leaves."""
        if i and p.unit[i] == p.unit[i - 1]:
            return int(self.lat.to[p.arcs[i - 1]])
        return int(self.node[self.begin[d] + p.unit[i]])

    def others(self, node: int, shut: set[int]) -> list[tuple[int, float]]:
        s, more = divmod(int(self.lat.pair[node]), 64)
        return [(a, float(self.lat.logp[a])) for a in range(s, s + more + 1) if a not in shut]

    def left(self, node: int, shut: set[int]) -> float:
        return float(np.logaddexp.reduce(ws)) if (ws := [w for _, w in self.others(node, shut)]) else NEG

    def draw(self, node: int, shut: set[int], u: float) -> int:
        arcs = self.others(node, shut)
        top = max(w for _, w in arcs)
        ps = [math.exp(w - top) for _, w in arcs]
        x = u * sum(ps)
        for (a, _), p in zip(arcs, ps, strict=True):
            x -= p
            if x <= 0:
                return a
        return arcs[-1][0]


def decode_bytes(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """UTF-8 of ids, the space in front still there."""
    width = vocab.width[ids]
    end = np.cumsum(width)
    return vocab.bytes[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(vocab.offset[ids] - (end - width), width)]


def round_trips(vocab: Vocabulary, ids: np.ndarray, ends: np.ndarray, texts: list[str]) -> list[bool]:
    """Whether each run of ids decodes to its text: all are decoded in one go, and compared byte by byte."""
    wanted = [(" " + t.replace(SPACE, " ")).encode() if t else b"" for t in texts]
    size = np.diff(np.r_[0, np.cumsum(vocab.width[ids])][np.r_[0, ends]]) if len(ids) else np.zeros(len(texts), np.int64)
    same = size == np.array([len(w) for w in wanted], np.int64)
    got = decode_bytes(vocab, ids)
    if same.all():
        goal = np.frombuffer(b"".join(wanted), np.uint8)
        some = np.flatnonzero(size)
        if len(some):
            same[some] = np.logical_and.reduceat(got == goal, (np.cumsum(size) - size)[some])
        return same.tolist()
    raw, to = got.tobytes(), np.cumsum(size).tolist()
    return [raw[e - n : e] == w for e, n, w in zip(to, size.tolist(), wanted, strict=True)]


def decode_ids(vocab: Vocabulary, ids: list[int] | np.ndarray) -> str:
    """The text of ids; the space in front goes."""
    text = decode_bytes(vocab, np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


#: Lattices of units are kept from one batch of a task to the next up to about so many arcs.
KNOWN_ARCS = 4_000_000
SLICE = 1 << 20  # characters that are sampled at a time

SAMPLE = T.StructType([T.StructField(n, t) for n, t in (("_sample", T.IntegerType()), ("_ids", T.ArrayType(T.IntegerType())), ("_logp", T.DoubleType()), ("_score", T.DoubleType()), ("_inclusion", T.DoubleType()), ("_round_trip", T.BooleanType()))])


def _encode(batches: Iterator[pa.RecordBatch], kept: list[str], model: str, temperature: float, k: int, seed: int) -> Iterator[pa.RecordBatch]:
    vocab, known = vocabulary(model, temperature), Lattices()
    for batch in batches:
        whole = [x or "" for x in batch.column("_t").to_pylist()]
        keys = [x or 0 for x in batch.column("_k").to_pylist()]
        for s in slices([len(t) for t in whole], SLICE):
            texts = whole[s]
            sampler = Sampler(vocab, texts, keys[s], k, seed, known)
            rows = [(i, j, *x) for i, got in enumerate(sampler.run()) for j, x in enumerate(got)]
            flat, ends = sampler.ids([r[2] for r in rows])
            back = round_trips(vocab, flat, ends, [texts[r[0]] for r in rows])
            at = pa.array([s.start + r[0] for r in rows])
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat))
            cols = [pa.array([r[1] + 1 for r in rows], pa.int32()), ids, *(pa.array(np.round([r[c] for r in rows], 9)) for c in (3, 4)), pa.array([float(f"{r[5]:.9g}") for r in rows]), pa.array(back)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), *cols], [*kept, *SAMPLE.names])


def encode(docs: DataFrame, carry: list[str] | None = None, text: str = "text", key: str = "doc_id", k: int = 2, seed: int = 11, temperature: float = 1.0, model: str = DEFAULT_MODEL) -> DataFrame:
    """``carry`` and, for each of at most k samples: its rank, ids, log-probability, perturbed score, inclusion score, and whether its ids decode to the text."""
    small_batches(docs.sparkSession)
    carry = list(docs.columns if carry is None else carry)
    kept = [f"_c{i}" for i in range(len(carry))]

    named = docs.select(*(F.col(c).alias(n) for n, c in zip(kept, carry, strict=True)), F.col(text).alias("_t"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_k"))
    out = named.mapInArrow(lambda it: _encode(it, kept, model, temperature, k, seed), T.StructType([*named.schema.fields[:-2], *SAMPLE.fields]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(kept, carry, strict=True)), *SAMPLE.names)


def decode(encoded: DataFrame, ids: str = "_ids", name: str = "_text", model: str = DEFAULT_MODEL) -> DataFrame:
    """All columns and the text of the ids; null ids are an empty text."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, 1.0)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([decode_ids(vocab, x or []) for x in b.column(ids).to_pylist()])], [*b.schema.names, name])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())]))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return out.select("doc_id", F.col("_sample").alias("sample"), F.col("_ids").alias("ids"), F.size("_ids").alias("n_pieces"), F.col("_logp").alias("logp"), F.col("_score").alias("perturbed"), F.col("_inclusion").alias("inclusion"), F.col("_round_trip").alias("round_trip"))
