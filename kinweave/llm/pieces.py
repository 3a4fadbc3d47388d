"""Operator 7: SentencePiece encoding by Gumbel top-k without replacement, and decoding.

A text's segmentations are the paths of the lattice of vocabulary pieces. Giving every path its
log-probability plus a Gumbel variable and taking the k largest is sampling k distinct paths
without replacement. The search is A* from the top: the largest perturbed value of a set of
paths is drawn first; the path that has it is walked piece by piece, and at each of its pieces
the set of paths that part there gets its own largest value, drawn under the bound of the set
it comes from. The queue always yields the next largest value of all, and only as many sets
are kept as there are samples to come.

Pieces never hold a space after another character, so the lattice falls apart into chunks (a
run of spaces and what follows), and each chunk into units: a place that no piece spans is one
that every path passes. Each distinct chunk's lattice is built once, together with those of all
new chunks, and its backward sums make every edge a conditional probability. Lattices are kept
from block to block within a bound of bytes; beyond it those that only one block had go. All
units of all texts of a block are walked at once, so long texts without spaces need no more
steps than short ones. A character without a piece is spelled in byte pieces; so is U+2581,
which the vocabulary uses for a space, so decoding gives back every text exactly.

A BPE vocabulary has ranks and no probabilities: a piece's weight is one over its rank plus 10.
Random numbers are hashes of the row's key, the sample, the unit and the step, so results
don't depend on partitions or retries.

Defined cases: a null text gives null samples; an empty one a single empty sample; a text with
fewer segmentations than asked for gives all of them with inclusion 1; a null key is hashed as
0, and repeated keys draw alike; an empty table gives an empty result; other columns are
carried along.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ident
from .textkit import blocks, lists, mix, powers, tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 2, 7
SPACE = "▁"
SAMPLE = "array<struct<ids: array<int>, log_prob: double, log_inclusion: double>>"
#: Texts are worked on in blocks of about this many bytes; lattices are kept up to this many bytes in a task.
BLOCK_BYTES, KEPT_BYTES = 1 << 19, 40 << 20
_SPELLED = 1 << 24  # an edge that spells a character in bytes is numbered from here, plus its code point
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for ``size[0]`` numbers, then from first[1] on, and so forth."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


class _Table:
    """A hash table of 64-bit keys in flat arrays, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -2, np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            _, first = np.unique(at[left][free], return_index=True)
            put = left[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) % size

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -2 where it has none."""
        at = self._home(keys)
        held = self.keys[at]
        hit = held == keys
        out = np.where(hit, self.values[at], -2)
        on = np.flatnonzero(~hit & (held != 0))
        while len(on):
            at[on] = (at[on] + 1) % len(self.keys)
            held = self.keys[at[on]]
            hit = held == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (held != 0)]
        return out


def _rolled(text: bytes) -> int:
    h = 0
    for b in text:
        h = (h * int(_ROLL) + b + 1) & (2**64 - 1)
    return h


class Vocabulary:
    """Pieces and the prefixes of longer ones in flat arrays; small enough to be sent to every task."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        raw = [b""] * n
        self.byte_ids = np.zeros(256, np.int32)
        pieces: dict[bytes, int] = {}
        order = sorted((i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))), key=lambda i: (-sp.get_score(i), i))
        weight = {i: 1 / (10 + r) for r, i in enumerate(order)}
        total = math.fsum(weight.values())
        self.log_p = np.array([math.log(weight[i] / total) if i in weight else -math.inf for i in range(n)])
        for i in order:
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                raw[i], self.byte_ids[value] = bytes([value]), i
            elif SPACE not in piece.lstrip(SPACE):
                raw[i] = piece.replace(SPACE, " ").encode()
                pieces[raw[i]] = i
        self.most = max(map(len, pieces))
        for piece in list(pieces):
            for k in range(1, len(piece)):
                pieces.setdefault(piece[:k], -1)
        self.table = _Table(np.array([_rolled(t) for t in pieces], np.uint64), np.array(list(pieces.values()), np.int32))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of pieces."""
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        return self.raw[_ranges(self.raw_at[ids], size)]

    def spelled(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each edge has) of edges, those that spell a character in its bytes."""
        odd = np.flatnonzero(piece >= _SPELLED)
        counts = np.ones(len(piece), np.int64)
        if not len(odd):
            return piece.astype(np.int32), counts
        code = piece[odd] - _SPELLED
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        counts[odd] = size
        ids = np.repeat(piece, counts)
        first = (np.cumsum(counts) - counts)[odd]
        for k in range(4):  # the UTF-8 bytes
            some = size > k
            part = code[some] >> (6 * (size[some] - 1 - k))
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[some]]
            ids[first[some] + k] = self.byte_ids[part | lead if k == 0 else part & 0x3F | 0x80]
        return ids.astype(np.int32), counts


class Lattices:
    """Lattices of distinct chunks in flat arrays: of each state its edges, with probabilities running up to 1.

    A state is a place in a chunk. ``run`` of an edge is its state plus the running probability,
    ``to`` the state after it (-1 at the end of its unit), ``log_p`` its log-probability given
    the state, ``first`` of a state its first edge. Chunks are known by a hash of their bytes.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.hashes, self.units, self.unit, self.hits = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.unit_state = np.zeros(0, np.int64)
        self.first, self.run, self.log_p = np.zeros(1, np.int32), np.zeros(0), np.zeros(0)
        self.to, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of chunks, by sorted hashes; -1 for those not there."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def size(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.units, self.unit, self.hits, self.unit_state, self.first, self.run, self.log_p, self.to, self.piece))

    def prune(self) -> None:
        """Keep the chunks that more than one block had; none, if they alone are over the bound."""
        keep = np.flatnonzero(self.hits > 1)
        states = np.append(self.unit_state, len(self.first) - 1)
        lo, hi = states[self.unit[keep]], states[self.unit[keep] + self.units[keep]]
        if (hi - lo).sum() * 2 > len(self.first):
            keep, lo, hi = keep[:0], lo[:0], hi[:0]
        state = _ranges(lo, hi - lo)
        count = np.diff(self.first)[state]
        edge = _ranges(self.first[state], count)
        moved = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)  # of each state, by how much it moves down
        by = np.repeat(moved, count)
        units = self.units[keep]
        at = _ranges(self.unit[keep], units)
        self.unit_state = self.unit_state[at] - np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), units)
        self.hashes, self.hits, self.units, self.unit = self.hashes[keep], np.ones(len(keep), np.int64), units, np.cumsum(units) - units
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        self.run, self.log_p, self.piece = self.run[edge] - by, self.log_p[edge], self.piece[edge]
        self.to = np.where(self.to[edge] < 0, -1, self.to[edge] - by).astype(np.int32)

    def add(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Build the lattices of new chunks: their hashes, and where each starts and ends in ``data``."""
        size = end - start
        data = data[_ranges(start, size)]
        n, ends = len(data), np.cumsum(size)
        begins = ends - size
        left = np.repeat(ends, size) - np.arange(n)  # bytes up to the end of the chunk
        wide = np.ones(n, np.int64)  # bytes of the character that starts here
        for least, bytes_ in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            wide[data >= least] = bytes_
        at = np.flatnonzero((data & 0xC0) != 0x80)
        every, h = at, np.zeros(len(at), np.uint64)
        froms, ranks, lengths, pieces = [], [], [], []
        count, single = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(1, self.v.most + 1):
            on = left[at] >= k
            at, h = at[on], h[on]
            h = h * _ROLL + data[at + k - 1] + np.uint64(1)
            ids = self.v.table.find(h)
            full = np.flatnonzero(ids >= 0)
            where = at[full]
            froms.append(where), ranks.append(count[where]), lengths.append(np.full(len(where), k)), pieces.append(ids[full].astype(np.int64))
            count[where] += 1
            single[where[wide[where] == k]] = True
            on = ids > -2
            at, h = at[on], h[on]
            if not len(at):
                break
        bare = every[~single[every]]  # characters without a piece
        code = data[bare].astype(np.int64) & np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[wide[bare]]
        for k in range(1, 4):
            some = wide[bare] > k
            code[some] = code[some] << 6 | data[bare[some] + k] & 0x3F
        froms.append(bare), ranks.append(count[bare]), lengths.append(wide[bare]), pieces.append(_SPELLED + code)
        count[bare] += 1
        first = np.concatenate([[0], np.cumsum(count)])
        total = first[-1]
        start, rank, length = np.concatenate(froms), np.concatenate(ranks), np.concatenate(lengths)
        place = first[start] + rank
        tail, piece = np.zeros(total, np.int64), np.zeros(total, np.int64)
        tail[place], piece[place] = start + length, np.concatenate(pieces)
        log_p = np.zeros(total)
        spelled = np.flatnonzero(piece >= _SPELLED)
        plain = piece < _SPELLED
        log_p[plain] = self.v.log_p[piece[plain]]
        if len(spelled):
            ids, sizes = self.v.spelled(piece[spelled])
            log_p[spelled] = np.add.reduceat(self.v.log_p[ids], np.cumsum(sizes) - sizes)
        # places that no piece spans
        cover = np.bincount(start[length > 1] + 1, minlength=n + 1) - np.bincount((start + length)[length > 1], minlength=n + 1)
        free = np.cumsum(cover)[:n] == 0
        cuts = every[free[every]]
        unit_end = np.repeat(np.append(cuts[1:], n), np.diff(np.append(cuts, n)))
        # backward sums, one step for all units at once; within a unit they start at 1 from its end
        beta, value, run = np.zeros(n + 1), np.zeros(total), np.zeros(total)
        far = unit_end[every] - every
        order = np.argsort(far, kind="stable")
        by, far = every[order], far[order]
        rounds = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]])) if len(far) else np.zeros(0, np.int64)
        for lo, hi in zip(rounds.tolist(), [*rounds[1:].tolist(), len(by)]):
            p = by[lo:hi]
            c = count[p]
            column = np.arange(int(c.max()))
            there = column < c[:, None]
            edge = first[p][:, None] + np.minimum(column, c[:, None] - 1)
            t = tail[edge]
            x = np.where(there, log_p[edge] + np.where(t == unit_end[p][:, None], 0.0, beta[t]), -np.inf)
            top = x.max(axis=1)
            sums = np.cumsum(np.exp(x - top[:, None]), axis=1)  # one by one, so other rows change nothing
            beta[p] = all_of = top + np.log(sums[:, -1])
            at = edge[there]
            value[at] = np.minimum(x - all_of[:, None], 0.0)[there]
            run[at] = np.minimum(sums / sums[:, -1:], 1.0)[there]
        base = len(self.first) - 1
        owner = np.repeat(np.arange(n), count)
        run += base + owner
        run[(first[1:] - 1)[count > 0]] = base + np.flatnonzero(count > 0) + 1.0
        to = np.where(tail == unit_end[owner], -1, tail + base)
        # the new chunks among the old ones, by hash
        unit = np.searchsorted(cuts, begins)
        units = np.diff(np.append(unit, len(cuts)))
        where = np.searchsorted(self.hashes, hashes)
        self.hashes, self.units = np.insert(self.hashes, where, hashes), np.insert(self.units, where, units)
        self.unit, self.hits = np.insert(self.unit, where, unit + len(self.unit_state)), np.insert(self.hits, where, 0)
        self.unit_state = np.concatenate([self.unit_state, cuts + base])
        self.first = np.concatenate([self.first[:-1], (first + len(self.run)).astype(np.int32)])
        self.run, self.log_p = np.concatenate([self.run, run]), np.concatenate([self.log_p, value])
        self.to, self.piece = np.concatenate([self.to, to.astype(np.int32)]), np.concatenate([self.piece, piece.astype(np.int32)])


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, owners) of the chunks of texts, each of which begins with a space."""
    space = data == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(first)
    n = len(data)
    up, down = powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    end = np.append(start[1:], n)
    hashes = mix((sums[end] - sums[start]) * down[start] ^ (end - start).astype(np.uint64) << np.uint64(40))
    return start, hashes, np.searchsorted(offsets, start, "right") - 1


def _own(seed: np.ndarray, sample: int, unit: np.ndarray) -> np.ndarray:
    """A number for each key, sample and unit."""
    return mix(seed ^ (unit.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64((sample << 20) + (1 << 50)))) << np.uint64(8)


def _spread(x: np.ndarray) -> np.ndarray:
    """Uniform numbers over 0 from spread 64-bit ones that differ in their low bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _uniform(seed: np.ndarray, sample: int, unit: np.ndarray, step: int) -> np.ndarray:
    return _spread(mix(seed ^ (unit.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(step + (sample << 20) + (1 << 51)))))


def _walk(lattices: Lattices, start: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw a path through each unit from a state on: (pieces of each, edges in order)."""
    run, first, to = lattices.run, lattices.first, lattices.to
    index, state, step = np.arange(len(start)), start, 0
    counts = np.zeros(len(start), np.int64)
    indices, edges = [], []
    while len(index):
        at = state + np.minimum(_spread(own[index] + np.uint64(step)), 1 - 1e-8)
        # the longest pieces come last and have most of the weight, so edges are tried from the last
        edge, low = first[state + 1] - 1, first[state]
        more = np.flatnonzero((edge > low) & (at < run[edge - 1]))
        while len(more):
            edge[more] -= 1
            e = edge[more]
            more = more[(e > low[more]) & (at[more] < run[e - 1])]
        indices.append(index), edges.append(edge)
        counts[index] += 1
        state = to[edge]
        on = np.flatnonzero(state >= 0)
        index, state, step = index[on], state[on].astype(np.int64), step + 1
    out = np.zeros(int(counts.sum()), np.int64)
    first_of = np.cumsum(counts) - counts
    for step, (index, edge) in enumerate(zip(indices, edges)):
        out[first_of[index] + step] = edge
    return counts, out


def _under(bound: np.ndarray, at: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with locations ``at``, not over ``bound``."""
    return at - np.log(np.exp(np.minimum(at - bound, 700)) - np.log(u))


def _log_inclusion(log_p: float, bound: float) -> float:
    """log(1 - exp(-exp(log_p - bound))): how likely a path is over the largest value not taken."""
    x = log_p - bound
    return 0.0 if x > 4 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))


@dataclass
class _Path:
    """A sampled path of a text."""

    unit: np.ndarray  # of each piece, within the text
    edges: np.ndarray
    so_far: np.ndarray  # log p before each piece, and of all
    value: float  # perturbed


class _Text:
    """The search in one text: its units, the paths taken, and the queue of sets of paths."""

    def __init__(self, seed: np.uint64, starts: np.ndarray):
        self.seed, self.starts = seed, starts
        self.taken: list[_Path] = []
        self.queue: list[tuple[float, int, int, tuple[int, ...]]] = []

    def pop(self, lattices: Lattices) -> tuple[_Path, float, int, int, tuple[int, ...], np.ndarray, np.ndarray]:
        """The next set of paths: (parent, value, where it parts, its piece there, barred ones, states to walk on from, their units)."""
        value, parent, t, barred = heapq.heappop(self.queue)
        path = self.taken[parent]
        state = int(math.ceil(lattices.run[path.edges[t]])) - 1
        lo, hi = int(lattices.first[state]), int(lattices.first[state + 1])
        p = np.exp(lattices.log_p[lo:hi])
        p[[b - lo for b in barred]] = 0
        c = np.cumsum(p)
        u = float(_uniform(np.array([self.seed]), len(self.taken), np.array([t]), 1 << 17)[0])
        pick = lo + min(int(np.searchsorted(c, c[-1] * u, "right")), hi - lo - 1)
        unit, on = int(path.unit[t]), int(lattices.to[pick])
        onward = self.starts[unit + 1 :] if on < 0 else np.concatenate([[on], self.starts[unit + 1 :]])
        return path, -value, t, pick, barred, onward, np.arange(len(self.starts) - len(onward), len(self.starts))


def _enter(lattices: Lattices, texts: list[_Text], fresh: list[tuple[_Path, int, tuple[int, ...]]], k: int) -> None:
    """Take a path of each text; queue the sets that part from it at a piece or later. The barred edges are gone there."""
    edges = np.concatenate([p.edges[since:] for p, since, _ in fresh])
    sizes = np.array([len(p.edges) - since for p, since, _ in fresh])
    cut = np.cumsum(sizes) - sizes
    rest = -np.expm1(lattices.log_p[edges])
    for at, (_, _, barred) in zip(cut.tolist(), fresh):
        if barred:
            rest[at] = max(0.0, rest[at] - float(np.exp(lattices.log_p[list(barred)]).sum()))
    step = _ranges(np.array([since for _, since, _ in fresh]), sizes)
    seeds = np.repeat(np.array([t.seed for t in texts]), sizes)
    u = np.zeros(len(edges))
    ranks = np.array([len(t.taken) for t in texts])
    for n in np.unique(ranks).tolist():
        some = np.repeat(ranks == n, sizes)
        u[some] = _uniform(seeds[some], n, step[some], 1 << 19)
    before = np.concatenate([p.so_far[since:-1] for p, since, _ in fresh])
    bound = np.repeat(np.array([p.value for p, _, _ in fresh]), sizes)
    with np.errstate(divide="ignore"):
        values = np.where(rest > 1e-12, _under(bound, before + np.log(rest), u), -np.inf)
    for t, (p, _, _) in zip(texts, fresh):
        t.taken.append(p)
    ends = cut + sizes
    wanted = [k + 1 - len(t.taken) for t in texts]
    for j in range(max(wanted)):
        best = np.maximum.reduceat(values, cut)
        where = np.flatnonzero(values == np.repeat(best, sizes))
        where = where[np.searchsorted(where, cut)]  # the first of each text
        for i, (at, x) in enumerate(zip(where.tolist(), best.tolist())):
            if j < wanted[i] and x > -np.inf and at < ends[i]:
                p, since, barred = fresh[i]
                here = since + at - int(cut[i])
                heapq.heappush(texts[i].queue, (-x, len(texts[i].taken) - 1, here, (int(p.edges[here]), *(barred if here == since else ()))))
        values[where] = -np.inf


class Encoder:
    """Encodes texts in a task. Lattices of distinct chunks are kept, within a bound, from block to block."""

    def __init__(self, vocabulary: Vocabulary, samples: int = SAMPLES, seed: int = SEED):
        self.v, self.k, self.seed, self.lattices = vocabulary, samples, seed, Lattices(vocabulary)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start state, text) of each unit of a block's texts."""
        start, hashes, owner = _chunks(data, offsets)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.lattices.size() > KEPT_BYTES:
            self.lattices.prune()
        new = np.flatnonzero(self.lattices.find(distinct) < 0)
        if len(new):
            self.lattices.add(distinct[new], data, start[where[new]], np.append(start[1:], len(data))[where[new]])
        at = self.lattices.find(distinct)
        self.lattices.hits[at] += 1
        at = at[back]
        units = self.lattices.units[at]
        return self.lattices.unit_state[_ranges(self.lattices.unit[at], units)], np.repeat(owner, units)

    def encode(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[np.ndarray, float, float]]]:
        """For each text of a block its samples (edges' ids, log p, log inclusion); texts are not null."""
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        out: list[list] = [[(np.zeros(0, np.int32), 0.0, 0.0)] for _ in sizes]
        if not len(full):
            return out
        spaced = np.insert(data, offsets[:-1][full], 0x20)  # the space that the vocabulary wants before every text
        at = np.concatenate([[0], np.cumsum(sizes[full] + 1)])
        states, owner = self._units(spaced, at)
        ends = np.searchsorted(owner, np.arange(len(full) + 1))
        seeds = mix(keys[full].astype(np.int64).view(np.uint64) + np.uint64(self.seed * 1_000_003))
        texts = [_Text(s, states[a:b]) for s, a, b in zip(seeds, ends[:-1], ends[1:])]
        within = np.arange(len(states)) - ends[owner]
        counts, edges = _walk(self.lattices, states, _own(seeds[owner], 0, within))
        tops = -np.log(-np.log(_uniform(seeds, 0, np.zeros(len(seeds), np.int64), 1 << 18)))
        piece_ends = np.concatenate([[0], np.cumsum(counts)])[ends]
        unit = np.repeat(within, counts)
        fresh = []
        for i, top in enumerate(tops.tolist()):
            a, b = piece_ends[i], piece_ends[i + 1]
            fresh.append((self._path(unit[a:b], edges[a:b], top), 0, ()))
        active = texts
        while active:
            _enter(self.lattices, active, fresh, self.k)
            active = [t for t in active if t.queue and len(t.taken) < self.k]
            popped = [t.pop(self.lattices) for t in active]
            if not popped:
                break
            onward = np.concatenate([x[5] for x in popped]).astype(np.int64)
            more = np.concatenate([x[6] for x in popped])
            lengths = np.array([len(x[5]) for x in popped])
            who = np.repeat(np.array([t.seed for t in active]), lengths)
            own = np.concatenate([_own(s, len(t.taken), u) for t, s, u in zip(active, np.split(who, np.cumsum(lengths)[:-1]), np.split(more, np.cumsum(lengths)[:-1]))])
            counts, edges = _walk(self.lattices, onward, own)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            piece_ends = np.concatenate([[0], np.cumsum(counts)])[ends]
            unit = np.repeat(more, counts)
            fresh = []
            for i, (path, value, t, pick, barred, _, _) in enumerate(popped):
                a, b = piece_ends[i], piece_ends[i + 1]
                units = np.concatenate([path.unit[: t + 1], unit[a:b]])
                fresh.append((self._path(units, np.concatenate([path.edges[:t], [pick], edges[a:b]]), value), t, barred))
        for i, t in zip(full.tolist(), texts):
            bound = -t.queue[0][0] if t.queue else -math.inf
            out[i] = [(self.lattices.piece[p.edges], float(p.so_far[-1]), _log_inclusion(float(p.so_far[-1]), bound)) for p in t.taken]
        pieces = [s[0] for i in full.tolist() for s in out[i]]
        ids, n = self.v.spelled(np.concatenate(pieces))
        cut = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, pieces)])]
        made = iter(zip(cut[:-1].tolist(), cut[1:].tolist()))
        for i in full.tolist():
            out[i] = [(ids[slice(*next(made))], lp, q) for _, lp, q in out[i]]
        return out

    def _path(self, unit: np.ndarray, edges: np.ndarray, value: float) -> _Path:
        return _Path(unit, edges, np.concatenate([[0.0], np.cumsum(self.lattices.log_p[edges])]), value)

    def blocks(self, keys: pa.Array, texts: pa.Array):
        """(first row, row after the last, texts' bytes and offsets, samples) of blocks of a batch."""
        key = keys.fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in blocks(texts, BLOCK_BYTES):
            yield lo, hi, data, offsets, self.encode(key[lo:hi], data, offsets)


def _arrow(rows: list[list[tuple[np.ndarray, float, float]]], null: np.ndarray) -> pa.Array:
    rows = [[] if n else r for r, n in zip(rows, null.tolist())]
    each = [x for g in rows for x in g]
    ids = lists(np.concatenate([x[0] for x in each]) if each else np.zeros(0, np.int32), np.array([len(x[0]) for x in each], np.int64), pa.int32())
    samples = pa.StructArray.from_arrays([ids, *(pa.array([x[k] for x in each], pa.float64()) for k in (1, 2))], ["ids", "log_prob", "log_inclusion"])
    ends = np.concatenate([[0], np.cumsum([len(g) for g in rows])])
    at = pa.array(ends, pa.int32(), mask=np.append(null, False))
    return pa.ListArray.from_arrays(at, samples)


def _key(docs: DataFrame, id_col: str) -> Column:
    """What seeds a row's draws: its id, or a hash of an id that isn't a whole number."""
    own = ident(docs, id_col)
    return own if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.when(own.isNotNull(), F.xxhash64(own))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """All columns, and ``samples``: distinct segmentations as ids, log p and log inclusion, the largest perturbed value first.

    ``samples`` replaces a column of that name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    docs = docs.withColumn("__kw_key", _key(docs, id_col))
    names = [f"__kw_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    key, text = docs.columns.index("__kw_key"), docs.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"__kw_samples {SAMPLE}").fields])

    def run(batches):
        encoder = Encoder(sent.value, samples, seed)
        for batch in batches:
            null = batch.column(text).is_null().to_numpy(zero_copy_only=False)
            for lo, hi, _, _, got in encoder.blocks(batch.column(key), batch.column(text)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, _arrow(got, null[lo:hi])], [*names, "__kw_samples"])

    out = rows.mapInArrow(tidied(run), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns) if c not in ("__kw_key", "samples")], F.col("__kw_samples").alias("samples"))


def decoder(spark: SparkSession, model: str = MODEL):
    """A column function from piece ids to text; the space put before every text goes."""
    sent = spark.sparkContext.broadcast(Vocabulary(model))

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        v = sent.value
        return pa.array([None if x is None else v.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace")[1:] for x in ids.to_pylist()], pa.string())

    return decode


def pieces_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """One row per document and sample: doc_id, sample, n_pieces, ids_hash, log_prob, log_inclusion, round_trip (that
    decoding gives back the text). A null text has one row without a sample. Sampled, decoded and compared in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _key(docs, id_col).alias("__kw_key"))
    schema = rows.select("doc_id").schema
    for f in T.StructType.fromDDL("sample int, n_pieces int, ids_hash long, log_prob double, log_inclusion double, round_trip boolean"):
        schema = schema.add(f)

    def digest(ids: np.ndarray) -> int:
        place = np.arange(len(ids), dtype=np.uint64) * _ROLL
        return int(mix(np.array([np.add.reduce(mix(ids.astype(np.uint64) + place)) + np.uint64(len(ids))])).view(np.int64)[0])

    def run(batches):
        encoder = Encoder(sent.value, samples, seed)
        for batch in batches:
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets, got in encoder.blocks(batch.column(2), batch.column(1)):
                at, made = [], []
                for i, rows in enumerate(got):
                    text = data[offsets[i] : offsets[i + 1]]
                    if null[lo + i]:
                        at.append(lo + i), made.append((None, None, None, None, None, True))
                        continue
                    for k, (ids, lp, q) in enumerate(rows):
                        back = encoder.v.decode(ids)[1:]
                        at.append(lo + i), made.append((k, len(ids), digest(ids), lp, q, bool(np.array_equal(back, text))))
                columns = [pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], schema.names)

    return rows.mapInArrow(tidied(run), schema)
