"""SentencePiece encoding and decoding, and sampled segmentations by Gumbel top-k without replacement.

A text gets the tokenizer's own encoding, put together from those of its units (below), which the tokenizer gives. Its lattice holds every sequence of vocabulary pieces that spells the text as the
tokenizer normalises it (a character that is no piece is spelled by its bytes, as in the tokenizer); a segmentation weighs
exp(sum over pieces of (score / SCALE - COST)). A text is cut between characters that stand beside each other in no piece, so the lattice
is the product of those of its units (what lies between cuts), each with exact normalisers from a backward pass that is kept by unit.

The k segmentations are drawn without replacement by perturbed A-star search: the whole space has a Gumbel value at its
sample; taking a sample splits its region into the regions that first leave it at each step, whose Gumbel values are drawn
given that they lie below it; the queue gives the region with the highest value next. The steps of a group of texts are NumPy
arrays, the queues are each text's own. With kappa, the value of the (k+1)-th, a sample's inclusion score is 1 - exp(-exp(log p - kappa)).

Randomness depends on the seed and the row's key only (doc_id, or the content where that is null), so a lost task redraws the
same. Null and empty texts have no pieces, a text with the tokenizer's own space mark (U+2581) decodes to a space there and says so, and a text has no more samples than segmentations; repeated rows draw the same;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltbed.llm import common as C

SCALE, COST = 4000.0, 2.0
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
CHARACTERS = 1 << 19  # of texts that are encoded and sampled together; a longer text is a group of its own
STEPS = 512  # of a sample that are looked at first for those where the next ones leave it
APART = 45.0  # Gumbel values of ``uniforms`` lie between -3.7 and 37.5, so masses that are this far apart keep their order
BELOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight
NO_PIECE = "\U0010ffff".encode()  # stands for what a tokenizer without bytes does not know


class NotApart(ValueError):
    """A tokenizer changes units that stand beside others."""


def grown(old: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """An array whose first ``used`` values are followed by new ones; it has room for more."""
    if used + len(new) > len(old):
        more = np.empty(used + used // 2 + len(new), old.dtype)
        more[:used] = old[:used]
        old = more
    old[used:used + len(new)] = new
    return old


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The positions from each start to its end, one span after another."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def utf8_sizes(points: np.ndarray) -> np.ndarray:
    """Bytes of code points in UTF-8."""
    return 1 + (points > 0x7F).view(np.int8) + (points > 0x7FF).view(np.int8) + (points > 0xFFFF).view(np.int8)


class Numbers(dict):
    """Numbers of units; one that is looked up for the first time gets the next."""

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        return number


class Automaton:
    """States are rests of units; a choice is a piece that begins the rest and ``goes`` to the first choice of what remains, or -1, the end.
    State 0 is the end.

    Units are the longest runs of characters of which each and the next are beside each other in some piece, so that no piece
    crosses units. Units keep their states for later texts until these have ``CHOICES`` choices."""

    CHOICES = 6_000_000
    SLOTS = 1 << 19  # of a table in front of the numbers: a unit of up to 23 bytes is found there by these, if no other took its slot

    def __init__(self, processor):
        n = processor.get_piece_size()
        self.bytes, self.unknown, normal, merged, self.text_of = {}, processor.unk_id(), {}, [], []
        for i in range(n):
            s = processor.id_to_piece(i)
            if processor.is_byte(i):
                self.text_of.append(bytes([int(s[1:-1], 16)]))
                self.bytes[self.text_of[-1][0]] = i
            else:
                self.text_of.append(NO_PIECE if i == self.unknown else s.encode())
                if not (processor.is_control(i) or processor.is_unknown(i)):
                    merged.append(s)  # unused pieces are split again, but the tokenizer makes them
                    if not processor.is_unused(i):
                        normal[s] = i
        self.weight = np.array([max(processor.get_score(i), -1e5) / SCALE - COST for i in range(n)])
        # A trie of pieces: node 0 is the root; ``child`` has a row for each other node that has children and a column for each
        # letter of longer pieces, the last column for all else.
        heads = sorted({s[:k] for s in normal for k in range(1, len(s) + 1)})
        node = {s: k for k, s in enumerate(["", *heads])}
        inner = {c for s in merged if len(s) > 1 for c in s}
        letters = {c: k for k, c in enumerate([*sorted(inner), *sorted({s[0] for s in heads} - inner)])}
        self.n_inner = len(inner)
        self.letter = np.full(0x110000, len(letters), np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.root = np.full(len(letters) + 1, -1, np.int32)
        self.row = np.full(len(node), -1, np.int32)
        parents = {k: r for r, k in enumerate(sorted({node[s[:-1]] for s in heads if len(s) > 1}))}
        self.row[list(parents)] = list(parents.values())
        self.child = np.full((len(parents), len(inner) + 1), -1, np.int32)
        for s in heads:
            if len(s) > 1:
                self.child[parents[node[s[:-1]]], letters[s[-1]]] = node[s]
            else:
                self.root[letters[s]] = node[s]
        self.piece_at = np.array([normal.get(s, -1) for s in node], np.int32)
        self.beside = np.zeros((len(inner) + 1, len(inner) + 1), bool)  # letters that are so in some piece
        for s in merged:
            self.beside[[letters[c] for c in s[:-1]], [letters[c] for c in s[1:]]] = True
        self.between = next(chr(c) for c in range(0xE000, 0xF900) if chr(c) not in letters)  # private use
        self.apart, self.coded = True, False
        self.size = np.array([len(b) for b in self.text_of], np.int64)
        self.reset()

    def reset(self):
        self.units = Numbers()  # ``first`` has their first choices, ``code`` their encodings
        self.slot_key, self.slot_number = np.zeros((self.SLOTS, 3), np.uint64), np.full(self.SLOTS, -1, np.int32)
        self.n, self.n_states = 0, 1
        if not hasattr(self, "piece"):  # room is kept for the next units
            self.piece, self.goes = np.zeros(0, np.int32), np.zeros(0, np.int32)
            self.logp, self.upto, self.cuts = np.zeros(0), np.zeros(0), np.zeros(2, np.int64)
            self.first, self.code, self.code_cuts = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)
            self.unit_of, self.used = np.full(1, -1, np.int32), np.zeros(0, bool)

    def keep_used(self):
        """Makes room: units that were looked up again stay, up to half of all by their characters."""
        names = list(self.units)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        kept = np.flatnonzero(self.used[:len(names)])
        kept = kept[np.cumsum(sizes[kept]) <= sizes.sum() // 2]
        stays = np.zeros(len(names) + 1, bool)  # the last is for the end, whose unit is -1
        stays[kept] = stays[-1] = True
        unit = np.cumsum(stays[:-1], dtype=np.int32) - np.int32(1)
        stays = stays[self.unit_of[:self.n_states]]
        sizes = np.diff(self.cuts[:self.n_states + 1])
        choices, ends = np.repeat(stays, sizes), np.cumsum(sizes[stays])
        n, m = int(ends[-1]), len(kept)
        for values in (self.piece, self.logp, self.upto):
            values[:n] = values[:self.n][choices]
        place = np.cumsum(choices, dtype=np.int32) - np.int32(1)
        goes = self.goes[:self.n][choices]
        self.goes[:n] = np.where(goes < 0, np.int32(-1), place[goes])
        self.cuts[1:len(ends) + 1] = ends
        self.unit_of[1:len(ends)] = unit[self.unit_of[:self.n_states][stays][1:]]
        if self.coded:
            code = self.code[spans(self.code_cuts[kept], self.code_cuts[kept + 1])]
            code_ends = np.cumsum(self.code_cuts[kept + 1] - self.code_cuts[kept])
            self.code[:len(code)], self.code_cuts[1:m + 1] = code, code_ends
        self.first[:m] = place[self.first[kept]]
        self.units = Numbers(zip(map(names.__getitem__, kept.tolist()), range(m)))
        self.used[:] = False
        self.slot_number[:] = -1
        self.n, self.n_states = n, len(ends)

    def numbers(self, parts: list[list[str]], processor=None) -> list[np.ndarray]:
        """Numbers of the units of each text, with their encodings where a processor is given; those of earlier calls may end."""
        self.make_room(processor)
        return self.entered(parts, processor)

    def make_room(self, processor):
        if (processor is None) == self.coded:
            self.reset()
            self.coded = processor is not None
        elif self.n > self.CHOICES:
            self.keep_used()

    def entered(self, parts: list[list[str]], processor) -> list[np.ndarray]:
        n, number = len(self.units), self.units.__getitem__
        found = [np.fromiter(map(number, p), np.int64, len(p)) for p in parts]
        fresh = list(islice(reversed(self.units), len(self.units) - n))[::-1]
        if fresh:
            if self.coded:
                code, sizes = self.codes(processor, fresh)
                used = int(self.code_cuts[n])
                self.code, self.code_cuts = grown(self.code, used, code), grown(self.code_cuts, n + 1, used + np.cumsum(sizes))
            self.first = grown(self.first, n, self.build(fresh, n))
            self.used = grown(self.used, n, np.zeros(len(fresh), bool))
        for x in found:
            self.used[x[x < n]] = True
        return found

    def numbers_of(self, units: pa.LargeStringArray, processor=None) -> np.ndarray:
        """Numbers of units that differ; only those that aren't in their slots become strings."""
        self.make_room(processor)
        data, cuts = C.utf8(units)
        sizes, starts = np.diff(cuts), cuts[:-1]
        eights = np.ndarray((len(data) + 1,), np.dtype("<u8"), np.concatenate([data, np.zeros(32, np.uint8)]).data, strides=(1,))
        key = np.empty((len(sizes), 3), np.uint64)
        for k in range(3):
            left = np.clip(sizes - 8 * k, 0, 8)
            key[:, k] = eights[np.minimum(starts + 8 * k, len(data))] & BELOW[left]
        key[:, 2] |= sizes.astype(np.uint64) << np.uint64(56)
        slot = (C.mix(key[:, 0] ^ C.mix(key[:, 1] ^ C.mix(key[:, 2]))) & np.uint64(self.SLOTS - 1)).astype(np.int64)
        number, short = self.slot_number[slot].astype(np.int64), sizes < 24
        known = (number >= 0) & short & (self.slot_key[slot] == key).all(1)
        self.used[number[known]] = True
        rest = np.flatnonzero(~known)
        number[rest] = self.entered([units.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist()], processor)[0]
        rest = rest[short[rest]]
        self.slot_number[slot[rest]] = -1
        self.slot_key[slot[rest]] = key[rest]
        self.slot_number[slot[rest]] = number[rest]
        return number

    def columns(self, points: np.ndarray) -> np.ndarray:
        """The columns of code points in ``child`` and ``beside``."""
        return np.minimum(self.letter[points], self.n_inner)

    def split(self, texts: list[str]) -> tuple[pa.LargeStringArray, list[np.ndarray]]:
        """(units of texts, each once; the positions there of each text's units)."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        columns, ends = self.columns(points), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begins = np.ones(len(points) + 1, bool)
        begins[1:-1] = ~self.beside[columns[:-1], columns[1:]]
        begins[ends] = True
        starts = np.flatnonzero(begins)
        upto = np.concatenate([[0], np.cumsum(utf8_sizes(points), dtype=np.int64)])[starts]
        units = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(upto), pa.py_buffer(whole.encode())).dictionary_encode()
        return units.dictionary, np.split(units.indices.to_numpy(), np.searchsorted(starts, ends[:-1]))

    def firsts(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """First choices of the units of each text that is given as tokens."""
        text_of = self.text_of.__getitem__
        units, found = self.split([b"".join(map(text_of, t.tolist())).decode("utf-8", "replace") for t in texts])
        number = self.numbers_of(units)
        first = self.first[number]
        return [first[x] for x in found]

    def encode(self, processor, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(encodings, first choices of the units) of texts. As no piece crosses units, no merge does, so that a text's encoding
        is that of its units one after another; where the tokenizer's normaliser doesn't keep units apart, whole texts go to it."""
        if self.apart:
            units, found = self.split([processor.normalize(t) for t in texts])
            try:
                number = self.numbers_of(units, processor)
            except NotApart:
                self.apart = False
                self.reset()
            else:
                starts, ends, first = self.code_cuts[number], self.code_cuts[number + 1], self.first[number]
                return [self.code[spans(starts[x], ends[x])] for x in found], [first[x] for x in found]
        coded = [np.array(processor.encode(t), np.int32) for t in texts]
        return coded, self.firsts(coded)

    def codes(self, processor, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokenizer's pieces of units, and how many each has: many are encoded at once, with a character that is in no
        piece between those that would not stand beside each other in a text. That pieces spell the text is seen where it is decoded."""
        found, counts, gap, between = [], [], len(self.between.encode()), self.between
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        size = np.add.reduceat(utf8_sizes(points), ends - lengths, dtype=np.int64)
        plain = points[ends - lengths] == ord(SPACE)  # beside each other as in a text
        last = points[ends[:-1] - 1]
        plain[1:] &= (last != ord(SPACE)) & ~self.beside[self.columns(last), self.columns(points[(ends - lengths)[1:]])]
        plain[::256] = False
        texts, behind = [u if p else between + u for u, p in zip(units, plain.tolist())], size + np.where(plain, 0, gap)
        for at in range(0, len(units), 256):
            ids = processor.encode("".join(texts[at:at + 256]), return_type="numpy")
            ends, sizes, upto = np.cumsum(self.size[ids]), size[at:at + 256], np.cumsum(behind[at:at + 256])
            upto += ends[-1] - upto[-1]  # behind what the tokenizer puts before a text
            a, b = np.searchsorted(ends, upto - sizes), np.searchsorted(ends, upto)
            if (ends[a] != upto - sizes).any() or (ends[b] != upto).any():
                raise NotApart
            found.append(ids[spans(a + 1, b + 1)])
            counts.append(b - a)
        return np.concatenate(found), np.concatenate(counts)

    def build(self, units: list[str], number: int) -> np.ndarray:
        """The first choices of new units, numbered from ``number``. States are numbered by what remains, so each round of the backward pass is a range of them."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        letters = self.letter[points]
        columns = np.minimum(letters, self.n_inner)
        n = len(points)
        left = np.repeat(ends, sizes) - np.arange(n)
        order = np.argsort(left.astype(np.uint16) if sizes.max() < 1 << 16 else left, kind="stable")
        name = np.empty(n, np.int64)
        name[order] = np.arange(n)
        found, at, nodes, length = [], np.arange(n), self.root[letters], 1
        while len(at):
            live = nodes >= 0
            at, nodes = at[live], nodes[live]
            piece = self.piece_at[nodes]
            is_piece = piece >= 0
            found.append((at[is_piece], piece[is_piece]))
            row = self.row[nodes]
            more = (row >= 0) & (left[at] > length)
            at = at[more]
            nodes = self.child[row[more], columns[at + length]]
            length += 1
        alone = np.ones(n, bool)  # characters that are no piece: bytes stand for them, as in the tokenizer
        alone[found[0][0]] = False
        alone = np.flatnonzero(alone)
        chains = []
        for x in points[alone].tolist():
            spelled = [self.bytes.get(b, self.unknown) for b in chr(x).encode("utf-8", "surrogatepass")]
            chains.append([self.unknown] if self.unknown in spelled else spelled)
        count = np.zeros(n, np.int64)
        for x, _ in found:
            count[name[x]] += 1
        count[name[alone]] += 1
        cuts = np.concatenate([[0], np.cumsum(count)])
        slot, piece, goes, weight = cuts[:-1].copy(), np.empty(cuts[-1], np.int64), np.empty(cuts[-1], np.int64), np.empty(cuts[-1])

        def put(x: np.ndarray, pieces: np.ndarray, weights: np.ndarray, length: int):
            s = name[x]
            to = slot[s]
            slot[s] += 1
            piece[to], weight[to] = pieces, weights
            goes[to] = np.where(left[x] > length, name[np.minimum(x + length, n - 1)], n)  # n is the end

        for k in range(len(found), 0, -1):  # long pieces are the likely ones
            x, pieces = found[k - 1]
            put(x, pieces, self.weight[pieces], k)
        if len(alone):
            put(alone, np.array([c[0] for c in chains]), np.array([float(self.weight[c].sum()) for c in chains]), 1)
        mass, logp = np.zeros(n + 1), np.empty(len(piece))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(left)[1:])])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            a, b = cuts[lo], cuts[hi]
            value, starts = weight[a:b] + mass[goes[a:b]], cuts[lo:hi] - a
            top = np.maximum.reduceat(value, starts)
            some = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count[lo:hi])), starts))
            mass[lo:hi] = some
            logp[a:b] = value - np.repeat(some, count[lo:hi])
        logp[cuts[:-1][count == 1]] = 0.0
        upto, with_more, j = np.exp(logp), np.flatnonzero(count > 1), 1
        while len(with_more):  # probability of a choice and those before it
            x = cuts[with_more] + j
            upto[x] += upto[x - 1]
            j += 1
            with_more = with_more[count[with_more] > j]
        upto[cuts[1:] - 1] = 2.0
        base = self.n_states
        goes = np.where(goes == n, 0, goes + base)
        unit_of = np.empty(n, np.int32)
        unit_of[name] = np.repeat(np.arange(len(units)), sizes) + number
        tails = [(int(name[x]), c) for x, c in zip(alone.tolist(), chains) if len(c) > 1]
        if tails:  # the bytes after the first are states of one choice each
            more_piece, more_goes = [], []
            for s, c in tails:
                last = cuts[s + 1] - 1
                to = int(goes[last])
                goes[last] = base + n + len(more_piece)
                more_piece += c[1:]
                more_goes += [base + n + len(more_goes) + k + 1 for k in range(len(c) - 2)] + [to]
            m = len(more_piece)
            unit_of = np.concatenate([unit_of, np.repeat(unit_of[[s for s, _ in tails]], [len(c) - 1 for _, c in tails])])
            piece, goes = np.concatenate([piece, more_piece]), np.concatenate([goes, more_goes])
            logp, upto = np.concatenate([logp, np.zeros(m)]), np.concatenate([upto, np.full(m, 2.0)])
            count = np.concatenate([count, np.ones(m, np.int64)])
            cuts = np.concatenate([cuts, cuts[-1] + 1 + np.arange(m)])

        first = cuts[name[ends - sizes]] + self.n
        goes = np.where(goes == 0, -1, cuts[np.maximum(goes - base, 0)] + self.n)
        self.piece, self.goes = grown(self.piece, self.n, piece), grown(self.goes, self.n, goes)
        self.logp, self.upto, self.cuts = grown(self.logp, self.n, logp), grown(self.upto, self.n, upto), grown(self.cuts, base + 1, cuts[1:] + self.n)
        self.unit_of = grown(self.unit_of, base, unit_of)
        self.n, self.n_states = self.n + len(piece), base + len(count)
        return first

    def state(self, choice: int) -> int:
        """The state that a choice is one of."""
        return int(np.searchsorted(self.cuts[:self.n_states + 1], choice, side="right")) - 1

    def draw(self, firsts: np.ndarray, streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(units' positions, choices) of one draw from each first choice to the end, in order of the units; each has its stream."""
        sizes, rounds = np.zeros(len(firsts), np.int64), []
        at = np.flatnonzero(firsts >= 0)
        choice = firsts[at]
        while len(at):
            upto = self.upto[choice]
            on = np.flatnonzero(upto < 2.0)  # where there is more than one choice
            u, upto = uniforms(streams[at[on]], np.uint64(len(rounds))), upto[on]
            while len(on):
                later = u >= upto
                on, u = on[later], u[later]
                next_choice = choice[on] + 1
                choice[on] = next_choice
                upto = self.upto[next_choice]
            rounds.append((at, choice))
            sizes[at] = len(rounds)
            choice = self.goes[choice]
            more = np.flatnonzero(choice >= 0)
            at, choice = at[more], choice[more]
        ends = np.cumsum(sizes)
        out = np.empty(sizes.sum(), np.int64)
        for r, (at, choice) in enumerate(rounds):
            out[ends[at] - sizes[at] + r] = choice
        return np.repeat(np.arange(len(firsts)), sizes), out


class Sample:
    """A segmentation: its choices with the unit each belongs to, and the region that it was the best of."""

    def __init__(self, owner: np.ndarray, choices: np.ndarray, fixed: int, barred: frozenset[int]):
        self.owner, self.choices, self.fixed, self.barred = owner, choices, fixed, barred


def uniforms(streams: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, each a hash of its stream and counter: the same whatever else is drawn with it."""
    with np.errstate(over="ignore"):
        return ((C.mix(streams + counters * C.GOLDEN) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def substreams(keys: np.ndarray, number: int) -> np.ndarray:
    """Streams of texts' keys, unlike for each number."""
    with np.errstate(over="ignore"):
        return C.mix(keys ^ C.mix(np.full(1, number, np.uint64)))


def gumbels(masses: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values with these locations."""
    return masses - np.log(-np.log(u))


def below(value: float, z: float) -> float:
    """A Gumbel value, given that it lies below ``value``; the order of several stays."""
    return -(max(-value, -z) + math.log1p(math.exp(-abs(value - z)))) if z > -math.inf else -math.inf


def top_k(auto: Automaton, tokens: np.ndarray, k: int, key: int) -> tuple[list[tuple[float, float, np.ndarray]], float]:
    """([(value, log probability, pieces)], value of the (k+1)-th or -inf) of the text that tokens spell."""
    return searches(auto, auto.firsts([tokens]), np.array([key], np.uint64), k)[0]


def searches(auto: Automaton, firsts: list[np.ndarray], keys: np.ndarray, k: int) -> list[tuple[list[tuple[float, float, np.ndarray]], float]]:
    """``top_k`` of texts given by the first choices of their units. Each text has its own queue and random numbers; all of them
    take a step together, so that NumPy draws and splits for all at once."""
    queues = [[(-g, 0, None)] for g in gumbels(np.zeros(len(keys)), uniforms(substreams(keys, 0), np.uint64(0))).tolist()]
    out, kappa, live, pushed = [[] for _ in firsts], [-math.inf] * len(firsts), range(len(firsts)), 0
    for j in range(k + 1):
        live = [x for x in live if queues[x]]
        taken = [heapq.heappop(queues[x]) for x in live]
        if j == k or not live:
            for x, (value, _, _) in zip(live, taken):
                kappa[x] = -value
            break
        items = draw_regions(auto, [firsts[x] for x in live], keys[live], [r for _, _, r in taken], j)
        sizes = np.array([len(s.choices) for s in items])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        choices = np.concatenate([s.choices for s in items])
        logp, pieces = auto.logp[choices], auto.piece[choices]
        before = np.empty(len(choices))
        for x, (value, _, _), a, b in zip(live, taken, starts.tolist(), ends.tolist()):
            np.cumsum(logp[a:b], out=before[a:b])
            out[x].append((-value, float(before[b - 1]) if b > a else 0.0, pieces[a:b]))
        # Regions that follow a sample up to some step and take another choice there. Their masses fall with the steps, so the
        # ``need`` best are among the first; more steps are looked at where that isn't sure.
        need, froms, width = k - j, starts + [s.fixed for s in items], np.full(len(items), STEPS)
        while True:
            tos = np.minimum(froms + width, ends)
            split = spans(froms, tos)
            split = split[logp[split] < 0]
            masses = before[split] - logp[split] + np.log(-np.expm1(logp[split]))
            cuts = np.append(np.searchsorted(split, froms), len(split)).tolist()
            unsure = []
            for x, (item, start, to, end, a, b) in enumerate(zip(items, froms.tolist(), tos.tolist(), ends.tolist(), cuts, cuts[1:])):
                if item.barred and b > a and split[a] == start:
                    c = int(item.choices[item.fixed])
                    state = auto.state(c)
                    lo = int(auto.cuts[state])
                    rest = [math.exp(v) for i, v in enumerate(auto.logp[lo:int(auto.cuts[state + 1])].tolist(), lo) if i != c and i not in item.barred]
                    masses[a] = before[start] - logp[start] + (math.log(sum(rest)) if sum(rest) > 0 else -math.inf)
                if to < end and not (b - a >= need and before[to - 1] + APART < np.partition(masses[a:b], b - a - need)[b - a - need]):
                    unsure.append(x)
            if not unsure:
                break
            width[unsure] *= 8
        steps = (split - np.repeat(starts, np.diff(cuts))).astype(np.uint64)
        z = gumbels(masses, uniforms(np.repeat(substreams(keys[live], 3 * j + 1), np.diff(cuts)), steps))
        for x, (value, _, _), item, a, b in zip(live, taken, items, cuts, cuts[1:]):
            own = z[a:b]
            likely = np.argpartition(own, len(own) - need)[-need:] if need < len(own) else np.arange(len(own))
            for i in likely[np.argsort(-own[likely], kind="stable")].tolist():
                v = below(-value, float(own[i]))
                if v > -math.inf:
                    t = int(steps[a + i])
                    barred = (item.barred if t == item.fixed else frozenset()) | {int(item.choices[t])}
                    pushed += 1
                    heapq.heappush(queues[x], (-v, pushed, (item, t, barred)))
    return list(zip(out, kappa))


def draw_regions(auto: Automaton, firsts: list[np.ndarray], keys: np.ndarray, regions: list, j: int) -> list[Sample]:
    """A draw from each text's region: the whole space (None), or what follows a sample before step t and takes none of the
    barred choices there."""
    heads, rests = [], []
    for first, region, u in zip(firsts, regions, uniforms(substreams(keys, 3 * j + 2), np.uint64(0)).tolist()):
        if region is None:
            heads.append((0, []))
            rests.append(first)
            continue
        item, t, barred = region
        state = auto.state(int(item.choices[t]))
        options = [c for c in range(int(auto.cuts[state]), int(auto.cuts[state + 1])) if c not in barred]
        upto = np.cumsum(np.exp(auto.logp[options]))
        pick = options[min(len(options) - 1, int(np.searchsorted(upto, u * upto[-1], side="right")))]
        unit = int(item.owner[t])
        heads.append((unit, [pick]))
        rests.append(first[unit:].copy())
        rests[-1][0] = auto.goes[pick]
    sizes = np.array([len(r) for r in rests])
    ends = np.cumsum(sizes)
    units = np.arange(sizes.sum()) - np.repeat(ends - sizes - [unit for unit, _ in heads], sizes)
    with np.errstate(over="ignore"):
        streams = C.mix(np.repeat(substreams(keys, 3 * j + 3), sizes) + units.astype(np.uint64) * C.GOLDEN)
    owner, choices = auto.draw(np.concatenate(rests), streams)
    cuts = np.searchsorted(owner, np.append(0, ends)).tolist()
    owner = units[owner]
    out = []
    for region, (unit, pick), a, b in zip(regions, heads, cuts, cuts[1:]):
        if region is None:
            out.append(Sample(owner[a:b], choices[a:b], 0, frozenset()))
        else:
            item, t, barred = region
            out.append(Sample(np.concatenate([item.owner[:t], [unit], owner[a:b]]), np.concatenate([item.choices[:t], pick, choices[a:b]]), t, barred))
    return out


def generator(seed: int, doc_id: int | None, text: str) -> int:
    """The key of a row's random numbers."""
    key = str(doc_id) if doc_id is not None else hashlib.sha256(text.encode()).hexdigest()
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little")


def loaded(model: bytes):
    """The worker's tokenizer for a model and its automaton, loaded once and kept until another operator's task releases it."""
    import sentencepiece

    key = hashlib.sha1(model).digest()
    if key not in C.KEPT:
        C.release()
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        C.KEPT[key] = sp, Automaton(sp)
    return C.KEPT[key]


def ids_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest()


def encoded_rows(shared, k: int, seed: int, choices: int = Automaton.CHOICES):
    """A function for mapInArrow over (doc_id, text): rank 0 is the tokenizer's encoding, 1 to k the samples. Every sequence is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, auto = loaded(shared.value)
        auto.CHOICES = choices
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows, ids_of, group, held = [], [], [], 0
            for at, text in enumerate(texts):
                group.append(at)
                held += len(text)
                if held < CHARACTERS and at + 1 < len(texts):
                    continue
                coded, firsts = auto.encode(sp, [texts[x] for x in group])
                sampled = [i for i, ids in enumerate(coded) if k and len(ids)]
                found = {}
                if sampled:
                    keys = np.array([generator(seed, docs[group[i]], texts[group[i]]) for i in sampled], np.uint64)
                    found = dict(zip([group[i] for i in sampled], searches(auto, [firsts[i] for i in sampled], keys, k)))
                for x, ids in zip(group, coded):
                    rows.append((docs[x], 0, len(ids), None, None, ids_digest(ids), sp.decode(ids) == texts[x]))
                    ids_of.append(ids)
                    if x not in found:
                        continue
                    samples, kappa = found[x]
                    for rank, (_, logp, pieces) in enumerate(samples, 1):
                        score = float(-np.expm1(-np.exp(min(700.0, logp - kappa)))) if kappa > -np.inf else 1.0
                        rows.append((docs[x], rank, len(pieces), logp, score, ids_digest(pieces), sp.decode(pieces) == texts[x]))
                        ids_of.append(pieces)
                group, held = [], 0
            types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
            cols = list(zip(*rows)) if rows else [()] * 7
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids_of])])
            arrays.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([*ids_of, np.zeros(0, np.int32)]), pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=NAMES)

    return run


NAMES = ["doc_id", "rank", "n_pieces", "log_p", "inclusion", "ids_sha256", "decodes", "ids"]
ENCODED = "doc_id long, rank int, n_pieces long, log_p double, inclusion double, ids_sha256 string, decodes boolean, ids array<int>"


def encode(docs: DataFrame, k: int = 2, seed: int = 7, model: str = MODEL, choices: int = Automaton.CHOICES) -> DataFrame:
    """One row per document and rank with its ids: 0 the tokenizer's own encoding, 1 to k distinct sampled segmentations in order of their
    perturbed value; ``decodes`` tells whether decoding the ids of the row gives the text back.
    ``choices`` bounds what a worker keeps of units and changes no row."""
    spark = C.prepared(docs)
    with open(model, "rb") as f:  # a vocabulary file of the driver; its bytes go to the tasks
        shared = spark.sparkContext.broadcast(f.read())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded_rows(shared, k, seed, choices), ENCODED)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, rank, text) of encoded rows."""
    spark = C.prepared(rows)
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = loaded(shared.value)
        for batch in batches:
            texts = [sp.decode(ids) if ids else "" for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "rank", "text"])

    return rows.select("doc_id", "rank", "ids").mapInArrow(run, "doc_id long, rank int, text string")
