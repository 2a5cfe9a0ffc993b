"""Text scores by logistic context mixing over the bits of a text.

A text is its words, A-Z in lower case, each followed by a blank, and an end mark (a blank where a word would
begin). Its bytes are spelled in the bits of a Huffman code of all training texts, and the bits are predicted one
after the other by hashed contexts of the text so far, each with the bits of the current byte that are known: its
last 2 and 4 bytes, the beginning of the word, and that beginning with the whole word before. Contexts reach
over blanks, back to the beginning of the word before. A context's slot counts zeros and ones over all training
documents. The predictors' stretched probabilities are mixed with weights that a gate chooses by how much the two
longest contexts have seen; weights learn online, in the pass that counts: each run of bits is predicted from what
the task counted before (a table that is renewed whenever the task's text has doubled, at first after each run), the
weights learn from it, and then it is counted. An adaptive map refines the mixed probability. The word's own count
among all training words, kept in a table that grows with the corpus, is mixed in last.

What is predicted for a word depends on it and the word before alone, so in a batch of texts every two words that
meet are worked off once, with their number, and scores of pairs that were met in the last batches are kept.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import slices, table, written

#: Bytes of the plain contexts, then bits of each predictor's table: those, the word's beginning, the word before with it.
LAST = (2, 4)
TABLE_BITS = (20, 21, 22, 22)
N = len(TABLE_BITS)
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])
SLOTS = int(OFFSETS[-1])
MASKS = [(1 << b) - 1 for b in TABLE_BITS]
CHUNK = 1 << 16
#: Bytes of units whose contexts are worked out together.
BLOCK = 1 << 14
#: Longer words are worked off in parts of so many bytes, each with the part before as the word before.
SEGMENT = 1 << 10
#: Bytes of text in a batch, bytes of distinct pairs worked off together.
BATCH, STEP_BYTES = 1 << 20, 12_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
BLANK_AT = re.compile(rb"[ \t-\r]")
#: Counts are kept as levels: whole up to 8, then two to an octave.
WHOLE, LEVELS = 8, 84
CONF = 6
GATES = CONF * CONF
BUCKETS = 33
#: First cells of the map by gate, eight gates to a confidence, and half a row.
CELL_OF_GATE = (np.arange(64) // 8 * BUCKETS + BUCKETS // 2).astype(np.float32)
#: Up to so many bytes, learning predicts from all that was counted; then from counts renewed as the text doubles.
EARLY = 1 << 19
LOG10_2 = float(np.log10(2.0))
LOG10_E = float(np.log10(np.e))
#: Share of a known word's own count in its probability.
WORD_SHARE = 1 / 16


def _spread(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= MIX
    x ^= x >> np.uint64(32)
    return x


def _hash(x: np.ndarray) -> np.ndarray:
    """The upper half of a context's spread number."""
    x = _spread(x)
    x >>= np.uint64(32)
    return x


NODE_HASH = (_spread((np.arange(256, dtype=np.uint64) + np.uint64(1)) * PRIME) >> np.uint64(32)).view(np.int64)
POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(SEGMENT + 1, PRIME | np.uint64(1))]))


def level_of(n: np.ndarray) -> np.ndarray:
    """Level of a count."""
    high = WHOLE + np.floor(2 * np.log2(np.maximum(n, WHOLE) / WHOLE)).astype(np.int64)
    return np.minimum(np.where(n <= WHOLE, n, high), LEVELS - 1).astype(np.int64)


#: A level's count.
COUNT_OF = np.where(np.arange(LEVELS) <= WHOLE, np.arange(LEVELS), WHOLE * 2.0 ** ((np.arange(LEVELS) - WHOLE + 0.5) / 2))


#: Level of small counts, for a look-up.
SMALL = level_of(np.arange(1 << 12))
#: A slot's counts are one number: zeros in its lower half, ones in its upper.
HALF = np.int64((1 << 32) - 1)


def predictions(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Stretched probabilities of a one after so many zeros and ones, 0 where nothing was seen; the last three bits say how sure a slot is."""
    zeros, ones = zeros.astype(np.float32), ones.astype(np.float32)
    sure = CONFIDENCE_OF.take(np.minimum(zeros + ones, np.float32(511)).astype(np.intp))
    out = np.log((ones + np.float32(0.02)) / (zeros + np.float32(0.02)))
    out += np.float32(1e-20)  # with bits in it, a bare 0 would be a denormal number, and those are slow
    bits = out.view(np.int32)
    bits &= -8
    bits |= sure
    return out


def predictions_of(counts: np.ndarray) -> np.ndarray:
    """The same of slots' counts."""
    return predictions(counts & HALF, counts >> 32)


def _levels(n: np.ndarray) -> np.ndarray:
    levels = SMALL.take(n, mode="clip")
    if len(n) and n.max() >= len(SMALL):
        big = n >= len(SMALL)
        levels[big] = level_of(n[big])
    return levels


def states_of(counts: np.ndarray) -> np.ndarray:
    """State of slots' counts: both levels in one number."""
    return _levels(counts & HALF) * LEVELS + _levels(counts >> 32)


#: How sure a context is that was seen so often.
CONFIDENCE_OF = np.searchsorted([1, 2, 5, 17, 257], np.arange(512), side="right").astype(np.int32)
#: A state's stretched probability of a one, 0 where nothing was seen, and how sure it is.
STRETCHED = np.log((np.tile(COUNT_OF, LEVELS) + 0.02) / (np.repeat(COUNT_OF, LEVELS) + 0.02)).astype(np.float32)
CONFIDENCE = CONFIDENCE_OF[np.minimum(np.tile(COUNT_OF, LEVELS) + np.repeat(COUNT_OF, LEVELS), 511).astype(np.int64)]
#: Both in one number, as in :func:`predictions`.
PREDICTED = predictions(np.repeat(COUNT_OF, LEVELS), np.tile(COUNT_OF, LEVELS))


class Code:
    """Huffman code of bytes: for each byte the inner nodes on its path, and the bits taken there."""

    def __init__(self, histogram: np.ndarray):
        self.histogram = [int(n) for n in histogram]
        heap = [(int(n) + 1, i, i) for i, n in enumerate(histogram)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (node, 0), (node, 1)
            heapq.heappush(heap, (a + b, min(i, j), node))
        paths = []
        for at in range(256):
            path = []
            while at in parent:
                at, bit = parent[at]
                path.append((at - 256, bit))
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.turn = NODE_HASH[[n for p in paths for n, _ in p]]
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)
        self.sign = np.where(self.bit == 1, np.float32(1), np.float32(-1))
        self.one = np.int64(1) << (self.bit.astype(np.int64) * 32)

    def __reduce__(self) -> tuple:
        """Made anew in each worker: arrays that were sent have types of their own, for which numpy leaves its fast paths."""
        return Code, (self.histogram,)

    def events(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each bit of the bytes: the byte's place, and the bit's in the code's own arrays; and where each byte's bits begin."""
        n = self.length.take(raw)
        begin = np.cumsum(n) - n
        of = np.repeat(np.arange(len(raw)), n)
        at = (self.start.take(raw) - begin).take(of)
        at += np.arange(len(of))
        return of, at, begin


def unit_bytes(key: bytes | None) -> bytes:
    """What a unit spells: a word with a blank, or a part of a long word, whose key begins with a blank."""
    if key is None or len(key) > SEGMENT + 1:
        return b""
    return key[1:] if key[:1] == b" " else key + b" "


def parts(word: bytes) -> list[bytes]:
    """Keys of a word's units."""
    if len(word) <= SEGMENT:
        return [word]
    cuts = [word[i : i + SEGMENT] for i in range(0, len(word), SEGMENT)]
    return [*(b" " + c for c in cuts[:-1]), cuts[-1]]


def blank_pieces(text: bytes, limit: int = BATCH) -> Iterator[bytes]:
    """The text in pieces of about ``limit`` bytes that end before a blank."""
    at = 0
    while len(text) - at > limit and (m := BLANK_AT.search(text, at + limit)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@dataclass
class Batch:
    """Words of some texts. ``keys``: distinct words and units, None first. ``words``: numbers of the words, end marks among
    them; ``doc``: their texts. ``units``, ``before``: numbers of the units and of the units before them; ``word_of``: whose they are."""

    keys: list[bytes | None]
    words: np.ndarray
    doc: np.ndarray
    units: np.ndarray
    before: np.ndarray
    word_of: np.ndarray


def batches_of(texts: list[bytes | None], limit: int = BATCH) -> Iterator[Batch]:
    """The texts' words in batches of about ``limit`` bytes; a long text goes on in the next one."""
    numbers, held, last = {None: 0}, 0, 0
    some: list[bytes] = []
    docs_: list[tuple[int, int]] = []  # a text and its words here

    def batch() -> Batch:
        for k in [k for k in dict.fromkeys(some) if k not in numbers]:
            numbers[k] = len(numbers)
        words = units = np.fromiter(map(numbers.__getitem__, some), np.int64, len(some))
        word_of = np.arange(len(some))
        if max(map(len, filter(None, numbers)), default=0) > SEGMENT:
            cut = [parts(w) for w in some]
            for k in [k for p in cut for k in p if k not in numbers]:
                numbers.setdefault(k, len(numbers))
            word_of = np.repeat(word_of, list(map(len, cut)))
            units = np.array([numbers[u] for p in cut for u in p], np.int64)
        before = np.empty_like(units)
        before[0], before[1:] = last, units[:-1]
        # a text's first word has none before it
        doc, n = np.array(docs_, np.int64).reshape(-1, 2).T
        begins = (np.cumsum(n) - n)[1:][doc[1:] != doc[:-1]]
        before[np.searchsorted(word_of, begins)] = 0
        return Batch(list(numbers), words, np.repeat(doc, n), units, before, word_of)

    for d, text in enumerate(texts):
        for piece in (*blank_pieces(text or b"", limit), None):
            if held > limit:
                yield (made := batch())
                key = made.keys[made.units[-1]] if docs_[-1][0] == d else None
                numbers, held, some, docs_ = {None: 0}, 0, [], []
                last = numbers.setdefault(key, 1)
            more = [b""] if piece is None else piece.lower().split()
            if more:
                held += len(piece or b"")
                some += more
                docs_.append((d, len(more)))
    if some:
        yield batch()


class Units:
    """What the contexts of a batch's units are made of: all units' bytes in a row, and sums over them."""

    def __init__(self, batch: Batch):
        keys = batch.keys
        size = np.fromiter(map(len, keys[1:]), np.int64, len(keys) - 1) + 1
        if size.max(initial=0) <= SEGMENT + 1:
            spelled = b" ".join(keys[1:]) + b" "
            size = np.append(0, size)
        else:
            parts_ = list(map(unit_bytes, keys))
            spelled, size = b"".join(parts_), np.fromiter(map(len, parts_), np.int64, len(keys))
        self.n, self.size = len(keys), size
        self.flat = flat = np.frombuffer(spelled, np.uint8)
        self.start = start = np.cumsum(size) - size
        # pairs go by their unit's first bytes: what is read for one is then still at hand for the next
        head = np.zeros(len(size), np.uint64)
        for j in range(8):
            has = np.flatnonzero(size > j)
            head[has] |= flat.take(start[has] + j).astype(np.uint64) << np.uint64(56 - 8 * j)
        self.by_rank = np.argsort(head)
        rank = np.empty_like(self.by_rank)
        rank[self.by_rank] = np.arange(len(size))
        #: distinct pairs as one number each, where each unit's is, and how often each is there
        self.pairs, self.where, self.times = np.unique(rank.take(batch.units) * self.n + batch.before, return_inverse=True, return_counts=True)
        value = flat.astype(np.uint64)
        value += np.uint64(1)
        inside = np.arange(len(flat))
        inside -= np.repeat(start, size)
        # a polynomial of the unit's bytes before each place, from running sums
        terms = value * POWERS.take(inside)
        sums = np.cumsum(terms, dtype=np.uint64)
        sums -= terms
        whole = np.zeros(len(size), np.uint64)
        some = np.flatnonzero(size)
        whole[some] = _spread(np.add.reduceat(terms, start[some]) * PRIME + np.uint64(8))
        self.whole = whole
        sums -= np.repeat(sums[np.minimum(start, len(flat) - 1)], size)
        sums *= PRIME
        sums += inside.view(np.uint64)
        sums += np.uint64(5)
        beginning = _spread(sums)
        # last bytes within the unit, and those of the unit before that come before them
        most = max(LAST)
        self.power = power = np.uint64(257) ** np.arange(most + 1, dtype=np.uint64)
        self.own, sofar = {}, np.zeros(len(flat), np.uint64)
        for j in range(1, most + 1):
            for a in range(j, len(flat), BLOCK):
                b = min(a + BLOCK, len(flat))
                more = value[a - j : b - j] * power[j - 1]
                more *= inside[a:b] >= j
                sofar[a:b] += more
            if j in LAST:
                self.own[j] = sofar.copy() if j < most else sofar
        self.tail = tail = np.zeros((most + 1, len(size)), np.uint64)
        for j in range(1, most + 1):
            has = np.flatnonzero(size >= j)
            tail[j] = tail[j - 1]
            tail[j, has] += value.take(start[has] + size[has] - j) * power[j - 1]
        # what a unit's bytes have for contexts if none reaches into the unit before
        self.alone = alone = np.empty((len(flat), N), np.uint64)
        for a in range(0, len(flat), BLOCK):
            for o, k in enumerate(LAST):
                last = self.own[k][a : a + BLOCK] * PRIME
                last += np.uint64(k)
                alone[a : a + BLOCK, o] = _hash(last)
        alone[:, N - 1] = beginning * PRIME
        beginning >>= np.uint64(32)  # spread already
        alone[:, N - 2] = beginning

    def split(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units before and units of pairs."""
        right, left = np.divmod(pairs, self.n)
        return left, self.by_rank.take(right)


def contexts(units: Units, pairs: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of pairs: which, their bytes, where each pair's begin, and the hashes of the bytes' contexts (predictors x bytes)."""
    left, right = units.split(pairs)
    length, from_all = units.size.take(right), units.start.take(right)
    ends = np.cumsum(length)
    before = units.whole + np.uint64(7)
    most = max(LAST)
    a = 0
    while a < len(pairs):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, side="right")))
        length_, left_, from_ = length[a:b], left[a:b], from_all[a:b]
        first = np.cumsum(length_) - length_
        at = np.repeat(from_ - first, length_)
        at += np.arange(len(at))
        out = units.alone.take(at, axis=0)
        source, of_left, to = from_, left_, first
        for j in range(most):
            if j:
                has = np.flatnonzero(length_ > j)
                source, of_left, to = from_.take(has) + j, left_.take(has), first.take(has) + j
            for o, k in enumerate(LAST):
                if j < k:
                    last = units.tail[k - j].take(of_left)
                    last *= units.power[j]
                    last += units.own[k].take(source)
                    last *= PRIME
                    last += np.uint64(k)
                    out[to, o] = _hash(last)
        out[:, N - 1] = _hash(out[:, N - 1] + np.repeat(before.take(left_), length_))
        yield slice(a, b), units.flat.take(at), first, np.ascontiguousarray(out.T).view(np.int64)
        a = b


def slots_of(hashes: np.ndarray, of: np.ndarray, turn: np.ndarray) -> list[np.ndarray]:
    """The bits' slots in each predictor's table."""
    out = []
    for h, mask in zip(hashes, MASKS, strict=True):
        s = h.take(of)
        s ^= turn
        s &= mask
        out.append(s)
    return out


def no_counts() -> list[np.ndarray]:
    """For each predictor zeros and ones of every slot."""
    return [np.zeros(1 << bits, np.int64) for bits in TABLE_BITS]


@dataclass
class BitMixer:
    """Code, gated weights and the refining map."""

    code: Code
    weights: np.ndarray  # predictors x gates
    refine: np.ndarray  # confidence x buckets, probabilities
    rate: float = 0.02
    refine_rate: float = 1e-4
    seen: np.ndarray = field(default_factory=lambda: np.full((N, GATES), 1.0))
    tables: list[np.ndarray] | None = None  # what learning predicts from
    known: int = 0  # bytes counted when all of them were made
    size: int = 0  # bytes counted

    @classmethod
    def fresh(cls, code: Code) -> BitMixer:
        grid = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 2.0))
        return cls(code, np.full((N, GATES), 0.3), np.tile(grid, (CONF, 1)))

    def mixed(self, st: list[np.ndarray], conf: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gates, mixed stretch, and the map's cells, of bits with these stretched predictions and confidences of the last two."""
        gate = conf * CONF + other
        weights = self.weights.astype(np.float32)
        x = st[0] * weights[0].take(gate)
        for o in range(1, N):
            x += st[o] * weights[o].take(gate)
        np.clip(x, -20, 20, out=x)
        bucket = np.clip(np.rint(x * 2), -(BUCKETS // 2), BUCKETS // 2).astype(np.int64)
        return gate, x, conf * BUCKETS + bucket + BUCKETS // 2

    def probability(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Of a one; the map knows little about the ends of the scale, where the mixed probability stands alone."""
        p = 1 / (1 + np.exp(-x))
        p = np.where(np.abs(x) < 7, (p + self.refine.astype(np.float32).ravel().take(cell)) / 2, p)
        return np.clip(p, np.float32(1e-7), np.float32(1 - 1e-7))

    def mix(self, st: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gates (eight to a confidence) and mixed stretch of bits with these predictions."""
        gate = st[-2].view(np.int32) & 7
        gate *= 8
        gate += st[-1].view(np.int32) & 7
        gate = gate.astype(np.intp)
        wide = np.zeros((N, 8, 8), np.float32)
        wide[:, :CONF, :CONF] = self.weights.reshape(N, CONF, CONF)
        x = np.zeros(len(gate), np.float32)
        for w, s in zip(wide.reshape(N, 64), st, strict=True):
            part = w.take(gate)
            part *= s
            x += part
        np.minimum(x, np.float32(20), out=x)
        np.maximum(x, np.float32(-20), out=x)
        return gate, x

    def cells(self, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The map's cells."""
        b = x * np.float32(2)
        np.rint(b, out=b)
        np.minimum(b, np.float32(BUCKETS // 2), out=b)
        np.maximum(b, np.float32(-(BUCKETS // 2)), out=b)
        b += CELL_OF_GATE.take(gate)
        return b.astype(np.intp)

    def learn(self, batch: Batch, counts: list[np.ndarray]) -> None:
        """Predict the batch run by run from counts of what came before, learn from each run, then count it."""
        units = Units(batch)
        order = np.argsort(units.times > 1, kind="stable")  # most runs then hold pairs that are there once
        pairs, times = units.pairs[order], units.times[order]
        if self.tables is None:
            self.tables = [np.zeros(len(c), np.float32) for c in counts]
        for which, raw, first, hashes in contexts(units, pairs):
            of, at, begin = self.code.events(raw)
            slots = slots_of(hashes, of, self.code.turn.take(at))
            st = [t.take(s) for t, s in zip(self.tables, slots, strict=True)]
            gate, x = self.mix(st)
            cell = self.cells(gate, x)
            sign = self.code.sign.take(at)
            # bit - p is the sign times the probability of the other bit
            x *= sign
            np.exp(x, out=x)
            x += 1
            err = np.divide(sign, x, out=x)
            add = self.code.one.take(at)
            cell *= 2
            cell += self.code.bit.take(at)
            if times[which.stop - 1] == 1:
                hits = np.bincount(cell, minlength=2 * CONF * BUCKETS)
            else:
                many = np.repeat(times[which], np.diff(np.append(begin.take(first), len(of))))
                err *= many
                add *= many
                hits = np.bincount(cell, many, 2 * CONF * BUCKETS)
            step = np.stack([np.bincount(gate, x * err, 64) for x in st]).reshape(N, 8, 8)[:, :CONF, :CONF].reshape(N, GATES)
            self.seen += step * step
            self.weights += self.rate * step / np.sqrt(self.seen)
            ones, hits = hits[1::2], hits[::2] + hits[1::2]
            chance = self.refine.ravel()
            chance += (ones / np.maximum(hits, 1) - chance) * (1 - (1 - self.refine_rate) ** hits)
            for c, t in zip(counts, slots, strict=True):
                np.add.at(c, t, add)
            self.size += int(times[which] @ np.diff(np.append(first, len(raw))))
            self.renew(counts, slots)

    def renew(self, counts: list[np.ndarray], slots: list[np.ndarray]) -> None:
        """Predict from the counts as they are: at first the slots just counted, later all, each time the text has doubled."""
        if not self.known:
            for t, c, s in zip(self.tables, counts, slots, strict=True):
                t[s] = predictions_of(c.take(s))
            self.known = self.size if self.size >= EARLY else 0
        elif self.size >= 2 * self.known:
            for t, c in zip(self.tables, counts, strict=True):
                for i in range(0, len(c), CHUNK):
                    t[i : i + CHUNK] = predictions_of(c[i : i + CHUNK])
            self.known = self.size

    def log10(self, batch: Batch, states: list[np.ndarray]) -> np.ndarray:
        """log10 of each word's probability where it stands, the blank after it included, from all slots' states."""
        return self.log10_of(batch, [PREDICTED.take(t) for t in states])

    def log10_of(self, batch: Batch, tables: list[np.ndarray], known: Known | None = None) -> np.ndarray:
        """The same from the slots' predictions; what ``known`` has from other batches isn't worked out again."""
        units = Units(batch)
        pairs = units.pairs
        out = np.zeros(len(pairs))
        new = np.arange(len(pairs))
        if known:
            names = known.names(units, pairs)
            new = known.look_up(names, out)
        centred = self.refine.astype(np.float32).ravel() - np.float32(0.5)
        for which, raw, first, hashes in contexts(units, pairs[new]):
            of, at, begin = self.code.events(raw)
            slots = slots_of(hashes, of, self.code.turn.take(at))
            gate, x = self.mix([t.take(s) for t, s in zip(tables, slots, strict=True)])
            map_ = centred.take(self.cells(gate, x))
            sign = self.code.sign.take(at)
            map_ *= sign
            map_ += np.float32(0.5)
            end = np.flatnonzero(np.abs(x) >= 7)
            # the probability of the bit that is there, as in probability()
            x *= sign
            np.negative(x, out=x)
            p = np.exp(x, out=x)
            p += 1
            np.reciprocal(p, out=p)
            map_ += p
            map_ *= np.float32(0.5)
            map_[end] = p[end]
            np.maximum(map_, np.float32(1e-7), out=map_)
            np.log(map_, out=map_)
            out[new[which]] = np.add.reduceat(map_, begin.take(first))
        if known:
            known.add(names[new], out[new])
        return np.bincount(batch.word_of, out[units.where] * LOG10_E, len(batch.words))


class Known:
    """Scores of the pairs that were met last, by a hash of 64 bits; a pair takes the place of another one."""

    def __init__(self, bits: int = 20):
        self.mask = np.uint64((1 << bits) - 1)
        self.held, self.score = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)

    def names(self, units: Units, pairs: np.ndarray) -> np.ndarray:
        left, right = units.split(pairs)
        return _spread(units.whole.take(left) * PRIME + units.whole.take(right)) | np.uint64(1 << 63)

    def look_up(self, names: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Fills in the scores that are there; the others' places."""
        at = (names & self.mask).view(np.int64)
        there = self.held.take(at) == names
        out[there] = self.score.take(at[there])
        return np.flatnonzero(~there)

    def add(self, names: np.ndarray, scores: np.ndarray) -> None:
        at = (names & self.mask).view(np.int64)
        # of pairs with one place the last one stays in both arrays
        self.score[at] = scores
        self.held[at] = names


def remainder(doc_id: int | None, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def count_words(docs: DataFrame, modulus: int, held: int, flush: int = 400_000) -> DataFrame:
    """(word, c, n): times in training documents and in all; the end mark is the empty word. Pre-aggregated in each task."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rest = Counter(), Counter()

        def out():
            names = list({**known, **rest})
            c = np.array([known[w] for w in names], np.int64)
            n = c + np.array([rest[w] for w in names], np.int64)
            known.clear()
            rest.clear()
            return table(schema, pa.array(names, pa.binary()).cast(pa.string()), c, n)

        for batch in slices(batches, limit=BATCH):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                to = rest if remainder(doc, modulus) == held else known
                to[b""] += 1
                for piece in blank_pieces(text or b""):
                    to.update(piece.lower().split())
                    if len(known) + len(rest) > flush:
                        yield out()
        if known or rest:
            yield out()

    partial = docs.mapInArrow(count, "word string, c long, n long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def byte_histogram(vocabulary: DataFrame) -> np.ndarray:
    """How often each byte stands in the training words and behind them."""
    schema = pa.schema([("byte", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in slices(batches, "word"):
            words = [w + b" " for w in batch.column(0).cast(pa.binary()).to_pylist()]
            lens = np.fromiter(map(len, words), np.int64, len(words))
            many = np.repeat(batch.column(1).to_numpy(), lens)
            total += np.bincount(np.frombuffer(b"".join(words), np.uint8), many, 256).astype(np.int64)
        yield table(schema, range(256), total)

    out = np.zeros(256, np.int64)
    for r in vocabulary.filter("c > 0").select("word", "c").mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        out[r.byte] = r.n
    return out


def short(counts: np.ndarray) -> bytes:
    """Slots' counts as bytes: one each for zeros and ones, and the places and counts of those with more."""
    both = np.stack([counts & HALF, counts >> 32])
    more = np.flatnonzero((both > 255).any(0))
    return np.minimum(both, 255).astype(np.uint8).tobytes() + more.astype("<i4").tobytes() + both[:, more].astype("<i8").tobytes()


def long(data: bytes) -> np.ndarray:
    """(zeros, ones) of :func:`short`."""
    out = np.frombuffer(data, np.uint8, 2 * CHUNK).reshape(2, CHUNK).astype(np.int64)
    n = (len(data) - 2 * CHUNK) // 20
    out[:, np.frombuffer(data, "<i4", n, 2 * CHUNK)] = np.frombuffer(data, "<i8", 2 * n, 2 * CHUNK + 4 * n).reshape(2, n)
    return out


def learn_contexts(docs: DataFrame, code: Code, modulus: int, held: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """States of all slots over all training documents, and the weights and map learnt on the way.

    Each task passes once over its training documents and counts into tables of fixed size; the tables' chunks are added
    up by chunk, and the driver gets one table of states, ``2 * SLOTS`` bytes. The tasks' weights and maps are averaged
    by the bytes they learnt from. Two tasks for each core, so that what they write is bounded too.
    """
    schema = pa.schema([("chunk", pa.int32()), ("n", pa.int64()), ("counts", pa.binary()), ("weights", pa.binary()), ("refine", pa.binary())])
    spelled = "chunk int, n long, counts binary, weights binary, refine binary"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mixer, size, held_bytes = no_counts(), BitMixer.fresh(code), 0, 0

        def chunks() -> Iterator[pa.RecordBatch]:
            for o, c in enumerate(counts):
                for at in range(0, len(c), CHUNK):
                    part = c[at : at + CHUNK]
                    if part.any():
                        yield table(schema, [(int(OFFSETS[o]) + at) // CHUNK], [0], [short(part)], [None], [None])
                c[:] = 0

        for batch in slices(batches, limit=BATCH):
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            known = [t for d, t in zip(docs_, texts, strict=True) if remainder(d, modulus) != held]
            size += sum(len(t or b"") + 1 for t in known)
            for some in batches_of(known):
                mixer.learn(some, counts)
                held_bytes += 2 * BATCH
                if held_bytes > 1 << 28:  # before a count can leave its half, also where bits of a byte share a slot
                    yield from chunks()
                    held_bytes = 0
        if size:
            yield from chunks()
            yield table(schema, [-1], [size], [None], [mixer.weights.tobytes()], [mixer.refine.tobytes()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros, ones = {}, {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = long(data)
                zeros[k] = zeros.get(k, 0) + got[0]
                ones[k] = ones.get(k, 0) + got[1]
        for k in zeros:
            states = (level_of(zeros[k]) * LEVELS + level_of(ones[k])).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([states.tobytes()], pa.binary())], names=["chunk", "states"])

    parts = written(docs.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(learn, spelled), "contexts")
    states = np.zeros(SLOTS, np.uint16)
    sums = parts.filter("chunk >= 0").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, states binary")
    for r in sums.toLocalIterator():
        got = np.frombuffer(r.states, np.uint16)
        states[r.chunk * CHUNK : r.chunk * CHUNK + len(got)] = got
    fresh = BitMixer.fresh(code)
    learnt = sorted(parts.filter("chunk < 0").select("n", "weights", "refine").collect(), key=lambda r: (r.n, bytes(r.weights)))  # one row a task
    tables = [states[a:b] for a, b in zip(OFFSETS[:-1], OFFSETS[1:], strict=True)]
    if not learnt:
        return tables, fresh.weights, fresh.refine
    share = np.array([r.n for r in learnt]) / sum(r.n for r in learnt)
    weights, refine = (np.tensordot(share, [np.frombuffer(r[k]).reshape(x.shape) for r in learnt], 1) for k, x in (("weights", fresh.weights), ("refine", fresh.refine)))
    return tables, weights, refine


def packed(states: list[np.ndarray]) -> bytes:
    """Compressed: every node keeps broadcast values on its disk."""
    return pa.compress(np.concatenate(states), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    states = np.frombuffer(pa.decompress(data, 2 * SLOTS, codec="zstd"), np.uint16)
    return [states[a:b] for a, b in zip(OFFSETS[:-1], OFFSETS[1:], strict=True)]


def with_count(lm: np.ndarray, c: np.ndarray, total: int) -> np.ndarray:
    """log10 of a word's probability from the bits', mixed with its share of all training words."""
    a = lm + np.log10(1 - WORD_SHARE)
    b = np.log10(np.maximum(c, 1) * (WORD_SHARE / max(total, 1)))
    return np.where(c > 0, np.logaddexp(a / LOG10_E, b / LOG10_E) * LOG10_E, a)


def with_count_column(lm, c, total: int):
    """The same for columns."""
    a = lm + float(np.log10(1 - WORD_SHARE))
    b = F.log10(c * (WORD_SHARE / max(total, 1)))
    most = F.greatest(a, b)
    return F.when(c > 0, most + F.log10(1 + F.pow(F.lit(10.0), F.least(a, b) - most))).otherwise(a)


#: What a worker keeps from one task to the next.
_KEPT: dict[str, tuple] = {}


def kept(name: str, make: Callable[[], tuple]) -> tuple:
    """What ``make`` gives, made once in a worker; only the last one asked for stays."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def score_texts(docs: DataFrame, modulus: int = 7, held: int = 2, hot_words: int = 1 << 16) -> DataFrame:
    """Scores of whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from documents whose crc32(doc_id as text) mod ``modulus`` is not ``held`` (a null id counts as
    empty text). base_score adds log10((c+1)/(N+V+1)) over words and end mark; score is the mixed model's log10
    probability of the text. A null text counts as empty: its end mark is its only token. Repeated rows are scored
    each, an empty table gives an empty result, a word of any length is one word, a very long text is worked off in
    batches, and other columns are not read.

    The ``hot_words`` most frequent words travel to all tasks as one bounded table, so a frequent word never
    makes a hot key; all others are joined by word, a row for each place of one in a document.
    """
    spark: SparkSession = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    vocabulary = written(count_words(plain, modulus, held), "words")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    code = Code(byte_histogram(vocabulary))
    states, weights, refine = learn_contexts(plain, code, modulus, held)
    contexts_ = spark.sparkContext.broadcast(packed(states))
    top = vocabulary.orderBy(F.desc("n"), "word").limit(hot_words).toArrow()
    hot = spark.sparkContext.broadcast((top["word"].cast(pa.binary()).to_pylist(), top["c"].to_numpy()))
    name = uuid.uuid4().hex
    # a row for each batch of a document with its hot words' sums (its key holds a blank, so no word), and one for each place of another word
    line = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lm", pa.float64()), ("bytes", pa.int64())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def make() -> tuple:
            names, hot_counts = hot.value
            return {w: i for i, w in enumerate(names)}, hot_counts, BitMixer(code, weights, refine), [PREDICTED.take(t) for t in unpacked(contexts_.value)], Known()

        number, hot_counts, mixer, tables, known = kept(name, make)
        first = TaskContext.get().partitionId() << 40
        for batch in slices(batches, limit=BATCH):
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for some in batches_of(texts):
                lm = mixer.log10_of(some, tables, known)
                at = np.fromiter((number.get(k, -1) for k in some.keys), np.int64, len(some.keys))
                c = np.where(at >= 0, hot_counts[at] if len(hot_counts) else 0, -1)[some.words]
                size = np.fromiter((0 if k is None else len(k) + 1 for k in some.keys), np.int64, len(some.keys))[some.words]
                here, doc = c >= 0, some.doc
                sums = lambda x, w=None, doc=doc: np.bincount(doc, x if w is None else np.where(w, x, 0), len(texts))
                n = np.bincount(doc, minlength=len(texts))
                which = np.flatnonzero(n)
                heads = (first + which, pa.array([docs_[i] for i in which], pa.int64()), [" "] * len(which), n[which], sums(c > 0)[which].astype(np.int64), sums(np.log10(np.maximum(c, 0) + 1.0), here)[which], sums(with_count(lm, c, tokens), here)[which], sums(size)[which].astype(np.int64))
                yield table(line, *heads)
                rest = np.flatnonzero(~here)
                if len(rest):
                    spelled = pa.array([None if k is None else k for k in some.keys], pa.binary()).take(pa.array(some.words[rest])).cast(pa.string())
                    none = pa.nulls(len(rest), pa.int64())
                    yield table(line, first + doc[rest], none, spelled, none, none, pa.nulls(len(rest), pa.float64()), lm[rest], none)
            first += len(texts)

    lines = plain.mapInArrow(look_up, "row long, doc_id long, word string, n long, known long, base double, lm double, bytes long")
    joined = lines.join(vocabulary.select("word", "c"), "word", "left")
    head = F.col("n").isNotNull()
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.when(head, F.col("known")).otherwise(F.when(F.col("c") > 0, 1).otherwise(0))).alias("n_known"),
        F.sum(F.when(head, F.col("base")).otherwise(F.log10(F.col("c") + 1))).alias("base"),
        F.sum(F.when(head, F.col("lm")).otherwise(with_count_column(F.col("lm"), F.col("c"), int(tokens)))).alias("score"),
        F.sum("bytes").alias("n_bytes"),
    )
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return sums.select(
        "doc_id",
        (F.pmod(F.crc32(text_id), F.lit(modulus)) == held).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") / LOG10_2 / F.col("n_bytes")).alias("bits_per_byte"),
    )
