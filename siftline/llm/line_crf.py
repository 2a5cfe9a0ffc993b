"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of letters, signs and repeats in it and in the
lines before and after it; transitions tie neighbouring labels. Lines have no labels of their own, only documents
have: the field begins with each line carrying its document's label, and then lines' labels are hidden. In turns,
their expectation is taken under the field, tilted in each document just so far that its share of good text agrees
with its label, and the field is fitted to these expectations, so good documents may hold bad lines, bad ones good
lines, and transitions learn both staying and changing. Forward-backward marginals, weighted by line length, give a
share of good text, which a logistic curve fitted on the same sample turns into the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import slices, table

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SETS = (b"#*$%&<>", b"|", b"!?", UPPER, LOWER, b"0123456789", b".,;:", b" \t\r\x0b\x0c")
N_LINE = len(SETS) + 6


def line_matrix(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text's lines (lines x N_LINE) and their lengths in bytes; a text without a word is one empty line."""
    lines = [x for x in text.encode().split(b"\n") if x.strip()] or [b""]
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    rows = []
    for x in lines:
        n = max(1, len(x))
        words = x.split()
        m = max(1, len(words))
        shares = [(len(x) - len(x.translate(None, s))) / n for s in SETS]
        shares[0] *= 5
        shares[1] *= 5
        shares[2] *= 5
        rows.append([*shares, float(x[-1:] in (b".", b"!", b"?", b'"', b":")), float(seen[x] > 1), 1 - len(set(words)) / m, sum(map(len, words)) / m / 10, np.log1p(len(words)) / 5, 1.0])
    return np.array(rows, np.float32), np.array([max(1, len(x)) for x in lines], np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and after (zeros at the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    return np.hstack([x, before, after])


@dataclass
class LineField:
    weights: np.ndarray  # of a line's being good
    moves: np.ndarray  # 2 x 2, from label to label
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, docs: list[np.ndarray], tilts: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], float, np.ndarray]:
        """For each document P(good) of its lines; the log-partition summed; expected moves. ``tilts`` are added to lines' scores."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        size = np.array([len(docs[i]) for i in order])
        begin = np.cumsum(size) - size
        emit = np.concatenate([docs[i] for i in order]) @ self.weights if docs else np.zeros(0)
        if tilts is not None and docs:
            emit = emit + np.concatenate([tilts[i] for i in order])
        alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) if len(size) else 0)]
        fwd = np.zeros((len(emit), 2))
        for t, n in enumerate(alive):
            at = begin[:n] + t
            e = np.stack([np.zeros(n), emit[at]], 1)
            fwd[at] = e if t == 0 else e + np.logaddexp(fwd[at - 1][:, 0, None] + self.moves[0], fwd[at - 1][:, 1, None] + self.moves[1])
        bwd = np.zeros((len(emit), 2))
        expected = np.zeros((2, 2))
        last = begin + size - 1
        log_z = np.logaddexp(fwd[last, 0], fwd[last, 1])
        for t in range(len(alive) - 1, 0, -1):
            n = alive[t]
            at = begin[:n] + t
            ahead = np.stack([np.zeros(n), emit[at]], 1) + bwd[at]
            joint = fwd[at - 1][:, :, None] + self.moves[None] + ahead[:, None, :]
            expected += np.exp(joint - log_z[:n, None, None]).sum(0)
            bwd[at - 1] = np.logaddexp(self.moves[:, 0] + ahead[:, 0, None], self.moves[:, 1] + ahead[:, 1, None])
        both = fwd + bwd
        good = np.exp(both[:, 1] - np.repeat(log_z, size))
        out: list[np.ndarray] = [good] * len(docs)
        for k, i in enumerate(order):
            out[i] = good[begin[k] : begin[k] + size[k]]
        return out, float(log_z.sum()), expected

    def share(self, docs: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean of P(good) over a document's lines."""
        return np.array([p @ w / w.sum() for p, w in zip(self.marginals(docs)[0], lengths, strict=True)])

    def score(self, docs: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * self.share(docs, lengths) + self.curve[1])))


#: The share of good text that a label asks for: at most this in a bad document, at least that in a good one.
SHARES = (0.4, 0.8)


def tilts_of(field: LineField, docs: list[np.ndarray], lengths: list[np.ndarray], label: int, rounds: int = 12) -> list[np.ndarray]:
    """What to add to lines' scores, by their share of the document's length, so that its share of good text agrees with its label.

    Zero for documents that agree by themselves; the least that is needed, by bisection, for the others.
    """
    part = [w / w.sum() for w in lengths]
    share = lambda by, some: np.array([p @ part[i] for p, i in zip(field.marginals([docs[i] for i in some], [by[i] * part[i] * len(part[i]) for i in some])[0], some, strict=True)])
    sign = 1.0 if label else -1.0
    by = np.zeros(len(docs))
    off = np.flatnonzero(sign * (share(by, range(len(docs))) - SHARES[label]) < 0)
    low, high = np.zeros(len(docs)), np.full(len(docs), 30.0)
    for _ in range(rounds if len(off) else 0):
        middle = (low + high) / 2
        by[off] = sign * middle[off]
        short = sign * (share(by, off) - SHARES[label]) < 0
        low[off[short]] = middle[off[short]]
        high[off[~short]] = middle[off[~short]]
    by[off] = sign * high[off]
    return [b * p * len(p) for b, p in zip(by, part, strict=True)]


def fit_field(docs: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, steps: int = 80, turns: int = 3, turn_steps: int = 25, rate: float = 0.1, l2: float = 1e-3) -> LineField:
    """Likelihood by Adam: with lines' labels given first, then with their expectations in ``turns``; the curve by Newton's method.

    Both labels weigh the same in the sum, however rare one is. Without both labels all scores are their share.
    """
    n = 3 * N_LINE
    field = LineField(np.zeros(n), np.zeros((2, 2)))
    if not len(docs):
        field.curve = (0.0, 0.0)
        return field
    good = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    if labels.min() == labels.max():
        field.curve = (0.0, 6.0 if labels[0] else -6.0)
        return field
    by = [np.flatnonzero(labels == y) for y in (0, 1)]
    groups = [[docs[i] for i in at] for at in by]
    group_lengths = [[lengths[i] for i in at] for at in by]
    lines = [np.concatenate(g) for g in groups]
    part = [0.5 / len(x) for x in lines]  # of each line
    theta = np.zeros(n + 4)

    def climb(theta: np.ndarray, wanted: list[tuple[np.ndarray, np.ndarray]], count: int, rate: float) -> np.ndarray:
        """Steps towards expected labels and moves of both groups."""
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, count + 1):
            field.weights, field.moves = theta[:n], theta[n:].reshape(2, 2)
            g = -l2 * theta
            for y in (0, 1):
                p, _, expected = field.marginals(groups[y])
                g[:n] += part[y] * (lines[y].T @ (wanted[y][0] - np.concatenate(p)))
                g[n:] += part[y] * (wanted[y][1] - expected).ravel()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field.weights, field.moves = theta[:n], theta[n:].reshape(2, 2)
        return theta

    given = []
    for y in (0, 1):
        moved = np.zeros((2, 2))
        moved[y, y] = sum(len(d) - 1 for d in groups[y])
        given.append((np.full(len(lines[y]), float(y)), moved))
    theta = climb(theta, given, steps, rate)
    for _ in range(turns):
        hidden = []
        for y in (0, 1):
            p, _, moved = field.marginals(groups[y], tilts_of(field, groups[y], group_lengths[y], y))
            hidden.append((np.concatenate(p), moved))
        theta = climb(theta, hidden, turn_steps, rate / 4)
    x = np.stack([field.share(docs, lengths), np.ones(len(docs))], 1)
    c = np.array([0.0, np.log(good / (1 - good))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        c = c + np.linalg.solve(hess, x.T @ (labels - p) - 1e-2 * c)
    field.curve = (float(c[0]), float(c[1]))
    return field


def training_ids(labels: DataFrame, modulus: int, held: int, most: int) -> DataFrame:
    """(doc_id, quality) of at most ``most`` labelled documents to learn from, those of least hash."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("doc_id is not null and quality is not null")
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != held)
    return known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, most: int = 3000, most_lines: int = 200_000) -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Learns from labels whose crc32(doc_id as text) mod ``modulus`` is not ``held``, from at most ``most`` documents
    with ``most_lines`` lines together, those of least hash first and none with a tenth of these lines: the documented
    bounds of the sample. A null text counts as empty; an empty one is one empty line; a very long one is scored line
    by line like any other. A null doc_id counts as empty text in the crc. Labels without a value aren't read; of
    several for a document the greatest holds. Repeated rows are scored each, an empty table gives an empty result,
    other columns are not read, and without labels every score is 0.5.
    """
    # at most ``most`` rows of two numbers are broadcast
    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(training_ids(labels, modulus, held, most)), "doc_id")
    made = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("n", pa.int64()), ("lines", pa.binary()), ("lengths", pa.binary())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text, quality in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (text or "").count("\n") < most_lines // 10:
                    x, w = line_matrix(text or "")
                    rows.append((doc, quality, len(w), x.tobytes(), w.tobytes()))
            if rows:
                yield table(made, *zip(*rows, strict=True))

    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # of a repeated id one row, so the bound holds
    found = sample.select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality int, n long, lines binary, lengths binary")
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of at most ``most`` rows
    rows = found.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") <= most_lines).select("quality", "lines", "lengths").collect()
    rows.sort(key=lambda r: (r.quality, bytes(r.lines)))
    lengths = [np.frombuffer(r.lengths) for r in rows]
    field = fit_field([with_neighbours(np.frombuffer(r.lines, np.float32).reshape(-1, N_LINE)) for r in rows], lengths, np.array([r.quality for r in rows]))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [line_matrix(t or "") for t in batch.column(1).to_pylist()]
            s = field.score([with_neighbours(x) for x, _ in both], [w for _, w in both])
            out = [zlib.crc32(b"" if d is None else str(d).encode()) % modulus == held for d in batch.column(0).to_pylist()]
            yield table(schema, batch.column(0), out, s, (s >= 0.5).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
