"""Mixing documents to target weights of domains, with soft membership.

A classifier fitted on a bounded sample of labelled documents gives each document a posterior over
domains (combinations of label columns). Nonnegative rates, how often a document is to be seen, are then
fitted so that expected tokens of each domain, sum of rate * tokens * posterior, meet the targets: least
squares by projected gradient over all documents. A step's metric is the inverse of the domains' overlap
among the documents that are free to move, so that small domains converge as fast as large ones; of several
step lengths the best is taken. A document's rate follows from its posterior and the steps so far, so an
iteration sends a few numbers out and gets a few numbers back, and a lost executor's rates are computed again.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField

from siftline.llm.common import columns_of, fresh, from_texts, quoted, slices, table, written

BUCKETS = 1 << 14
SETS = (b"#*$%&<>", b"|", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:")
N_SHARES = len(SETS) + 3
#: Step lengths that an iteration tries.
LENGTHS = (1.0, 0.5, 0.25, 1 / 16, 1 / 256)
#: Label columns whose combinations are the domains, and production targets: share of tokens for (quality, toxic).
LABELS = ("quality", "toxic")
TARGETS = {(1, 0): 0.944, (1, 1): 0.05, (0, 0): 0.005, (0, 1): 0.001}


def features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a text's distinct words, shares of signs and repeats, and its number of words."""
    raw = text.encode()
    words = raw.lower().split()
    distinct = {w.strip(b".,;:!?\"'()") for w in words}
    at = np.unique(np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in distinct), np.int64, len(distinct)))
    n = max(1, len(raw))
    shares = [5 * (len(raw) - len(raw.translate(None, s))) / n for s in SETS]
    shares += [1 - len(distinct) / max(1, len(words)), float(len(words) < 10), 1.0]
    return at, np.array(shares), len(words)


class DomainClassifier:
    """Multinomial logistic regression on word buckets (each over the root of their number) and shares."""

    def __init__(self, n_domains: int):
        self.words = np.zeros((BUCKETS, n_domains))
        self.shares = np.zeros((N_SHARES, n_domains))

    def posterior(self, docs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        if not docs:
            return np.zeros((0, self.words.shape[1]))
        z = np.stack([s for _, s, _ in docs]) @ self.shares
        sizes = np.array([len(a) for a, _, _ in docs])
        if sizes.sum():
            rows = self.words[np.concatenate([a for a, _, _ in docs])]
            some = sizes > 0
            z[some] += np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[some], axis=0) / np.sqrt(sizes[some])[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray, int]], y: np.ndarray, steps: int = 80, rate: float = 0.2, l2: float = 3e-4) -> None:
        """Maximum likelihood by Adam on all sampled documents at once; no domain without samples gets a posterior of note."""
        if not docs:
            return
        target = np.eye(self.words.shape[1])[y]
        flat = np.concatenate([a for a, _, _ in docs])
        sizes = np.array([len(a) for a, _, _ in docs])
        of = np.repeat(np.arange(len(docs)), sizes)
        scale = 1 / np.sqrt(np.maximum(sizes, 1))[:, None]
        shares = np.stack([s for _, s, _ in docs])
        state = [np.zeros_like(x) for x in (self.words, self.words, self.shares, self.shares)]
        for step in range(1, steps + 1):
            err = (target - self.posterior(docs)) / len(docs)
            g_words = np.stack([np.bincount(flat, weights=(err * scale)[of, k], minlength=BUCKETS) for k in range(err.shape[1])], 1) - l2 * self.words / 10
            g_shares = shares.T @ err - l2 / 100 * self.shares
            for k, (w, g) in enumerate(((self.words, g_words), (self.shares, g_shares))):
                m, v = state[2 * k], state[2 * k + 1]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)


def rates_of(posterior: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected ``steps``; all begin at 1."""
    r = np.ones(len(posterior))
    for step in steps:
        r = np.maximum(0.0, r - posterior @ step)
    return r


def rate_column(posterior: Column, steps: list[np.ndarray]) -> Column:
    """The same for a column of posteriors, in one pass over the steps."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*(F.array(*(F.lit(float(x)) for x in step)) for step in steps))
    dot = lambda step: F.aggregate(F.zip_with(posterior, step, lambda p, q: p * q), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(moves, F.lit(1.0), lambda r, step: F.greatest(F.lit(0.0), r - dot(step)))


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[tuple], label_columns: tuple[str, ...], most: int) -> DomainClassifier:
    """Learn from at most ``most`` labelled documents, those of least hash: the documented bound of the sample.

    The driver gets their features, at most a bucket list and some shares for each, whatever the texts' length.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), *(F.col(c).cast("int").alias(f"_{c}") for c in label_columns)).dropna()
    known = known.groupBy("_id").agg(*(F.max(f"_{c}").alias(f"_{c}") for c in label_columns)).orderBy(F.xxhash64("_id"), "_id").limit(most)
    sample = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "_id")  # most rows of small numbers
    made = pa.schema([("label", pa.string()), ("words", pa.binary()), ("shares", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = [features(t or "") for t in batch.column(0).to_pylist()]
            yield table(made, batch.column(1), [a.astype(np.int32).tobytes() for a, _, _ in got], [s.tobytes() for _, s, _ in got])

    sample = sample.groupBy("_id", F.concat_ws(",", *(f"_{c}" for c in label_columns)).alias("label")).agg(F.min("text").alias("text"))  # of a repeated id one row
    rows = sample.select("text", "label").mapInArrow(extract, "label string, words binary, shares binary").collect()
    number = {",".join(map(str, d)): k for k, d in enumerate(domains)}
    rows = sorted((r for r in rows if r.label in number), key=lambda r: (r.label, bytes(r.words), bytes(r.shares)))
    classifier = DomainClassifier(len(domains))
    classifier.fit([(np.frombuffer(r.words, np.int32), np.frombuffer(r.shares), 0) for r in rows], np.array([number[r.label] for r in rows], np.int64))
    return classifier


def domains_of(targets: dict[tuple, float], label_columns: tuple[str, ...]) -> tuple[list[tuple], list[str]]:
    """All combinations of the labels' values, and their names."""
    domains = sorted(product(*[sorted({d[i] for d in targets}) for i in range(len(label_columns))]))
    return domains, ["_".join(f"{c}{v}" for c, v in zip(label_columns, d, strict=True)) for d in domains]


def rated(docs: DataFrame, labels: DataFrame, targets: dict[tuple, float], label_columns: tuple[str, ...], most: int, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns ``keep`` of docs and one struct (n_tokens, p, rate, miss) under a name that none of them has; and that name.

    Texts are read once: tokens and posteriors are written beside the kept columns, the fit reads these two
    alone, and rates are an expression on them.
    """
    domains, _ = domains_of(targets, label_columns)
    model = docs.sparkSession.sparkContext.broadcast(fit_classifier(docs, labels, domains, label_columns, most))
    kept = docs.columns if keep is None else keep
    tokens, post = (fresh(c, docs.columns) for c in ("n_tokens", "p"))

    def make(texts: list[str | None]) -> list[pa.Array]:
        got = [features(t or "") for t in texts]
        p = model.value.posterior(got)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(domains))
        return [pa.array([n for _, _, n in got], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))]

    fields = [StructField(tokens, LongType()), StructField(post, ArrayType(DoubleType()))]
    base = written(from_texts(docs, fields, make, kept), "posteriors")
    steps, miss = fit_steps(base.select(tokens, post), [targets.get(d, 0.0) for d in domains])
    name = fresh("mixing", docs.columns)
    values = F.struct(F.col(tokens).alias("n_tokens"), F.col(post).alias("p"), rate_column(F.col(post), steps).alias("rate"), F.lit(miss).alias("miss"))
    return base.select(*(F.col(quoted(c)) for c in kept), values.alias(name)), name


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[tuple, float] | None = None, label_columns: tuple[str, ...] = LABELS, most: int = 6000, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None), and: n_tokens (words), p_<domain> for each domain, domain (the likeliest), rate, target_miss
    (the greatest relative difference of a domain's total from its target, the same in all rows).

    ``targets`` are shares of tokens by domain; the total is such that the domain of greatest share keeps the
    tokens it has. At most ``most`` labelled documents, those of least hash, are learnt from (the documented
    bound of the sample). Rows are rated one by one: repeated rows get equal rates, a null text counts as
    empty (no tokens, rate by its posterior), a very long text is one row like any other, of labels of one
    document the greatest holds, of equal posteriors the first domain's name is given, a domain without tokens
    is left out of the fit, and an empty table gives an empty result. Columns of docs with the names added are
    replaced. Targets that nonnegative rates can't meet give a warning, and target_miss says by how much.
    """
    targets = targets or TARGETS
    _, names = domains_of(targets, label_columns)
    added = {"n_tokens", "domain", "rate", "target_miss", *(f"p_{n}" for n in names)}
    rest = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {a.lower() for a in added}]
    out, name = rated(docs, labels, targets, label_columns, most, rest)
    v = F.col(name)
    likeliest = F.get(F.array(*(F.lit(n) for n in names)), (F.array_position(v["p"], F.array_max(v["p"])) - 1).cast("int"))
    return out.select(*(F.col(quoted(c)) for c in rest), v["n_tokens"].alias("n_tokens"), *(F.get(v["p"], F.lit(k)).alias(f"p_{n}") for k, n in enumerate(names)), likeliest.alias("domain"), v["rate"].alias("rate"), v["miss"].alias("target_miss"))


def fit_steps(small: DataFrame, shares: list[float], most: int = 100, close: float = 1e-6) -> tuple[list[np.ndarray], float]:
    """Steps of the projected gradient over (n_tokens, p) until every total is within ``close`` of its target, and the greatest miss (relative).

    Each iteration is one pass over the small table: it tries ``LENGTHS`` of the step and brings back, for each,
    the domains' totals and their overlap among the documents that are free (rate above zero). Where ten steps lower
    the weighed distance by less than a hundredth, or after ``most``, the fit ends with a warning: no nonnegative
    rates meet the targets, or only a few documents' could.
    """
    k = len(shares)
    width = k + k * k
    sums = pa.schema([("i", pa.int32()), ("s", pa.float64())])

    def totals(steps: list[np.ndarray], tries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(LENGTHS), width))
            for batch in batches:
                if batch.num_rows:
                    n, p = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64), batch.column(1).flatten().to_numpy().reshape(-1, k)
                    before = rates_of(p, steps)
                    for t, step in enumerate(tries):
                        r = np.maximum(0.0, before - p @ step)
                        total[t, :k] += (r * n) @ p
                        total[t, k:] += ((p * (n * (r > 0))[:, None]).T @ p).ravel()
            yield table(sums, range(total.size), total.ravel())

        got = np.zeros(len(LENGTHS) * width)
        for r in small.mapInArrow(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # as many rows as numbers
            got[r.i] = r.s
        got = got.reshape(len(LENGTHS), width)
        return [(x[:k], x[k:].reshape(k, k)) for x in got[: len(tries)]]

    natural, overlap = totals([], [np.zeros(k)])[0]
    wanted = np.array(shares) / max(sum(shares), 1e-12)
    main = int(np.argmax(wanted))
    if not natural.sum() or not natural[main]:
        return [], 0.0
    some = natural > 0
    target = np.where(some, wanted * natural[main] / wanted[main], 0.0)
    metric = np.linalg.pinv(overlap, rcond=1e-12, hermitian=True)  # of the distance: that of all documents
    distance = lambda now: float((now - target) @ metric @ (now - target))
    unit = np.where(target > 0, target, natural)
    miss = lambda now: float((np.abs(now - target)[some] / unit[some]).max())
    steps: list[np.ndarray] = []
    now, seen = natural, [distance(natural)]
    while miss(now) > close and len(steps) < most and not (len(seen) > 10 and seen[-1] > 0.99 * seen[-11]):
        off = now - target
        # the free documents' overlap, with a little of all documents' so that none is stuck
        inverse = np.linalg.pinv(overlap + 1e-9 * np.diag(natural), rcond=1e-14, hermitian=True)
        tries = [length * inverse @ off for length in LENGTHS]
        tries[-1] = metric @ off  # the plain gradient, whose unit step never overshoots
        got = totals(steps, tries)
        best = min(range(len(tries)), key=lambda t: distance(got[t][0]))
        if distance(got[best][0]) >= seen[-1]:
            break
        steps.append(tries[best])
        now, overlap = got[best]
        seen.append(distance(now))
    if miss(now) > close:
        warnings.warn(f"mixing: totals {now.tolist()} miss targets {target.tolist()} after {len(steps)} steps", stacklevel=2)
    return steps, miss(now)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[tuple, float] | None = None, label_columns: tuple[str, ...] = LABELS, most: int = 6000) -> DataFrame:
    """docs with each row as often as its rate says: the whole part, and once more with the chance of the rest.

    All columns come back as they were, whatever their names; rows with odd input fare as in :func:`mixing_rates`.
    The chance is a hash of doc_id and text, so a document's copies are the same in every run; equal rows fare alike.
    """
    out, name = rated(docs, labels, targets or TARGETS, label_columns, most)
    rate = F.col(name)["rate"]
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) / float(1 << 32)
    copies = (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    many = fresh("copies", docs.columns)
    out = out.select(*columns_of(docs), copies.alias(many)).filter(F.col(many) > 0)
    return out.select(*columns_of(docs), F.explode(F.sequence(F.lit(1), F.col(many))).alias(many)).select(*columns_of(docs))
