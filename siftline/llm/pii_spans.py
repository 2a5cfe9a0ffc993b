"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

A candidate segment is a run of at most ``MAX_TOKENS`` tokens with one of the kinds; it holds an ASCII digit, an @ or
a bracketed at, so only tokens within reach of one are looked at, as far as a segment can extend. Features look at the whole span (digit count, Luhn, octets,
groups, domain, what stands beside it), and dynamic programming over segment ends chooses boundaries and
kinds together. Its weights are fitted here, by maximum likelihood with forward-backward sums, on
generated sentences (``training_sentences``), so they are the same for every corpus.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from siftline.llm.common import fresh, from_texts, quoted, slices, table, with_text

KINDS = ("email", "ip", "card", "phone")
#: Longest entity in tokens: 19 digits, each with a separator, and signs around.
MAX_TOKENS = 40

#: Right of an @ in the base email.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match never begins inside a run of digits, as the run's first digit would match as well; stated so, no run is read twice.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

MORE_DOMAIN = re.compile(r"\.[A-Za-z0-9]|\s?[\[({]dot[\])}]", re.IGNORECASE)
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: What a candidate holds at least once; matched at a token's beginning.
TRIGGER = re.compile(r"[0-9@]|[\[({]at[\])}]", re.IGNORECASE)
#: Signs of numbers; a candidate of digits has no others.
NUMERIC = frozenset("0123456789.()+-")
DIGITS = frozenset("0123456789")
#: Tokens before a candidate that are read for cues.
CUE_TOKENS = 3
CUES = {
    "email": frozenset("email mail e contact write".split()),
    "ip": frozenset("ip host server address addr ping".split()),
    "card": frozenset("card visa credit mastercard debit payment".split()),
    "phone": frozenset("phone tel call mobile fax cell telephone".split()),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping for each kind."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 14 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(only_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def span_features(text: str, a: int, b: int, kind: int, before: list[str]) -> list[str] | None:
    """Features of the whole span text[a:b] as ``kind``; None if it can't be of that kind."""
    s = text[a:b]
    left, right = text[a - 1 : a], text[b : b + 1]
    f = [f"cue:{any(w in CUES[KINDS[kind]] for w in before)}"]
    if kind == 0:
        plain = "@" in s
        t = s if plain else re.sub(r"\s*[\[({]at[\])}]\s*", "@", re.sub(r"\s*[\[({]dot[\])}]\s*", ".", s, flags=re.I), flags=re.I)
        local, _, domain = t.partition("@")
        if not local or not domain or t.count("@") != 1 or re.search(r"\s", t):
            return None
        last = domain.rpartition(".")[2]
        ok = re.fullmatch(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", domain) is not None
        f += [f"plain:{plain}", f"domain:{ok}", f"top:{last.isalpha() and 2 <= len(last) <= 8}", f"local:{all(c in LOCAL for c in local)}", f"edge:{left in LOCAL and left != ''}:{right.isalnum()}", f"more:{MORE_DOMAIN.match(text, b) is not None}"]
        return f
    digits = only_digits(s)
    n = len(digits)
    edge = f"edge:{left.isalnum() or left in '._-@/$' and left != ''}:{right.isalnum() or right in '@/%' and right != ''}"
    if kind == 1:
        parts = s.split(".")
        if len(parts) != 4 or not all(1 <= len(p) <= 3 and DIGITS.issuperset(p) for p in parts):
            return None
        dotted = (left == "." and text[a - 2 : a - 1] in DIGITS) or (right == "." and text[b + 1 : b + 2] in DIGITS)
        return f + [f"octets:{all(int(p) <= 255 for p in parts)}", edge, f"more:{dotted}"]
    more = (right in "- ." and right != "" and text[b + 1 : b + 2] in DIGITS) or (left in "- ." and left != "" and text[a - 2 : a - 1] in DIGITS)
    if kind == 2:
        if not 13 <= n <= 19 or not re.fullmatch(r"[0-9][0-9 -]*", s):
            return None
        groups = [len(x) for x in re.split("[ -]", s)]
        even = len(groups) == 1 or (len(groups) >= 3 and max(groups) <= 7 and min(groups) >= 3)
        return f + [f"luhn:{luhn(digits)}", f"groups:{even}", f"first:{digits[0] in '23456'}", f"n:{n if n < 17 else 17}", edge, f"more:{more}"]
    if not 7 <= n <= 15 or not re.fullmatch(r"\+?[0-9 ().-]+", s):
        return None
    groups = [len(x) for x in re.findall("[0-9]+", s)]
    shape = "one" if len(groups) == 1 else "nanp" if groups[-2:] == [3, 4] and len(groups) >= 3 else "many"
    return f + [f"plus:{s[0] == '+'}", f"paren:{'(' in s and s.count('(') == s.count(')')}", f"open:{s.count('(') != s.count(')')}", f"shape:{shape}", f"n:{'7-9' if n < 10 else '10-11' if n < 12 else '12-15'}", f"luhn:{n >= 13 and luhn(digits)}", edge, f"more:{more}", f"dots:{s.count('.')}"]


def all_tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def segments_from(text: str, tokens: list[tuple[int, int]], i: int) -> Iterator[tuple[int, int, int, int, int, list[str]]]:
    """Candidate segments that begin with token i: (first token, end token, start, end, kind, features)."""
    p = tokens[i][0]
    c = text[p]
    if not (c.isalnum() or c in "+("):
        return
    before = [text[x:y].lower() for x, y in tokens[max(0, i - CUE_TOKENS) : i]]
    letters = at = gaps = False
    digits, dots, plain = 0, 0, True
    for j in range(i, min(len(tokens), i + MAX_TOKENS)):
        x, y = tokens[j]
        if j > i and (gap := text[tokens[j - 1][1] : x]) and (len(gap) > 1 or gap == "\n"):
            return
        word = text[x:y]
        letters |= any(ch.isalpha() for ch in word)
        at |= word == "@" or word.lower() == "at"
        gap = j > i and x > tokens[j - 1][1]
        if gap and letters and word[0] not in "[({" and text[tokens[j - 1][0]] not in "])}":
            return
        if not letters:
            gaps |= gap
            digits += sum(ch in DIGITS for ch in word)
            dots += word == "."
            plain = plain and NUMERIC.issuperset(word)
        if not word[-1].isalnum():
            continue
        # which kinds the counts allow: span_features refuses all others
        if letters:
            kinds = (0,) if at else ()
        elif plain:
            kinds = (*((1,) if dots == 3 and not gaps else ()), *((2,) if 13 <= digits <= 19 else ()), *((3,) if 7 <= digits <= 15 else ()))
        else:
            kinds = ()
        for kind in kinds:
            if (f := span_features(text, p, y, kind, before)) is not None:
                yield i, j + 1, p, y, kind, [f"{KINDS[kind]}|{z}" for z in (*f, "bias")]


def segments(text: str) -> tuple[int, list[tuple[int, int, int, int, int, list[str]]]]:
    """Number of tokens of a text, and all its candidate segments."""
    tokens = all_tokens(text)
    return len(tokens), [seg for i in range(len(tokens)) for seg in segments_from(text, tokens, i)]


def score(weights: dict[str, float], features: list[str]) -> float:
    return sum(weights.get(f, 0.0) for f in features)


def decode(weights: dict[str, float], text: str, tokens: list[tuple[int, int]], first: int = 0) -> list[tuple[int, int, int]]:
    """Best segmentation of the tokens from ``first`` on: (start, kind, end) of its entities.

    Segments are scored as they are met, and of those that end at a token only the best is kept.
    """
    n = len(tokens)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    ends = [-math.inf] * (n + 1)
    for i in range(first, n):
        if ends[i] > best[i]:
            best[i] = ends[i]
        else:
            back[i] = None  # a token outside all entities scores 0
        for seg in segments_from(text, tokens, i):
            s = best[i] + score(weights, seg[5])
            if s > ends[seg[1]]:
                ends[seg[1]], back[seg[1]] = s, seg[:5]
        best[i + 1] = best[i]
    if ends[n] <= best[n]:
        back[n] = None
    out, j = [], n
    while j > first:
        if back[j]:
            out.append((back[j][2], back[j][4], back[j][3]))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def field_spans(weights: dict[str, float], text: str) -> list[tuple[int, int, int]]:
    """The field's entities in a whole text, as one decoding of all its tokens gives them.

    A segment holds a trigger and has at most MAX_TOKENS tokens, so what stands farther from all triggers than
    that is outside all entities; and none crosses a wide gap, so each stretch between gaps is decoded alone.
    """
    out: list[tuple[int, int, int]] = []
    if not TRIGGER.search(text):
        return out
    held: list[tuple[int, int]] = []  # the tokens that may still be needed
    first = 0  # no open segment begins before this one; those before it are read for cues alone
    left = 0  # tokens to go until all segments with the last trigger have ended and none with the next one has begun
    end = 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if (gap := a - end) > 1 or (gap == 1 and text[end] == "\n"):
            if left:
                out += decode(weights, text, held, first)
                left = 0
            held = held[-CUE_TOKENS:]
            first = len(held)
        end = b
        held.append((a, b))
        if text[a] in "0123456789@[({" and TRIGGER.match(text, a):
            if not left:
                first = max(first, len(held) - MAX_TOKENS)
            left = 2 * MAX_TOKENS
        elif left:
            left -= 1
            if not left:
                out += decode(weights, text, held[:-MAX_TOKENS], first)
                first = len(held) - MAX_TOKENS
        if not left and len(held) > 8 * MAX_TOKENS:
            drop = len(held) - MAX_TOKENS - CUE_TOKENS
            held = held[drop:]
            first = max(first - drop, CUE_TOKENS)
    if left:
        out += decode(weights, text, held, first)
    return out


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def training_sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with their entities, plain and odd forms, and numbers that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randint(2, 9)))

    def email() -> str:
        local, domain = word() + r.choice(["", "." + word(), digits(2), "." + digits(2)]), word() + r.choice(["", digits(1)]) + "." + r.choice(["com", "org", "example.com", "de", "net"])
        if r.random() < 0.3:
            o, c = r.choice(["[]", "()", "{}"])
            gap = r.choice(["", " "])
            return f"{local}{gap}{o}at{c}{gap}" + domain.replace(".", f"{gap}{o}dot{c}{gap}")
        return f"{local}@{domain}"

    def card() -> str:
        k = r.choice([14, 15, 16, 16, 16, 16])
        body = r.choice("3456") + digits(k - 2)
        d = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, k, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(30, 49)} {digits(3)} {digits(7)}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}"])

    make = (email, lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), card, phone)
    other = (
        lambda: digits(r.randint(1, 6)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"${digits(3)}.{digits(2)}",
        lambda: digits(16), lambda: digits(16), lambda: r.choice("456") + digits(15), lambda: digits(15), lambda: digits(14), lambda: "@" + word(), lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"{digits(3)},{digits(3)}", lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), lambda: digits(r.choice([7, 8, 9, 10, 11, 12, 13, 16, 17, 20])),
        lambda: f"{digits(4)} - {digits(4)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}", lambda: "AKIA" + digits(4) + word().upper(), lambda: f"{digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{digits(4)} {digits(4)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}",
    )
    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        for _ in range(r.randint(2, 4)):
            for w in (word() for _ in range(r.randint(0, 4))):
                parts.append(w + " ")
                at += len(parts[-1])
            kind = r.randrange(4) if r.random() < 0.6 else None
            if kind is not None and r.random() < 0.25:
                parts.append(r.choice(sorted(CUES[KINDS[kind]])) + r.choice([": ", " "]))
                at += len(parts[-1])
            s = make[kind]() if kind is not None else r.choice(other)()
            if kind is not None:
                spans.append((at, kind, at + len(s)))
            parts.append(s + r.choice([" ", ". ", ", ", "\n"]))
            at += len(parts[-1])
        out.append(("".join(parts), spans))
    return out


@functools.lru_cache(maxsize=4)
def fitted_weights(n: int = 300, epochs: int = 12, seed: int = 7, rate: float = 0.4, l2: float = 1e-3) -> dict[str, float]:
    """Weights of the field by stochastic gradients of the log-likelihood (AdaGrad); the sums run over all segmentations."""
    data = []
    for text, spans in training_sentences(n, seed):
        size, segs = segments(text)
        gold = {(p, y, k) for p, k, y in spans}
        data.append((size, [(i, j, f, (p, y, k) in gold) for i, j, p, y, k, f in segs]))
    w: dict[str, float] = {}
    seen: dict[str, float] = {}
    for _ in range(epochs):
        for size, segs in data:
            s = [score(w, f) for _, _, f, _ in segs]
            into: list[list[int]] = [[] for _ in range(size + 1)]
            outof: list[list[int]] = [[] for _ in range(size + 1)]
            for q, (i, j, _, _) in enumerate(segs):
                into[j].append(q)
                outof[i].append(q)
            fwd, bwd = [0.0] * (size + 1), [0.0] * (size + 1)
            for j in range(1, size + 1):
                fwd[j] = fwd[j - 1]
                for q in into[j]:
                    fwd[j] = _log_add(fwd[j], fwd[segs[q][0]] + s[q])
            for i in range(size - 1, -1, -1):
                bwd[i] = bwd[i + 1]
                for q in outof[i]:
                    bwd[i] = _log_add(bwd[i], bwd[segs[q][1]] + s[q])
            step: dict[str, float] = {}
            for q, (i, j, f, gold) in enumerate(segs):
                g = gold - math.exp(min(0.0, fwd[i] + s[q] + bwd[j] - fwd[size]))
                if abs(g) > 1e-4:
                    for x in f:
                        step[x] = step.get(x, 0.0) + g
            for x, g in step.items():
                g -= l2 * w.get(x, 0.0)
                seen[x] = seen.get(x, 0.0) + g * g
                w[x] = w.get(x, 0.0) + rate * g / math.sqrt(seen[x])
    return w


def all_spans(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with the field's: an added span overlaps no base span."""
    base = base_spans(text)
    starts, ends = [], []  # of the stretches that base spans cover
    for s, _, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def free(span: tuple[int, int, int]) -> bool:
        k = bisect.bisect_left(starts, span[2])  # stretches that begin before the span's end
        return not k or ends[k - 1] <= span[0]

    added = [x for x in field_spans(weights, text) if free(x)]
    return base, sorted(base + added)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of every whole text: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans.

    A null text counts as empty and has no spans (the hash of nothing, an empty string). Offsets are code
    points, ends exclusive. Rows are read one by one: repeated rows come back repeated, other columns are
    not read, an empty table gives an empty result, and texts without a trigger cost one scan.
    """
    weights = fitted_weights()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    schema = pa.schema([(c, pa.string() if c in ("base_sha256", "spans") else pa.int64()) for c in names])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: tuple[list, ...] = tuple([] for _ in names[1:])
            for text in batch.column(1).to_pylist():
                base, both = all_spans(text or "", weights)
                kinds = [k for _, k, _ in base]
                for col, x in zip(out, (*(kinds.count(k) for k in range(4)), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(both)), strict=True):
                    col.append(x)
            yield table(schema, batch.column(0), *out)

    types = ", ".join(f"{c} {'string' if c in ('base_sha256', 'spans') else 'long'}" for c in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, types)


def redact(text: str, weights: dict[str, float]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for a, k, b in all_spans(text, weights)[1]:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with spans in text replaced and n_chars, where there is one, renewed.

    A null text stays null, an empty one empty; repeated rows stay repeated; other columns come back as they were,
    whatever their names; very long texts are worked off alone; an empty table gives an empty result.
    """
    weights = fitted_weights()
    new = fresh("redacted", docs.columns)

    def make(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([t if t is None else redact(t, weights) for t in texts], pa.string())]

    keep = [c for c in docs.columns if c.lower() != "text"]
    # the old text goes to the workers once and does not come back
    out = from_texts(docs, [StructField(new, StringType())], make, keep)
    out = out.select(*(F.col(new).alias(c) if c.lower() == "text" else F.col(quoted(c)) for c in docs.columns))
    return out.select(*(c.cast(docs.schema[n].dataType).alias(n) for c, n in zip(with_text(out, F.col("text")), docs.columns, strict=True)))
