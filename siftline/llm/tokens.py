"""Whole texts to token ids, as the ``tokenizers`` library gives them for a vocabulary file.

Texts of common letters are cut into pieces and merged by a native byte-pair encoder (``tiktoken``) that is given
the file's merges; all other texts go through the library itself. Both give the same ids: the native encoder joins
the neighbours whose joined bytes have the least rank, the library those of the merge of least rank, and the two
can first differ only where a token's bytes stand as two parts that are not its merge. What happens inside those
bytes up to then is what happens to the token's bytes alone, and these end in the token by its own merge, which
``consistent`` checks for every token of a vocabulary.

Nothing is remembered from text to text, and long texts are worked off in chunks, so memory is bounded.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import regex

#: Characters about whose classes and lower case all Unicode versions agree, each its own NFC form and without effect on
#: its neighbours (so no capital sigma); the blanks among them are ASCII. U+007F is left free as a mark.
COMMON = re.compile("[\t-\r !-~¡-¬®-įı-ɏЀ-џ‐-‧‰-⁞€™一-龥ぁ-ゖァ-ヺー가-힣、。「」『』（）！？：；，]*")
#: Those of them that are letters wherever they are not ASCII, so that bytes tell their classes.
LETTERED = re.compile("[\t-\r !-~À-ÖØ-öø-įı-ɏ]*")
#: A chunk may begin at such a blank: it begins a piece, whatever stands before it or behind.
CUT = re.compile(r"(?<=\S) (?=\S)")
CHUNK = 1 << 16
#: Longer runs of blanks are too much for the native encoder's regular expressions.
BLANKS = re.compile(r"\s{4096}")
TWO_BLANKS = re.compile(r"\s\s")
MARK = "\x7f"
#: The piece patterns of the two kinds of files, as the files or the library state them.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What the patterns take behind an apostrophe, in lower case.
CONTRACTION = re.compile(rb"'(?:[stmd]|re|ve|ll)")
#: The same as SPACED in a text without two blanks together.
SINGLY_SPACED = SPACED.replace(r"\s+(?!\S)|\s+", r"\s")

# classes of bytes: 0 blank, 1 letter, 2 digit (a piece each), 3 any other
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


def letter_bytes() -> dict[str, int]:
    """Letter of a byte-level vocabulary to its byte: visible Latin-1 stands for itself, the rest begins at U+0100."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ranks of a byte-level BPE file: ``tokens`` in rank order as bytes, and ``ids`` of the ranks.

    A word's end is a byte of its own, MARK, which occurs in no common text: it joins the word's last byte before all else.
    """

    def __init__(self, spec: dict):
        model, byte = spec["model"], letter_bytes()
        self.suffix = model.get("end_of_word_suffix") or ""

        def spelled(token: str) -> bytes:
            end = bool(self.suffix) and token.endswith(self.suffix)
            return bytes(byte[c] for c in (token[: -len(self.suffix)] if end else token)) + MARK.encode() * end

        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [a + b for a, b in self.merges]
        bases = sorted(set(model["vocab"]) - set(made) - {t["content"] for t in spec.get("added_tokens", ())}, key=model["vocab"].get)
        bases.sort(key=lambda t: len(spelled(t)))  # single bytes, then those with a mark
        self.ids = np.array([model["vocab"][t] for t in (*bases, *made)], np.uint32)
        self.tokens = [spelled(t) for t in (*bases, *made)]
        self.pairs = {(spelled(a), spelled(b)): i for i, (a, b) in enumerate(self.merges)}
        self.n_bases = len(bases)

    def consistent(self) -> bool:
        """Whether each token has one rank, and its bytes alone are merged to it by the library's rule."""
        if len(set(self.tokens)) < len(self.tokens) or any(b"".join(p) != self.tokens[self.n_bases + i] for p, i in self.pairs.items()):
            return False
        none = len(self.pairs)
        for token in self.tokens:
            parts = [token[i : i + 1] for i in range(len(token))]
            if self.suffix and len(parts) > 1 and token.endswith(MARK.encode()):
                parts[-2:] = [parts[-2] + parts[-1]]
            while len(parts) > 1:
                at = min(range(len(parts) - 1), key=lambda i: self.pairs.get((parts[i], parts[i + 1]), none))
                if (parts[at], parts[at + 1]) not in self.pairs:
                    return False
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True


def kind_of(spec: dict) -> str | None:
    """"spaced" or "blank" for the two kinds of files that the native encoder knows, None for others."""
    model, pre, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    flags = [t for t in spec.get("added_tokens", ()) if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
    if model.get("type") != "BPE" or odd or flags or spec.get("post_processor"):
        return None
    if not normal and not model.get("end_of_word_suffix") and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]:
        return "spaced"
    parts = pre.get("pretokenizers", ())
    steps = [n.get("type") for n in (normal or {}).get("normalizers", ())]
    split = parts[0] if len(parts) == 2 else {}
    plain = len(parts) == 2 and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
    if plain and model.get("end_of_word_suffix") and steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": BLANK} and split.get("behavior") == "Removed" and split.get("invert"):
        return "blank"
    return None


def chunks(text: str, limit: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``limit`` characters that are encoded alone as they are together."""
    at = 0
    while len(text) - at > limit and (m := CUT.search(text, at + limit)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def marked(text: str, pieces: regex.Pattern) -> str:
    """Lower-case text with a MARK behind every piece."""
    text = text.lower()
    if not LETTERED.fullmatch(text):
        return pieces.sub(rf"\g<0>{MARK}", text)
    if not text:
        return ""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    kind = KIND[raw]
    last = np.ones(len(raw), bool)
    last[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
    last &= kind != 0
    for m in CONTRACTION.finditer(data):
        at = m.start()
        if not at or last[at - 1] or not kind[at - 1]:  # where a piece begins
            last[at], last[m.end() - 1] = False, True
    to = np.arange(len(raw)) + np.cumsum(last) - last
    out = np.full(len(raw) + int(last.sum()), ord(MARK), np.uint8)
    out[to] = raw
    return out.tobytes().decode()


class TextEncoder:
    """Ids of texts with ``add_special_tokens=False``; a special token's string in a text is that token, as the library has it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = kind_of(spec)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        if self.kind:
            words = Vocabulary(spec)
            ranks = {t: i for i, t in enumerate(words.tokens)}
            native = lambda pattern: tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.ids = words.ids
            if self.kind == "blank":
                self.pieces, self.native = regex.compile(BLANK), native(rf"[^{MARK}\s]+{MARK}")
            else:
                self.singly, self.native = native(SINGLY_SPACED), native(SPACED)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _chunk(self, text: str) -> np.ndarray:
        if not COMMON.fullmatch(text):
            return self._library(text)
        if self.kind == "blank":
            ranks = self.native(marked(text, self.pieces))
        elif not TWO_BLANKS.search(text):
            ranks = self.singly(text)
        elif BLANKS.search(text):
            return self._library(text)
        else:
            ranks = self.native(text)
        return self.ids[np.array(ranks, np.int64)]

    def one(self, text: str) -> list[np.ndarray]:
        """The ids of a text, in parts."""
        if not self.kind:
            return [self._library(text)]
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(np.array([self.added[part]], np.uint32))
            elif part:
                out += [self._chunk(c) for c in chunks(part)]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of ids of each text."""
        parts, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            got = self.one(text)
            counts[i] = sum(map(len, got))
            parts += got
        return np.concatenate(parts), counts


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
