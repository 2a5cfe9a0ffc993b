import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftline.llm.best_fit_packing import RemainderTree, best_fit_decreasing, best_fit_packing, pack
from siftline.llm.direct_access_codes import DirectCodes, encode_codes, read_tokens, token_id_roundtrip, write_codes
from siftline.llm.tokens import COMMON, TextEncoder, Vocabulary, chunks, kind_of
from tests.conftest import SF

FILES = {"blank": public_tokenizers.path("word_bpe_49k.json"), "spaced": public_tokenizers.path("byte_bpe_50k.json")}
ENCODERS = {kind: TextEncoder(path) for kind, path in FILES.items()}
LIBRARY = {kind: Tokenizer.from_file(path) for kind, path in FILES.items()}


def plain(kind: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in LIBRARY[kind].encode_batch(texts, add_special_tokens=False)]


def check_encoder(kind: str, texts: list[str]) -> None:
    ids, counts = ENCODERS[kind].encode(texts)
    cuts = np.cumsum(counts)
    for t, want, a, b in zip(texts, plain(kind, texts), cuts - counts, cuts, strict=True):
        assert ids[a:b].tolist() == want, repr(t)


@pytest.mark.parametrize("kind", FILES)
def test_encoder_on_odd_texts(kind):
    check_encoder(kind, ["", " ", "\n", "  a b\n\nc  d    e\n\n x it's 's  ", "Á B̊ café \xa0x Σας ΣΑΣ İx", "<|endoftext|> x", "a\x1cb \x1c c", "a\xa0 b \xa0c\x85", "x\n \nfoo", "a\t\tb", "日本語 テ ３ ½ 2² Ǆ", "x\r\ny", "don't DON'T we'LL.", " lead", "trail ", "a\n\n b", "Zz!!! $$$ 12,345.6 é́"])


@pytest.mark.parametrize("kind", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'stZ19é. \n\t\xa0$İ日́\x1c")), max_size=30), max_size=3))
def test_encoder_equals_the_library(kind, texts):
    check_encoder(kind, texts)


@pytest.mark.parametrize("kind", FILES)
def test_native_encoder_is_the_library(kind):
    """The file is of a known kind, and its vocabulary meets the condition under which both encoders agree."""
    with open(FILES[kind], encoding="utf-8") as f:
        spec = json.load(f)
    assert kind_of(spec) == kind
    assert Vocabulary(spec).consistent()
    spec["model"]["merges"].reverse()
    assert not Vocabulary(spec).consistent()


@pytest.mark.parametrize("kind", FILES)
def test_special_tokens_are_the_librarys(kind):
    check_encoder(kind, ["hi <|endoftext|> there", "<|endoftext|>", "<|startoftext|><|endoftext|>x", "a<|endoftext|>b <|ENDOFTEXT|>", "é<|endoftext|>\xa0 <|endoftext|", "it's<|endoftext|>'s"])


@pytest.mark.parametrize("kind", FILES)
def test_all_common_characters(kind):
    chars = [c for c in map(chr, range(0x10000)) if COMMON.fullmatch(c)]
    r = random.Random(2)
    check_encoder(kind, [*("".join(chars[i : i + 50]) for i in range(0, len(chars), 50)), *("".join(r.choice(chars) + r.choice(["", "a", " ", "'s"]) for _ in range(40)) for _ in range(500))])


@pytest.mark.parametrize("kind", FILES)
def test_long_texts_in_chunks(kind, monkeypatch):
    monkeypatch.setattr("siftline.llm.tokens.chunks", lambda t: chunks(t, 7))
    r = random.Random(4)
    check_encoder(kind, ["".join(r.choice(["ab", "it's", " ", "  ", "\n", "é", "\xa0", "日本", "x.", "12", "̈"]) for _ in range(60)) for _ in range(400)])
    monkeypatch.undo()
    check_encoder(kind, ["word and " * 40_000, "x" * 300_000, " " * 200_000 + "a", "a" + "\n" * 9_000 + "b", "日本 語\xa0" * 30_000])


@given(st.lists(st.integers(0, 64), max_size=40), st.integers(0, 64))
def test_tree(pushed, need):
    tree = RemainderTree(64)
    for i, x in enumerate(pushed):
        tree.push(x, i, 1)
    assert tree.tightest(need) == min((x for x in pushed if x >= need), default=None)
    for x in sorted(pushed):
        assert tree.tightest(0) == x
        tree.pop(x)
    assert tree.tightest(0) is None


def one_by_one(lengths: list[int], capacity: int) -> Counter:
    """Best-fit decreasing, a piece at a time: how many bins have which fill."""
    bins: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= x]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= x
        else:
            bins.append(capacity - x)
    return Counter(capacity - b for b in bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_histogram_packing_equals_one_by_one(lengths):
    rows = best_fit_decreasing(Counter(lengths), 40)
    fill: Counter = Counter()
    for length, _, pieces, each, first, offset in rows.tolist():
        for k in range(pieces):
            fill[first + k // each] += length
            assert offset + (k % each + 1) * length <= 40
    assert sum(rows[:, 2]) == len(lengths)
    assert Counter(fill.values()) == one_by_one(lengths, 40)


def expected_pieces(texts: dict, capacity: int) -> Counter:
    out: Counter = Counter()
    for doc, ids in zip([d for d, _ in texts], plain("blank", [t or "" for _, t in texts]), strict=True):
        all_ids = np.array([*ids, 1], "<u4")
        for k, s in enumerate(range(0, len(all_ids), capacity)):
            part = all_ids[s : s + capacity]
            out[doc, k, s, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def check_packing(rows, texts, capacity):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces(texts, capacity)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) == sum(one_by_one([r.length for r in rows], capacity).values())


@pytest.mark.parametrize("salt_rows", [1, 7, 1 << 19])
def test_packing_by_salts(spark, salt_rows):
    """However a length's pieces are dealt, the bins are those of one piece after another."""
    r = random.Random(6)
    lengths = [r.choice([3, 3, 3, 5, 9, 16, 16, 20]) for _ in range(400)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    fill: dict = {}
    for r_ in pack(pieces, 20, salt_rows).collect():
        fill.setdefault(r_.sequence_id, []).append((r_.offset, r_.length))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    assert Counter(sum(n for _, n in parts) for parts in fill.values()) == one_by_one(lengths, 20)


def test_packing_odd_documents(spark, odd, empty):
    check_packing(best_fit_packing(odd, FILES["blank"], capacity=64).collect(), [(r.doc_id, r.text) for r in odd.collect()], 64)
    assert best_fit_packing(empty, FILES["blank"]).collect() == []


def test_packing_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(best_fit_packing(docs, FILES["blank"]).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_codes_give_any_token(ids, data):
    codes = DirectCodes(encode_codes(np.array(ids, np.uint32)))
    assert len(codes) == len(ids)
    assert codes.slice(0, len(ids)).tolist() == ids
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        j = data.draw(st.integers(i, len(ids)))
        assert codes[i] == ids[i]
        assert codes.slice(i, j).tolist() == ids[i:j]
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_codes_access_far_blocks():
    r = random.Random(1)
    ids = [r.choice([5, 300, 70_000, 2**31]) for _ in range(20_000)]
    codes = DirectCodes(encode_codes(np.array(ids, np.uint32)))
    assert [codes[i] for i in range(0, 20_000, 97)] == ids[::97]
    with pytest.raises(ValueError):
        DirectCodes(b"XXXX")


def check_roundtrip(rows, texts):
    rows = sorted((tuple(r) for r in rows), key=lambda x: x[1])
    order = [d for d, *_ in rows]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    want = Counter()
    for (doc, _), ids in zip(texts, plain("spaced", [t or "" for _, t in texts]), strict=True):
        all_ids = np.array([*ids, 2], "<u4")
        want[doc, len(all_ids), zlib.crc32(all_ids.tobytes())] += 1
    assert Counter((d, n, crc) for d, _, n, crc in rows) == want
    assert [s for _, s, *_ in rows] == (np.cumsum([n for _, _, n, _ in rows]) - [n for _, _, n, _ in rows]).tolist()


def test_any_token_by_its_number(spark, tmp_path):
    texts = [(i, f"text {i} of many words " * (i % 7)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    write_codes(docs, f"file://{tmp_path}/codes", FILES["spaced"], shard_tokens=500)
    ids = [x for row in plain("spaced", [t for _, t in texts]) for x in [*row, 2]]
    assert spark.read.parquet(f"file://{tmp_path}/codes/index").count() > 4
    for i in (0, 499, 500, 501, len(ids) // 2, len(ids) - 1):
        assert read_tokens(spark, f"file://{tmp_path}/codes", i) == [ids[i]]
    assert read_tokens(spark, f"file://{tmp_path}/codes", 300, 900) == ids[300:1200]
    with pytest.raises(IndexError):
        read_tokens(spark, f"file://{tmp_path}/codes", len(ids))


def test_roundtrip_odd_documents(spark, odd, empty):
    check_roundtrip(token_id_roundtrip(odd, FILES["spaced"]).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert token_id_roundtrip(empty, FILES["spaced"]).collect() == []


def test_roundtrip_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_roundtrip(token_id_roundtrip(docs, FILES["spaced"]).collect(), [(r.doc_id, r.text) for r in docs.collect()])
