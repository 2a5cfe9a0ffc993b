"""The pipeline against plain versions of its stages."""

import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from siftline.llm import quality_rules, soft_mixing
from siftline.llm.common import written
from siftline.llm.pii_spans import fitted_weights, redact
from tests.conftest import SF
from tests.llm.test_simhash import slow_fingerprint, slow_groups
from tests.oracle import tables


def bad_lines(texts: dict) -> set:
    """Lines that fail a rule, by the SQL of the rules: a text of that line twice and a long good line loses the line."""
    lines = sorted({x for t in texts.values() for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")})
    con = duckdb.connect()
    con.execute("create table lines (i bigint, s varchar)")
    con.execute("insert into lines select unnest(?), unnest(?)", [list(range(len(lines))), lines])
    return {lines[i] for (i,) in con.execute(f"select i from lines where {quality_rules.bad_line_sql()}").fetchall()}


def without(text: str, bad: set) -> str:
    """The text without bad lines and later copies; blank lines stay, as empty ones."""
    seen, out = set(), []
    for x in text.split("\n"):
        if not x.strip(" \t\n\x0b\x0c\r"):
            out.append("")
        elif x not in bad and x not in seen:
            seen.add(x)
            out.append(x)
    return "\n".join(out)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r[0] for r in tables(SF).execute(f"select doc_id, kept from ({quality_rules.oracle_sql()})").fetchall() if r[1]}
    stages = iter(corpus_pipeline.STAGES)

    def step(docs, name):
        got, f = next(stages)
        assert got == name
        return written(f(spark, docs, SF), "test-stage")

    good = step(docs, "quality rules")
    assert good.columns == docs.columns and good.dtypes == docs.dtypes
    bad = bad_lines(texts)
    texts = {d: without(texts[d], bad) for d in kept}
    assert {r.doc_id: (r.text, r.n_chars) for r in good.collect()} == {d: (texts[d], len(texts[d])) for d in kept}

    ids = sorted(kept)
    groups = slow_groups([slow_fingerprint(texts[d]) for d in ids])
    first = {ids[g] for g in groups}
    alone = step(good, "simhash near-dedup")
    assert alone.columns == docs.columns
    assert sorted(r.doc_id for r in alone.collect()) == sorted(first)

    weights = fitted_weights()
    clean = step(alone, "personal data")
    assert clean.columns == docs.columns
    redacted = {d: redact(texts[d], weights) for d in first}
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {d: (t, len(t)) for d, t in redacted.items()}

    rates = {r.doc_id: r.rate for r in soft_mixing.mixing_rates(clean, spark.read.parquet(f"{SF}/labels.parquet"), corpus_pipeline.TARGETS, ("toxic",)).collect()}
    mixed = step(clean, "mixing to target weights")
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= first
    assert all(times[d] in (int(rate), int(rate) + 1) for d, rate in rates.items())

    packed = step(mixed, "best-fit packing").collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want: Counter = Counter()
    for d, n in times.items():
        all_ids = np.array([*t.encode(redacted[d], add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(all_ids), 4096)):
            part = all_ids[s : s + 4096]
            want[d, k, s, len(part), zlib.crc32(part.tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want


def test_stages_take_odd_documents(spark, odd):
    """Each stage alone, on all of the odd rows; columns, also those with operators' names, keep values and types."""
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        got = f(spark, odd, SF)
        rows = got.collect()
        if k < 4:
            assert got.dtypes == odd.dtypes
            other = [c for c in odd.columns if c not in ("doc_id", "text", "n_chars")]
            assert {tuple(r[c] for c in other) for r in rows} <= {tuple(r[c] for c in other) for r in odd.collect()}


def test_run_leaves_only_its_result(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {p.name for p in shared.iterdir()}
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [p.name.split("-")[:2] for p in shared.iterdir() if p.name not in before] == [["stage", "best"]]



def test_stages_take_no_documents(spark, empty):
    docs = empty
    for _, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, SF), "test-empty")
        assert docs.count() == 0


def test_private_names_are_only_names(spark):
    """Columns called as the stages' own helpers keep their values and types."""
    names = ["_kept", "_p", "_w", "_l", "_chars", "mixing", "copies", "verdict", "kept", "row", "fp", "redacted", "words", "lines", "chars", "symbols", "Rate", "p", "n_tokens", "a.b", "_id"]
    body = "Plain prose of a calm kind goes on and on here, and it ends."
    rows = [(i, f"{body} Number {i} is here as well.", *(f"{n}{i}" for n in names)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    want = {r[2:] for r in rows}
    for _, f in corpus_pipeline.STAGES[:4]:
        got = f(spark, docs, SF)
        assert got.dtypes == docs.dtypes
        found = {tuple(r)[2:] for r in got.collect()}
        assert found and found <= want
