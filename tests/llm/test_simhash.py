import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import simhash_dedup as S
from siftline.llm.components import star_roots
from tests.conftest import SF


def slow_fingerprint(text: str | None) -> int:
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps: list[int], distance: int = 4) -> list[int]:
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted(((d, f"{f:016x}", rows[g][0]) for (d, _), f, g in zip(rows, fps, slow_groups(fps), strict=True)), key=repr)
    assert sorted((tuple(r) for r in S.simhash_groups(docs).collect()), key=repr) == want


def test_documents(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_documents(spark, odd, empty):
    check(odd)
    assert S.simhash_groups(empty).collect() == []


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_join_exactly_the_close(spark, tile):
    """Chains, dense clusters and lone fingerprints; small tiles split the buckets."""
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:6]:
        for _ in range(40):
            for _ in range(r.randint(1, 4)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for n in (len(fps), 10**6, 10**9):
        links = S.close_fingerprints(table, n, tile=tile)
        assert links.count() < 200 * len(fps)
        roots = {x.u: x.v for x in star_roots(links).collect()}
        groups: dict = {}
        for f, g in zip(fps, slow_groups(fps), strict=True):
            groups.setdefault(g, set()).add(int(np.uint64(f).astype(np.int64)))
        found: dict = {}
        for (f,) in table.collect():
            found.setdefault(roots.get(f, f), set()).add(f)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_pigeonhole_blocks():
    assert [S.n_blocks(n, 4) for n in (10, 10**6, 10**8, 10**12)] == [5, 6, 7, 8]


def test_components_of_a_long_path_and_a_star(spark):
    path = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    star = spark.range(1000, 1400).select(F.lit(5000).cast("long").alias("u"), F.col("id").alias("v"))
    got = {r.u: r.v for r in star_roots(path.union(star).union(path)).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{i: 1000 for i in range(1001, 1400)}, 5000: 1000}


def test_one_of_each_group(spark, odd):
    """Against the plain groups of all rows: the first of each by (null last, doc_id, fingerprint) stays, once."""
    kept = S.one_of_each_group(odd)
    assert kept.dtypes == odd.dtypes
    rows = sorted((tuple(r) for r in odd.collect()), key=lambda r: (r[0] is None, r[0] or 0, slow_fingerprint(r[1])))
    groups = slow_groups([slow_fingerprint(r[1]) for r in rows])
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted((rows[g] for g in set(groups)), key=repr)


def test_unlike_rows_of_one_id_both_stay(spark):
    a, b = ("alpha beta gamma delta epsilon " * 9, "one two three four five six seven " * 9)
    docs = spark.createDataFrame([(1, a, 5), (1, b, 6), (1, a, 5), (2, a, 7)], "doc_id long, text string, row int")
    assert sorted(r.row for r in S.one_of_each_group(docs).collect()) == [5, 6]
