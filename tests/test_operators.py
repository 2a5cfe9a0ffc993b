import math
import random
import re

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import hashing as H
from siftline.operators import bloom, joins, morsels, timeline
from siftline.plans import cost_model as cost
from siftline.plans import experiments
from siftline.plans.probe_query import RUNTIME_FILTER, STRATEGIES, ProbeQuery
from siftline.sources import files, generators
from siftline.streaming.probe_stream import matching_totals

GOLDEN = {0: 0, 1: 824515495, 2: 1722258072, -1: 539527247, 4194304: 3579327333, 2147483647: 3192437470}


def test_hash32(spark):
    rows = spark.createDataFrame([(k,) for k in GOLDEN], "k long").select("k", H.hash32(F.col("k")).alias("h")).collect()
    assert {r.k: r.h for r in rows} == GOLDEN == {k: H.hash32_int(k) for k in GOLDEN}


def test_wrapping_multiply(spark):
    pairs = [(2**62, 4), (-(2**63), -1), (2**63 - 1, 2**63 - 1), (3037000500, 3037000500), (0, 5)]
    got = [r.p for r in spark.createDataFrame(pairs, "a long, b long").select(H.wrapping_multiply(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [(a * b + 2**63) % 2**64 - 2**63 for a, b in pairs]


@pytest.mark.parametrize(("b", "p", "pct", "scale", "ksum", "n"), [(1024, 8192, 0, 0, 0, 0), (1024, 8192, 1, 0, 3321, 81), (1024, 8192, 5, 0, 83845, 409), (1024, 8192, 50, 0, 2099200, 4096), (1024, 8192, 100, 0, 4198400, 8192), (8192, 4096, 25, 0, 524800, 1024), (1024, 8192, 5, 4, 21012, 408)])
def test_generator(spark, b, p, pct, scale, ksum, n):
    assert generators.expected(b, p, pct, scale) == (ksum, n)
    got = ProbeQuery(generators.probe_of_selectivity(spark, b, p, pct, scale), generators.incremental(spark, b), "key", "key").result().first()
    assert (got.ksum, got.n_matches) == (ksum, n)


def test_published_scale():
    assert generators.expected(1 << 29, 1 << 32, 1, 64) == (14411512794624, 42949632)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_strategies_agree_on_odd_input(spark, strategy):
    probe = spark.createDataFrame([(1,), (1,), (2,), (2**32 + 1,), (None,), (-5,)], "k long")
    build = spark.createDataFrame([(1,), (1,), (-5,), (None,)], "b long")
    got = ProbeQuery(probe, build, "k", "b", words=32).result(strategy).first()
    assert (got.ksum, got.n_matches) == (-3, 3)  # 2^32+1 shares its low bits with 1: the filter lets it through, the join doesn't
    empty = ProbeQuery(probe, build.limit(0), "k", "b", words=None).result(strategy).first()
    assert (empty.ksum, empty.n_matches) == (0, 0)
    none = ProbeQuery(probe.limit(0), build, "k", "b", words=32).result(strategy).first()
    assert (none.ksum, none.n_matches) == (0, 0)


def test_strategy_names(spark):
    with pytest.raises(ValueError):
        ProbeQuery(spark.range(1), spark.range(1), "id", "id").matches("other")


def test_hash_table_cases(spark):
    for build, probe in ((65536, 131072), (2048, 4096)):
        assert joins.semi(spark.range(probe), spark.range(build), "id", "id").count() == build
        assert joins.anti(spark.range(probe), spark.range(build), "id", "id").count() == probe - build


def test_lookup_matches_once(spark):
    build = spark.createDataFrame([(1, 10), (1, 7), (2, 5)], "b long, p1 long")
    got = joins.lookup(spark.createDataFrame([(1,), (1,), (3,)], "k long"), build, "k", "b", ["p1"]).collect()
    assert [(r.k, r.p1) for r in got] == [(1, 7), (1, 7)]


def test_lookup_gives_a_row_of_the_build_side(spark):
    build = spark.createDataFrame([(1, 1, 9), (1, 2, 3), (2, None, 4), (2, None, 3)], "b long, p1 long, p2 long")
    got = joins.lookup(spark.createDataFrame([(1, 5), (2, 6)], "k long, p3 long"), build, "k", "b", ["p1", "p2"])
    assert got.columns == ["k", "p3", "p1", "p2"]
    assert sorted(map(tuple, got.collect())) == [(1, 5, 1, 9), (2, 6, None, 3)]


@pytest.mark.parametrize("text", ["1,1,1,4", "1,1,1,6", "16,1,1,5", "32,1,1,2", "16,16,2,4", "4,4,4,8", "1,4,2,6", "8,2,2,10"])
def test_filter_has_no_false_negatives_and_the_expected_rate(spark, text):
    shape = bloom.Shape.parse(text)
    words, n = 1 << 11, 4096
    keys = spark.range(n)
    filter_words = bloom.build(keys, "id", words, shape).persist()
    assert bloom.candidates(keys, "id", filter_words, words, shape).count() == n
    others = spark.range(1_000_000, 1_060_000)
    rate = bloom.candidates(others, "id", filter_words, words, shape).count() / 60_000
    filter_words.unpersist()
    assert rate == pytest.approx(cost.fpr_sectorized(words * 32, n, shape.block_words, shape.sectors, shape.zones, shape.k), rel=0.3, abs=5e-4)  # the formula takes a mean fill, so it is low for small blocks


@pytest.mark.parametrize("text", ["3,1,1,4", "1,1,1,0", "1,1,1,16", "4,2,4,4", "1,64,1,4", "4,4,2,5"])
def test_shapes_that_are_none(text):
    with pytest.raises(ValueError):
        bloom.Shape.parse(text)


@pytest.mark.parametrize("text", ["1,1,1,4", "16,1,1,5", "16,16,2,4"])
def test_insert_until_the_first_failure(spark, text):
    """Keys one after the other; a key that is in already ends it, and both ways to look up agree on all keys before and after."""
    shape = bloom.Shape.parse(text)
    words, keys = 1 << 7, list(range(1, 2001))
    pairs = bloom.words_and_masks(F.col("_hash"), words, shape)
    rows = bloom.hashed(spark.createDataFrame([(k,) for k in keys], "id long"), "id").select("id", F.array(*(F.struct(w.alias("w"), m.alias("m")) for w, m in pairs)).alias("x")).collect()
    bits = {r.id: [(p.w, p.m) for p in r.x] for r in rows}
    table, accepted = [0] * words, []
    for k in keys:
        if all(~table[w] & m == 0 for w, m in bits[k]):
            break
        for w, m in bits[k]:
            table[w] |= m
        accepted.append(k)
    assert 20 < len(accepted) < 2000
    built = bloom.build(spark.createDataFrame([(k,) for k in accepted], "id long"), "id", words, shape)
    assert {r.word: r.bits for r in built.collect()} == {w: b for w, b in enumerate(table) if b}
    flags = {r.id: r.flag for r in bloom.flagged(spark.createDataFrame([(k,) for k in keys], "id long"), "id", built, words, shape).collect()}
    assert flags == {k: all(~table[w] & m == 0 for w, m in bits[k]) for k in keys}
    assert all(flags[k] for k in accepted) and flags[len(accepted) + 1]


def test_filters_are_sized_by_the_build_side(spark):
    for n in (0, 1, 84, 86, 10_000, 1 << 20):
        words = bloom.words_for(n)
        assert words & (words - 1) == 0 and words >= 32 and 32 * words >= 12 * n
        assert words == duckdb.sql(f"select {bloom.words_for_sql(str(n))}").fetchall()[0][0]


def test_hash_is_computed_once_a_row(spark):
    """The filter's condition reads the hash as a column, whatever is pushed where."""
    words, shape = 1 << 8, bloom.Shape()
    filter_words = bloom.build(spark.range(100), "id", words, shape)
    plan = bloom.candidates(spark.range(1000), "id", filter_words, words, shape)._jdf.queryExecution().executedPlan().toString()
    (condition,) = re.findall(r"Filter .*", plan)[:1]
    assert "73244475" not in condition and len(condition) < 2000


@pytest.mark.parametrize("text", ["1,1,1,3", "4,1,1,3"])
def test_large_filters_are_joined(spark, monkeypatch, text):
    words, shape = 1 << 8, bloom.Shape.parse(text)
    filter_words = bloom.build(spark.range(100), "id", words, shape)
    small = bloom.flagged(spark.range(1000), "id", filter_words, words, shape).orderBy("id").collect()
    monkeypatch.setattr(bloom, "BROADCAST_WORDS", 1)
    assert bloom.flagged(spark.range(1000), "id", filter_words, words, shape).orderBy("id").collect() == small
    query = ProbeQuery(spark.range(1000), spark.range(100), "id", "id")
    assert "Filter" not in query.result("bloom")._jdf.queryExecution().optimizedPlan().toString().replace("Filter isnotnull", "")


def test_runtime_filters_leave_the_session_as_it_was(spark):
    before = {k: spark.conf.get(k) for k in RUNTIME_FILTER}
    result = ProbeQuery(spark.range(1000), spark.range(100).filter("id % 7 = 3"), "id", "id").result("catalyst")
    assert {k: spark.conf.get(k) for k in RUNTIME_FILTER} == before
    assert tuple(result.first()) == (sum(i for i in range(100) if i % 7 == 3), 14)


def test_work_between_filter_and_join_changes_no_answer(spark):
    query = ProbeQuery(spark.range(1000), spark.range(100), "id", "id", repeats=30)
    assert {tuple(query.result(s).first()) for s in STRATEGIES} == {(4950, 100)}
    query.release()
    assert query.persisted == []


@pytest.mark.parametrize(("bits", "lanes", "want"), [(0xFF, 8, list(range(8))), (1, 8, [0]), (0x11111111, 30, [0, 4, 8, 12, 16, 20, 24, 28]), (0xFFFFFFFF, 3, [0, 1, 2])])
def test_selection(spark, bits, lanes, want):
    words = spark.createDataFrame([(0, bits)], "word long, bits long")
    assert sorted(r.position for r in bloom.selection(words, lanes).collect()) == want


def test_bitmap_and_back(spark):
    flags = spark.range(100).select("id", (F.col("id") % 7 == 0).alias("f"))
    back = bloom.selection(bloom.bitmap(flags, "id", "f"), 100)
    assert sorted(r.position for r in back.collect()) == list(range(0, 100, 7))


@pytest.mark.parametrize(("w", "s", "z", "k", "m", "n", "published"), [(16, 1, 1, 3, 2147483648, 536870912, 0.14783), (16, 1, 1, 5, 4294967296, 536870912, 0.0231334), (8, 1, 1, 2, 536870912, 268435456, 0.399533), (1, 1, 1, 3, 67108864, 16777216, 0.16077), (32, 1, 1, 5, 4294967296, 536870912, 0.0224099), (16, 16, 2, 4, 536870912, 67108864, 0.027422), (16, 2, 2, 10, 1073741824, 67108864, 0.000828524)])
def test_published_rates(w, s, z, k, m, n, published):
    assert cost.fpr_sectorized(m, n, w, s, z, k) == pytest.approx(published, rel=0.07)


def test_rates_in_spark_equal_python(spark):
    blocked = cost.blocked_rates(spark.createDataFrame([(1 << 22, 1 << 20, 3, 512)], "m int, n int, k int, block int")).first().fpr
    assert blocked == pytest.approx(cost.fpr_sectorized(1 << 22, 1 << 20, 16, 1, 1, 3), rel=1e-6)
    sector = cost.sectorized_rates(spark.createDataFrame([(1 << 24, 1 << 20, 4, 512, 16, 2)], "m int, n int, k int, block int, s int, z int")).first().fpr
    assert sector == pytest.approx(cost.fpr_sectorized(1 << 24, 1 << 20, 16, 16, 2, 4), rel=1e-6)


#: Published nanoseconds a lookup for 1, 2, 4 ... 512 MiB.
PUBLISHED_NS = {
    "gtx1080 pcie": "0.3362 0.3363 0.4563 0.6000 0.6870 0.7363 0.7625 0.7761 0.7831 0.7864",
    "gtx1080 cached": "0.1553 0.1844 0.3866 0.5551 0.6556 0.7134 0.7445 0.7606 0.7688 0.7728",
    "gtx1080ti pcie": "0.3419 0.3384 0.3399 0.3639 0.4333 0.4746 0.5049 0.5104 0.5166 0.5204",
    "gtx1080ti cached": "0.1358 0.1252 0.1921 0.3154 0.3986 0.4474 0.4759 0.4910 0.4987 0.5033",
    "gtx1050ti pcie": "0.3420 0.3393 0.3401 0.3759 0.4469 0.4856 0.5009 0.5244 0.5268 0.5250",
    "gtx1050ti cached": "0.1358 0.1254 0.1935 0.3177 0.3961 0.4521 0.4759 0.4910 0.5045 0.5026",
}


def test_published_lookup_times():
    assert {tuple(k.split()): tuple(map(float, v.split())) for k, v in PUBLISHED_NS.items()} == cost.LOOKUP_NS


def test_max_selectivity_is_where_the_rule_turns():
    for lookup, work, fpr in ((0.5, 2.0, 0.01), (0.1, 50, 0.2), (3, 2, 0.0)):
        limit = cost.max_selectivity(lookup, work, fpr)
        assert 0 <= limit < 1
        assert not cost.worth_it(lookup, work, limit + 1e-9, fpr)
        if limit:
            assert cost.worth_it(lookup, work, limit - 1e-9, fpr)


def test_description_of_both_devices(spark):
    m = 64 * cost.MIB_BITS
    lines = cost.describe(cost.FilterChoice(16, 1, 1, 5, m, 4.0), cost.FilterChoice(16, 16, 2, 4, m, cost.lookup_ns("gtx1080", "pcie", m)), 3000, 1 << 20, 1 << 16, 0.05)
    assert [line.split(" smaller ")[1].split()[0] for line in lines] == ["NOT", "NOT"] and lines[0].endswith("smaller")
    rows = files.parse_config_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.device, r.w, r.s, r.z, r.k, r.m, r.tw, r.build_size) for r in rows] == [("CPU", 16, 1, 1, 5, m, 3000, 1 << 16), ("GPU", 16, 16, 2, 4, m, 3000, 1 << 16)]
    assert rows[0].fpr == pytest.approx(cost.fpr_sectorized(m, 1 << 16, 16, 1, 1, 5), rel=1e-4, abs=1e-12)


def test_model(spark):
    best = {(r.device, r.mode): r for r in cost.best_parameters(cost.overhead_grid(spark, 1 << 24, 1.0)).collect()}
    assert (best["gtx1080", "cached"].size_mib, best["gtx1080", "cached"].k) == (16, 5)
    assert best["gtx1080", "cached"].overhead == pytest.approx(0.678, abs=2e-3)
    assert best["gtx1050ti", "pcie"].overhead == pytest.approx(0.469, abs=2e-3)
    assert cost.lookup_ns("gtx1080", "pcie", cost.MIB_BITS + 1) == 0.3363
    with pytest.raises(ValueError):
        cost.lookup_ns("gtx1080", "pcie", 1024 * cost.MIB_BITS)
    assert cost.worth_it(1, 10, 0.1, 0.01) and not cost.worth_it(10, 10, 0.1, 0.01)


def test_timeline_edges(spark):
    rows = [(1, 1, 10, "a"), (1, 2, 10, "a"), (1, 3, 15, "b"), (2, 4, 7, "a"), (1, 5, 20, None), (1, 6, 21, None)]
    events = spark.createDataFrame(rows, "w int, id int, tick long, name string").withColumn("n", F.lit(1))
    got = {(r.w, r.island): (r.name, r.t, r.len, r.n) for r in timeline.islands(events, "w", "tick", "id", "name", "n").collect()}
    assert got == {(1, 1): ("a", 3, 5, 2), (1, 2): ("b", 8, 5, 1), (1, 3): (None, 13, 1, 2), (2, 1): ("a", 0, None, 1)}


def test_files(spark, tmp_path):
    keys = spark.createDataFrame([(5,), (-7,), (2**31 - 1,)], "key int")
    path = f"file://{tmp_path}/column"
    files.write_column(keys, "key", path, rows_per_block=2)
    assert sorted(r.key for r in files.read_column(spark, path, scale=2).collect()) == [-7, -7, 5, 5, 2**31 - 1, 2**31 - 1]
    made = []
    for _ in range(2):
        assert files.cached(spark, f"file://{tmp_path}/cache", lambda: made.append(1) or keys).count() == 3
    assert len(made) == 1
    line = spark.createDataFrame([("w 16 s 1 z 1 k 3 m 2147483648 CPU  slowdown 0 filtersize 4294967296 tw 3666 probe_size 4294967296 build_size 536870912 fpr0.14783",)], "value string")
    got = files.parse_config_lines(line).first()
    assert (got.device, got.w, got.k, got.m, got.tw, got.fpr) == ("CPU", 16, 3, 2147483648, 3666, 0.14783)


def test_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1,), (1,), (2,), (3,)], "k long").write.parquet(source)
    stream = spark.readStream.schema("k long").parquet(source)
    run = matching_totals(stream, spark.createDataFrame([(1,), (1,), (3,)], "b long"), "k", "b").writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").start()
    run.processAllAvailable()
    run.stop()
    assert [tuple(r) for r in spark.sql("select * from totals").collect()] == [(5, 3)]


@given(st.integers(1, 10**9))
def test_words_for(n):
    words = bloom.words_for(n)
    assert words & (words - 1) == 0
    assert words == 32 or words / 2 * 32 < n * 12 <= words * 32
    assert math.log2(words) >= 5


def test_sweep_and_log(spark, tmp_path):
    log = experiments.PhaseLog()
    rows = experiments.sweep(spark, ("none",), experiments.grid(percent=(0, 50)), 64, 512, warm_ups=0, runs=1, log=log).collect()
    assert [(r.selectivity, r.n_matches) for r in rows] == [(0, 0), (50, 256)]
    for _ in range(2):
        log.push("DONE")
        log.flush(spark, f"file://{tmp_path}/log")
    assert files.read_delimited(spark, f"file://{tmp_path}/log", experiments.EVENT).count() == 4


def test_sweeps_over_work_filter_size_and_morsels(spark):
    points = [*experiments.grid(percent=(5,), repeats=(0, 4), words=(32, 256)), *experiments.grid(percent=(50,), morsel_rows=(100, 1000))]
    rows = experiments.sweep(spark, ("bloom",), points, 64, 512, warm_ups=0, runs=1).collect()
    assert [(r.repeats, r.filter_words, r.morsel_rows, r.n_matches) for r in rows] == [(0, 32, 0, 25), (0, 256, 0, 25), (4, 32, 0, 25), (4, 256, 0, 25), (0, 0, 100, 256), (0, 0, 1000, 256)]
    assert all("percent" in p for e in experiments.EXPERIMENTS.values() for p in e)


def test_datasets_with_their_sums(spark, tmp_path):
    paths = experiments.write_datasets(spark, f"file://{tmp_path}", (0, 50), 64, 512)
    for p, path in paths.items():
        keys = spark.read.parquet(path)
        assert keys.count() == 512
        assert files.read_scalar(spark, f"{path}-ksum") == generators.expected(64, 512, p)[0]


def test_numbers_in_key_order(spark):
    r = random.Random(3)
    keys = [r.choice([None, 1, 2, 2, 5, r.randint(-50, 5000)]) for _ in range(3000)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(5)
    got = sorted(morsels.numbered(rows, "k", ("i",), buckets=7).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(3000))
    assert [(r.k, r.i) for r in got] == sorted(((k, i) for i, k in enumerate(keys)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert morsels.numbered(rows.limit(0), "k").collect() == []


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_morsels_of_a_partition(spark, size):
    made = morsels.map_morsels(spark.range(0, 100, 1, 3), lambda t: pa.RecordBatch.from_pydict({"n": [t.num_rows], "s": [sum(t["id"].to_pylist())]}), "n long, s long", size).collect()
    assert sum(r.s for r in made) == 4950 and all(r.n <= size for r in made)
    assert sum(r.n < size for r in made) <= 3


def test_unique_longs_fill_both_halves(spark):
    keys = [r.key for r in generators.unique64(spark, 4096, 3).collect()]
    assert len(set(keys)) == 4096
    for half in ([k >> 32 for k in keys], [k & 0xFFFFFFFF for k in keys]):
        assert len(set(half)) > 4090
        assert abs(sum(h >> 31 & 1 for h in half) - 2048) < 300


def test_raw_columns_refuse_nulls(spark, tmp_path):
    with pytest.raises(Exception, match="nulls"):
        files.write_column(spark.createDataFrame([(1,), (None,)], "key int"), "key", f"file://{tmp_path}/nulls")


def test_options():
    assert files.parse_options(["--tw=5", "--gpu", "--tw=6", "--conf=16,1,1,5"]) == {"tw": "6", "gpu": "1", "conf": "16,1,1,5"}
    for bad in ("tw=5", "--", "-x"):
        with pytest.raises(ValueError):
            files.parse_options([bad])
