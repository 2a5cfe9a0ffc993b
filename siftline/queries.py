"""The library's own queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import hashing as H
from siftline.operators import bloom, joins, morsels, profiles, timeline
from siftline.plans import cost_model as cost
from siftline.plans import experiments
from siftline.plans.probe_query import ProbeQuery
from siftline.session import ship_package
from siftline.sources import files, generators

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BITS = 6
SHAPE = bloom.Shape()
URGENT = "o_orderpriority = '1-URGENT'"
BUILD_SQL = f"(select o_orderkey from orders where {URGENT})"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _probe(spark: SparkSession, sf_dir: str) -> ProbeQuery:
    return ProbeQuery(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders").filter(URGENT), "l_orderkey", "o_orderkey", bits=BITS)


def _scratch(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/siftline-{name}-{uuid.uuid4().hex}"


# --- joins and strategies -------------------------------------------------------------------------

SEMI_SQL = f"select cast(coalesce(sum(l_orderkey), 0) as bigint) as ksum, count(*) as n_matches from lineitem where l_orderkey in {BUILD_SQL}"


@query(SEMI_SQL)
def probe_semi_sum(spark, sf_dir):
    return _probe(spark, sf_dir).result()


for _name, _strategy in (("probe_no_filter", "none"), ("probe_bloom", "bloom"), ("probe_bloom_clustered", "bloom_clustered"), ("probe_bloom_cached", "bloom_cached"), ("probe_catalyst_filter", "catalyst")):
    QUERIES[_name] = lambda spark, sf_dir, s=_strategy: _probe(spark, sf_dir).result(s)
    ORACLE_SQL[_name] = SEMI_SQL


@query(f"""select cast(coalesce(sum(l_orderkey), 0) as bigint) as ksum, cast(coalesce(sum(p1) + sum(p2), 0) as bigint) as psum
from lineitem join (select o_orderkey, o_custkey as p1, cast(round(o_totalprice * 100) as bigint) as p2 from orders where {URGENT} qualify row_number() over (partition by o_orderkey order by p1, p2) = 1) b on l_orderkey = o_orderkey""")
def probe_inner_payload_sum(spark, sf_dir):
    build = _t(spark, sf_dir, "orders").filter(URGENT).select("o_orderkey", F.col("o_custkey").alias("p1"), F.round(F.col("o_totalprice") * 100).cast("long").alias("p2"))
    found = joins.lookup(_t(spark, sf_dir, "lineitem").select("l_orderkey"), build, "l_orderkey", "o_orderkey", ["p1", "p2"])
    return found.agg(joins.sum_or_zero("l_orderkey").alias("ksum"), (joins.sum_or_zero("p1") + joins.sum_or_zero("p2")).alias("psum"))


@query(f"""select cast(coalesce(sum(l_orderkey), 0) as bigint) as ksum, count(*) as n_matches from lineitem where l_orderkey in {BUILD_SQL}
and l_partkey in (select p_partkey from part where p_size <= 25) and l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)""")
def probe_multi_table(spark, sf_dir):
    steps = [(_t(spark, sf_dir, "orders").filter(URGENT), "l_orderkey", "o_orderkey"), (_t(spark, sf_dir, "part").filter("p_size <= 25"), "l_partkey", "p_partkey"), (_t(spark, sf_dir, "supplier").filter("s_acctbal > 0"), "l_suppkey", "s_suppkey")]
    rows = joins.pipelined(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), steps)
    return rows.agg(joins.sum_or_zero("l_orderkey").alias("ksum"), F.count(F.lit(1)).alias("n_matches"))


@query(f"select count(*) as n, cast(coalesce(sum(l_orderkey), 0) as bigint) as ksum from lineitem l where not exists (select 1 from {BUILD_SQL} b where b.o_orderkey = l.l_orderkey)")
def probe_anti_count(spark, sf_dir):
    q = _probe(spark, sf_dir)
    rows = joins.anti(q.probe.select("l_orderkey"), q.build, "l_orderkey", "o_orderkey")
    return rows.agg(F.count(F.lit(1)).alias("n"), joins.sum_or_zero("l_orderkey").alias("ksum"))


@query(f"select cast(coalesce(sum(l_orderkey), 0) as bigint) as expected from lineitem where l_orderkey in {BUILD_SQL}")
def expected_ksum(spark, sf_dir):
    q = _probe(spark, sf_dir)
    return q.matches().agg(joins.sum_or_zero("l_orderkey").alias("expected"))


# --- Bloom filters --------------------------------------------------------------------------------

SIZE_SQL = f"size as (select {bloom.words_for_sql('count(*)')} as words from {BUILD_SQL})"


def _words_sql(shape: bloom.Shape) -> str:
    """(word, bits) of the build side's filter, sized by its rows."""
    pairs = bloom.words_and_masks_sql("h", "words", shape)
    rows = " union all ".join(f"select {w} as word, {m} as mask from b" for w, m in pairs)
    return f"""with {SIZE_SQL}, b as (select {H.hash32_sql("o_orderkey")} as h, words from {BUILD_SQL}, size), r as ({rows}) select word, cast(bit_or(mask) as bigint) as bits from r group by 1"""


def _flags_sql(shape: bloom.Shape) -> str:
    pairs = bloom.words_and_masks_sql("h", "words", shape)
    tests = " and ".join(f"coalesce((select bits from bf where bf.word = {w}) & {m} = {m}, false)" for w, m in pairs)
    return f"""{SIZE_SQL}, bf as ({_words_sql(shape)}), p as (select l_orderkey, l_linenumber, {H.hash32_sql("l_orderkey")} as h, words from lineitem, size), flags as (select l_orderkey, l_linenumber, {tests} as flag from p)"""


WORDS_SQL, FLAGS_SQL = _words_sql(SHAPE), _flags_sql(SHAPE)


def _flagged(spark, sf_dir, shape: bloom.Shape = SHAPE) -> DataFrame:
    q = _probe(spark, sf_dir)
    q.shape = shape
    words, n = q.filter_words()
    return bloom.flagged(q.probe.select("l_orderkey", "l_linenumber"), "l_orderkey", words, n, shape)


@query(WORDS_SQL)
def bloom_words(spark, sf_dir):
    return _probe(spark, sf_dir).filter_words()[0]


@query(f"with {FLAGS_SQL} select count(*) as n, count(distinct l_orderkey) as n_keys from flags where flag")
def bloom_candidates(spark, sf_dir):
    return _flagged(spark, sf_dir).filter("flag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("n_keys"))


@query(f"with {FLAGS_SQL} select l_orderkey as key from flags where flag")
def bloom_candidate_keys(spark, sf_dir):
    q = _probe(spark, sf_dir)
    words, n = q.filter_words()
    return bloom.candidates(bloom.clustered(q.probe.select("l_orderkey"), "l_orderkey", BITS), "l_orderkey", words, n, SHAPE).select(F.col("l_orderkey").alias("key"))


@query(f"with {FLAGS_SQL} select flag, count(*) as n from flags group by flag")
def bloom_flag_counts(spark, sf_dir):
    return _flagged(spark, sf_dir).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


#: Blocks of several words, without and with sectors.
SHAPES = {"block": bloom.Shape.parse("16,1,1,5"), "sector": bloom.Shape.parse("16,16,2,4"), "zone": bloom.Shape.parse("4,4,4,8")}
for _name, _shape in SHAPES.items():
    QUERIES[f"bloom_{_name}_words"] = lambda spark, sf_dir, shape=_shape: (lambda q: bloom.build(q.build, q.build_key, q.filter_words()[1], shape))(_probe(spark, sf_dir))
    ORACLE_SQL[f"bloom_{_name}_words"] = _words_sql(_shape)
    QUERIES[f"bloom_{_name}_flags"] = lambda spark, sf_dir, shape=_shape: _flagged(spark, sf_dir, shape).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("ksum"))
    ORACLE_SQL[f"bloom_{_name}_flags"] = f"with {_flags_sql(_shape)} select flag, count(*) as n, cast(sum(l_orderkey) as bigint) as ksum from flags group by flag"


@query(f"with {FLAGS_SQL} select l_orderkey as key, flag, l_linenumber as line from flags")
def bloom_flags_in_hash_order(spark, sf_dir):
    """The flags of all rows, clustered by hash and not compacted."""
    q = _probe(spark, sf_dir)
    words, n = q.filter_words()
    rows = bloom.flagged(bloom.clustered(q.probe.select("l_orderkey", "l_linenumber"), "l_orderkey", BITS), "l_orderkey", words, n, SHAPE)
    return rows.select(F.col("l_orderkey").alias("key"), "flag", F.col("l_linenumber").alias("line"))


POSITION_SQL = "l_orderkey * 8 + l_linenumber - 1"
BITMAP_SQL = f"with {FLAGS_SQL} select ({POSITION_SQL}) // 32 as word, cast(bit_or(case when flag then 1::bigint << (({POSITION_SQL}) % 32)::int else 0::bigint end) as bigint) as bits from flags group by 1"


def _bitmap(spark, sf_dir) -> DataFrame:
    lanes = _flagged(spark, sf_dir).withColumn("position", F.col("l_orderkey") * 8 + F.col("l_linenumber") - 1)
    return bloom.bitmap(lanes, "position", "flag")


@query(BITMAP_SQL)
def bloom_bitmap(spark, sf_dir):
    return _bitmap(spark, sf_dir)


@query(f"select word * 32 + lane as position from ({BITMAP_SQL}), (select unnest(range(32)) as lane) where (bits >> lane::int) & 1 = 1")
def bitmap_to_selection(spark, sf_dir):
    return bloom.selection(_bitmap(spark, sf_dir))


@query("select 0::bigint as n_missed")
def bloom_no_false_negative(spark, sf_dir):
    q = _probe(spark, sf_dir)
    words, n = q.filter_words()
    return bloom.flagged(q.build.select("o_orderkey"), "o_orderkey", words, n, SHAPE).agg(F.count_if(~F.col("flag")).alias("n_missed"))


@query(f"""with {FLAGS_SQL}, b as (select distinct o_orderkey from {BUILD_SQL}), c as (select count(*) as pre_filter, count(*) filter (where flag) as post_filter,
count(*) filter (where flag and l_orderkey in (select o_orderkey from b)) as post_join from flags)
select pre_filter, post_filter, post_filter as pre_join, post_join, pre_filter as filter_probed, pre_filter as filter_consumed, pre_filter as processed, pre_filter as morsel_rows,
round(100.0::double * post_filter / nullif(pre_filter, 0), 6) as filter_pct, round(100.0::double * post_join / nullif(post_filter, 0), 6) as join_pct from c""")
def pipeline_counters(spark, sf_dir):
    return _probe(spark, sf_dir).counters()


@query(f"select {H.hash32_sql('l_orderkey')} >> {32 - BITS} as prefix, count(*) as n, min(l_orderkey) as least from lineitem group by 1")
def radix_partition_histogram(spark, sf_dir):
    top = H.prefix(H.hash32(F.col("l_orderkey")), BITS)
    return _t(spark, sf_dir, "lineitem").groupBy(top.alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("least"))


# --- hashes and expressions -----------------------------------------------------------------------


@query(f"select o_orderkey as key, {H.hash32_sql('o_orderkey')} as h from orders")
def hash32_keys(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), H.hash32(F.col("o_orderkey")).alias("h"))


@query(f"select {H.hash32_sql('o_orderkey')} & 1023 as slot, count(*) as n from orders group by 1")
def hash_slot_histogram(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy(H.slot(H.hash32(F.col("o_orderkey")), 1024).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey as key, cast((o_orderkey & 4294967295)::hugeint * 2654435761 % 4294967296 as bigint) as h from orders")
def mult_hash_keys(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), H.multiplicative_hash(F.col("o_orderkey")).alias("h"))


def _wrap_sql(x: str) -> str:
    whole = f"((({x}) % 18446744073709551616::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint)"
    return f"case when {whole} >= 9223372036854775808::hugeint then {whole} - 18446744073709551616::hugeint else {whole} end"


@query(f"""with a as (select {H.hash32_sql("l_orderkey")} as t1, {H.hash32_sql("l_partkey")} as t2, {H.hash32_sql("l_suppkey")} as t3 from lineitem),
b as (select {_wrap_sql("t2::hugeint * t3::hugeint")} as t1, t2 from a), c as (select t1, t2, {_wrap_sql("t1 * t2::hugeint")} as t3 from b), d as (select {_wrap_sql("t1 * t2::hugeint")} as t3, t1 from c)
select cast(sum(t3 % 1000003) as bigint) as checksum, cast(min(t1) as bigint) as least from d""")
def expensive_op_sum(spark, sf_dir):
    keys = (H.hash32(F.col(c)) for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    t1, _, t3 = H.expensive(3, *keys)
    rows = _t(spark, sf_dir, "lineitem").select(t1.alias("t1"), t3.alias("t3"))
    return rows.agg(F.sum(F.col("t3") % 1000003).alias("checksum"), F.min("t1").alias("least"))


@query("""select o_orderkey as key, case when v >= 1073741824 then printf('%.1f~Gi', v / 1073741824.0::double) when v >= 1048576 then printf('%.1f~Mi', v / 1048576.0::double)
when v >= 1024 then printf('%.1f~Ki', v / 1024.0::double) else v::varchar end as label from (select o_orderkey, 1::bigint << (o_orderkey % 40)::int as v from orders)""")
def unit_format(spark, sf_dir):
    v = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("o_orderkey") % 40).cast("int"))
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), H.unit_text(v).alias("label"))


@query("select f as percent, n as workers, round(1.0 / ((1.0 - f / 100.0::double) + f / 100.0::double / n), 9) as speedup from (select unnest(range(0, 101, 5)) as f), (select unnest([1, 2, 4, 8, 16]) as n)")
def amdahl(spark, sf_dir):
    grid = spark.range(0, 101, 5).select(F.col("id").alias("percent"), F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16)))).alias("workers"))
    return grid.withColumn("speedup", F.round(H.amdahl(F.col("percent") / 100.0, F.col("workers")), 9))


# --- generators, morsels, files -------------------------------------------------------------------


@query("select r as key, r + 1 as p1, r + 2 as p2 from (select unnest(range(1, 4097)) as r)")
def gen_incremental(spark, sf_dir):
    return generators.incremental(spark, 4096, 2)


@query("select 8192::bigint as n, 8192::bigint as n_distinct")
def gen_unique(spark, sf_dir):
    keys = generators.unique32(spark, 4096, 7).withColumn("kind", F.lit(32)).union(generators.unique64(spark, 4096, 7).withColumn("kind", F.lit(64)))
    return keys.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind", "key").alias("n_distinct"))


def _generated(spark, sf_dir, percent: int, scale: int = 0) -> DataFrame:
    probe = generators.probe_of_selectivity(spark, 1024, 8192, percent, scale)
    rows = ProbeQuery(probe, generators.incremental(spark, 1024), "key", "key").result()
    return rows.withColumn("percent", F.lit(percent))


def _closed_sql(percent: int, scale: int = 0) -> str:
    times = max(1, scale)
    m = f"(({percent} * (8192 // {times})) // 100)"
    return f"select cast((({m} // 1024) * (1024 * 1025 // 2) + ({m} % 1024) * ({m} % 1024 + 1) // 2) * {times} as bigint) as ksum, cast({m} * {times} as bigint) as n_matches, {percent} as percent"


for _p in (0, 1, 5, 50, 100):
    QUERIES[f"gen_selectivity_{_p}"] = lambda spark, sf_dir, p=_p: _generated(spark, sf_dir, p)
    ORACLE_SQL[f"gen_selectivity_{_p}"] = _closed_sql(_p)


@query(_closed_sql(5, 4))
def gen_replicated(spark, sf_dir):
    return _generated(spark, sf_dir, 5, 4)


@query("select cast(sum(l_orderkey) as bigint) as total, count(*) as n from lineitem")
def scan_checksum(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").agg(F.sum("l_orderkey").alias("total"), F.count(F.lit(1)).alias("n"))


@query("select m as morsel, m * 16384 as begin_row, least((m + 1) * 16384, n) as end_row from (select count(*) as n from lineitem), (select unnest(range(n // 16384 + 1)) as m from (select count(*) as n from lineitem)) where m * 16384 < n")
def morsel_ranges(spark, sf_dir):
    return morsels.ranges(_t(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n")))


NUMBERED_SQL = "o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as position from orders)"


def _numbered(spark, sf_dir) -> DataFrame:
    return morsels.numbered(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"with {NUMBERED_SQL} select position // 1024 as vector, count(*) as n, cast(sum(o_orderkey) as bigint) as total from o group by 1")
def vector_chunks(spark, sf_dir):
    return _numbered(spark, sf_dir).groupBy(morsels.block_of(F.col("position"), morsels.VECTOR).alias("vector")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@query(f"with {NUMBERED_SQL} select position, o_orderkey as key from o")
def identity_selection(spark, sf_dir):
    return _numbered(spark, sf_dir).select("position", F.col("o_orderkey").alias("key"))


@query("select cast(sum(l_orderkey) as bigint) as total, count(*) as n from lineitem")
def morsel_totals(spark, sf_dir):
    """Each task works off its rows a morsel at a time; the morsels' totals are added up."""

    def add(rows: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"total": [pc.sum(rows["l_orderkey"]).as_py()], "n": [rows.num_rows]}, pa.schema([("total", pa.int64()), ("n", pa.int64())]))

    ship_package(spark)
    parts = morsels.map_morsels(_t(spark, sf_dir, "lineitem").select("l_orderkey"), add, "total long, n long")
    return parts.agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


@query("select o_orderkey as key, 0 as p1, 0 as p2 from orders")
def csv_roundtrip(spark, sf_dir):
    path = _scratch(spark, "csv")
    files.write_delimited(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0).alias("p1"), F.lit(0).alias("p2")), path)
    return files.read_delimited(spark, path, "key long, p1 int, p2 int")


@query("select cast(o_orderkey as integer) as key from orders, range(2)")
def binary_column_roundtrip(spark, sf_dir):
    path = _scratch(spark, "column")
    files.write_column(_t(spark, sf_dir, "orders"), "o_orderkey", path)
    return files.read_column(spark, path, scale=2)


@query("""select case when o_orderkey % 2 = 0 then 'CPU' else 'GPU' end as device, 16::bigint as w, 1::bigint as s, 1::bigint as z, o_orderkey % 15 + 1 as k, (o_orderkey + 1) * 1024 as m,
o_orderkey % 7 * 50 as slowdown, o_orderkey * 8 as filtersize, o_custkey as tw, 4096::bigint as probe_size, o_orderkey as build_size, o_orderkey % 1000 / 1000.0::double as fpr from orders""")
def config_log_parse(spark, sf_dir):
    key = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    parts = [F.lit("w 16 s 1 z 1 k"), text(key % 15 + 1), F.lit("m"), text((key + 1) * 1024), F.when(key % 2 == 0, "CPU").otherwise("GPU"), F.lit(" slowdown"), text(key % 7 * 50), F.lit("filtersize"), text(key * 8), F.lit("tw"), text(F.col("o_custkey")), F.lit("probe_size 4096 build_size"), text(key), F.concat(F.lit("fpr"), F.format_string("%.3f", key % 1000 / 1000.0))]
    return files.parse_config_lines(_t(spark, sf_dir, "orders").select(F.concat_ws(" ", *parts).alias("value")))


@query("select o_orderkey || ' & ' || o_orderpriority || ' & ' || o_custkey || ' \\\\' as value from orders")
def latex_rows(spark, sf_dir):
    return files.latex_rows(_t(spark, sf_dir, "orders"), ["o_orderkey", "o_orderpriority", "o_custkey"])


def _answers_sql(strategies, points, build_rows: int, probe_rows: int) -> str:
    rows = []
    for st in strategies:
        for pt in points:
            ksum, n = generators.expected(build_rows, probe_rows, pt["percent"])
            rows.append(f"select '{st}' as strategy, " + ", ".join(f"{pt.get(k, 0)}::bigint as {k}" for k in ("percent", "repeats", "words", "morsel_rows")) + f", {ksum}::bigint as ksum, {n}::bigint as n_matches")
    return " union all ".join(rows)


SWEEPS = {
    "selectivity": (("none", "bloom"), experiments.grid(percent=(1, 50)), 512, 4096),
    "expensive_op": (("none", "bloom"), experiments.grid(percent=(5,), repeats=(0, 2, 6)), 512, 4096),
    "morsel": (("bloom",), experiments.grid(percent=(5,), morsel_rows=(512, 2048)), 512, 4096),
    "op_by_filter_size": (("bloom",), experiments.grid(percent=(5,), repeats=(0, 3), words=(64, 1024)), 512, 4096),
    "filter_size": (("bloom",), experiments.grid(percent=(5,), words=(32, 256, 4096)), 512, 4096),
}
for _name, _sweep in SWEEPS.items():
    QUERIES[f"experiment_{_name}"] = lambda spark, sf_dir, a=_sweep: experiments.answers(spark, *a)
    ORACLE_SQL[f"experiment_{_name}"] = _answers_sql(*_sweep)


@query("select o_orderkey as key, o_orderpriority || ' --tw ' || o_custkey || ' --print_bf_conf=1' as value from orders where o_orderkey % 3 = 0")
def log_lines_filter(spark, sf_dir):
    option = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" --tw ")).otherwise(F.lit(" --gpu "))
    lines = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.concat("o_orderpriority", option, F.col("o_custkey").cast("string")).alias("value"))
    return files.lines_with(lines, "--tw", "--print_bf_conf=1")


# --- cost model -----------------------------------------------------------------------------------

CONFIGS = [(m, 1 << 20, k, b) for m in (1 << 22, 1 << 23, 1 << 24) for k in (1, 3, 5) for b in (256, 512)]


def _values(rows) -> str:
    return ", ".join(str(tuple(r)) for r in rows)


def _pmf_sql(source: str, keys: str) -> str:
    return f"""r as (select *, block * n::double / m as rate from {source}),
    g as (select *, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 30) as bigint) + 1)) as i from r),
    q as (select *, exp(sum(case when i = 0 then 0.0 else ln(rate / i) end) over (partition by {keys} order by i) - rate) as pmf from g)"""


STD_SQL = "case when {n} <= 0 then 0.0 else pow(1 - pow(1 - 1.0::double / {b}, {k} * {n}), {k}) end"


@query(f"select m, n, k, round(pow(1 - pow(1 - 1.0::double / m, k * n), k), 6) as fpr from (values {_values(c[:3] for c in CONFIGS[::2])}) t(m, n, k)")
def fpr_standard(spark, sf_dir):
    rows = spark.createDataFrame([c[:3] for c in CONFIGS[::2]], "m int, n int, k int")
    return rows.withColumn("fpr", F.round(F.pow(1 - F.pow(1 - 1.0 / F.col("m"), F.col("k") * F.col("n")), F.col("k")), 6))


@query(f"with c as (select * from (values {_values(CONFIGS)}) t(m, n, k, block)), {_pmf_sql('c', 'm, n, k, block')} select m, n, k, block, round(sum(pmf * {STD_SQL.format(n='i', b='block', k='k')}), 6) as fpr from q group by all")
def fpr_blocked(spark, sf_dir):
    return cost.blocked_rates(spark.createDataFrame(CONFIGS, "m int, n int, k int, block int")).withColumn("fpr", F.round("fpr", 6))


SECTORS = [(1 << 24, 1 << 20, 4, 512, 16, 2), (1 << 23, 1 << 20, 6, 512, 16, 2), (1 << 23, 1 << 20, 4, 1024, 32, 4)]


@query(f"""with c as (select * from (values {_values(SECTORS)}) t(m, n, k, block, s, z)), {_pmf_sql("c", "m, n, k, block, s, z")},
j as (select *, unnest(range(0, i + 1)) as j, z::double / s as share from q),
o as (select *, exp(sum(case when j = 0 then i * ln(1 - share) else ln((i - j + 1)::double / j) + ln(share / (1 - share)) end) over (partition by m, n, k, block, s, z, i order by j)) as choose from j),
x as (select m, n, k, block, s, z, i, max(pmf) as pmf, sum(choose * {STD_SQL.format(n="j", b="(block::double / s)", k="(k::double / z)")}) as inside from o group by all)
select m, n, k, block, s, z, round(sum(pmf * pow(inside, z)), 6) as fpr from x group by all""")
def fpr_sectorized(spark, sf_dir):
    return cost.sectorized_rates(spark.createDataFrame(SECTORS, "m int, n int, k int, block int, s int, z int")).withColumn("fpr", F.round("fpr", 6))


MODEL_N, MODEL_TW = 1 << 22, 1.0
#: The lookup times once more, as SQL, so that the model's own table is held against another.
LUT_SQL = """select device, mode, unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512]) as size_mib, unnest(ns)::double as ns from (values
('gtx1080', 'pcie', [0.3362, 0.3363, 0.4563, 0.6000, 0.6870, 0.7363, 0.7625, 0.7761, 0.7831, 0.7864]),
('gtx1080', 'cached', [0.1553, 0.1844, 0.3866, 0.5551, 0.6556, 0.7134, 0.7445, 0.7606, 0.7688, 0.7728]),
('gtx1080ti', 'pcie', [0.3419, 0.3384, 0.3399, 0.3639, 0.4333, 0.4746, 0.5049, 0.5104, 0.5166, 0.5204]),
('gtx1080ti', 'cached', [0.1358, 0.1252, 0.1921, 0.3154, 0.3986, 0.4474, 0.4759, 0.4910, 0.4987, 0.5033]),
('gtx1050ti', 'pcie', [0.3420, 0.3393, 0.3401, 0.3759, 0.4469, 0.4856, 0.5009, 0.5244, 0.5268, 0.5250]),
('gtx1050ti', 'cached', [0.1358, 0.1254, 0.1935, 0.3177, 0.3961, 0.4521, 0.4759, 0.4910, 0.5045, 0.5026])) t(device, mode, ns)"""
GRID_SQL = f"""lut as ({LUT_SQL}),
c as (select size_mib, size_mib::bigint * {cost.MIB_BITS} as m, {MODEL_N}::bigint as n, k::int as k, {cost.BLOCK_BITS} as block from (select distinct size_mib from lut), (select unnest(range(1, 16)) as k)),
{_pmf_sql("c", "m, n, k, block")}, f as (select size_mib, k, sum(pmf * {STD_SQL.format(n="i", b="block", k="k")}) as fpr from q group by all),
grid as (select device, mode, size_mib, k, fpr, ns + fpr * {MODEL_TW} as overhead from f join lut using (size_mib))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("fpr", "overhead")})


@query(f"with {GRID_SQL} select device, mode, size_mib, k, round(fpr, 6) as fpr, round(overhead, 6) as overhead from grid")
def filter_overhead_grid(spark, sf_dir):
    return _rounded(cost.overhead_grid(spark, MODEL_N, MODEL_TW))


BEST_SQL = "best as (select * from grid qualify row_number() over (partition by device, mode order by overhead, size_mib, k) = 1)"


@query(f"with {GRID_SQL}, {BEST_SQL} select device, mode, size_mib, k, round(fpr, 6) as fpr, round(overhead, 6) as overhead from best")
def filter_argmin(spark, sf_dir):
    return _rounded(cost.best_parameters(cost.overhead_grid(spark, MODEL_N, MODEL_TW)))


@query(f"""with {GRID_SQL}, {BEST_SQL} select device, mode, p as percent, (overhead - fpr * {MODEL_TW}) + {MODEL_TW} * (p / 100.0::double + (1 - p / 100.0::double) * fpr) < {MODEL_TW} as apply
from best, (select unnest(range(0, 101, 10)) as p)""")
def filter_apply_rule(spark, sf_dir):
    best = cost.best_parameters(cost.overhead_grid(spark, MODEL_N, MODEL_TW)).withColumn("percent", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"), F.lit(10).cast("long"))))
    share = F.col("percent") / 100.0
    lookup = F.col("overhead") - F.col("fpr") * MODEL_TW
    return best.select("device", "mode", "percent", (lookup + MODEL_TW * (share + (1 - share) * F.col("fpr")) < MODEL_TW).alias("apply"))


# --- timelines and profiles -----------------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    tick = F.expr("unix_micros(cast(ts as timestamp))")
    return _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", tick.alias("tick"), F.lit(1).cast("long").alias("tuples"))


EVENTS_SQL = "e as (select event_id, user_id, event_type, epoch_us(ts) as tick, 1::bigint as tuples from events)"
TIMED_SQL = f"{EVENTS_SQL}, d as (select *, tick - (select min(tick) from e) as t, lead(tick) over w - tick as len, lag(event_type) over w as before, row_number() over w as rn from e window w as (partition by user_id order by tick, event_id))"


@query(f"with {TIMED_SQL} select event_id, user_id, event_type, t, cast(len as double) as len from d")
def timeline_durations(spark, sf_dir):
    return timeline.durations(_events(spark, sf_dir), "user_id", "tick", "event_id").select("event_id", "user_id", "event_type", "t", F.col("len").cast("double").alias("len"))


ISLANDS_SQL = f"""{TIMED_SQL}, i as (select *, sum(case when rn > 1 and before is not distinct from event_type then 0 else 1 end) over (partition by user_id order by tick, event_id) as island from d),
runs as (select user_id, cast(island as bigint) as island, min(event_type) as event_type, min(t) as t, cast(sum(len) as bigint) as len, cast(sum(tuples) as bigint) as tuples from i group by user_id, island)"""


def _islands(spark, sf_dir) -> DataFrame:
    return timeline.islands(_events(spark, sf_dir), "user_id", "tick", "event_id", "event_type", "tuples")


@query(f"with {ISLANDS_SQL} select user_id, island, event_type, t, cast(len as double) as len, tuples from runs")
def timeline_islands(spark, sf_dir):
    return _islands(spark, sf_dir).withColumn("len", F.col("len").cast("double"))


NAME_SQL = "case event_type when 'click' then 'CPUJOIN' when 'view' then 'CPUWORK' when 'purchase' then 'SCHEDPROBE' else event_type end"


@query(f"""with {ISLANDS_SQL}, n as (select *, {NAME_SQL} as name, tuples * 100000000 as work from runs)
select user_id, island, case when name = 'CPUJOIN' then 'CPU join' when name = 'CPUWORK' then 'CPU work' when name in ('SCHEDPROBE', 'FINISHPROBE') then 'GPU scheduling' else 'other' end as class,
round(case when name in ('CPUJOIN', 'CPUWORK') and work > 0 then greatest(1.0::double, least(10.0::double, coalesce(work::double / nullif(len, 0) * 120, 10.0))) else 5.0::double end, 6) as width from n""")
def timeline_speed(spark, sf_dir):
    name = F.expr(NAME_SQL)
    rows = _islands(spark, sf_dir).withColumn("name", name).withColumn("work", F.col("tuples") * 100000000)
    return rows.select("user_id", "island", timeline.event_class(F.col("name")).alias("class"), F.round(timeline.bar_width(F.col("name"), F.col("work"), F.col("len")), 6).alias("width"))


PROFILE_SQL = """p as (select l_orderkey, l_linenumber, 1::bigint << (23 + l_linenumber) as filter_size, case l_returnflag when 'A' then 0 when 'N' then 50 else 100 end as slowdown,
l_extendedprice as pipeline_time, l_quantity as join_time, case when l_discount < 0.02 then 0 else l_orderkey end as filtered, cast(l_quantity as int) as selectivity from lineitem)"""


def _profile(spark, sf_dir) -> DataFrame:
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("l_linenumber") + 23).cast("int"))
    slow = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 50).otherwise(100)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", size.alias("filter_size"), slow.alias("slowdown"), F.col("l_extendedprice").alias("pipeline_time"), F.col("l_quantity").alias("join_time"), F.when(F.col("l_discount") < 0.02, F.lit(0).cast("long")).otherwise(F.col("l_orderkey")).alias("filtered"), F.col("l_quantity").cast("int").alias("selectivity"))


SLOW = [0, 50, 100]


@query(f"with {PROFILE_SQL} select filter_size, " + ", ".join(f"round(avg(pipeline_time) filter (where slowdown = {v}), 4) as c_{v}" for v in SLOW) + " from p group by filter_size")
def profile_pivot_mean(spark, sf_dir):
    return profiles.pivot_mean(_profile(spark, sf_dir), "filter_size", "slowdown", "pipeline_time", SLOW)


@query(f"with {PROFILE_SQL} select distinct slowdown as label from p")
def profile_labels(spark, sf_dir):
    return profiles.labels(_profile(spark, sf_dir), "slowdown")


@query(f"with {PROFILE_SQL} select filter_size, " + ", ".join(f"(max(row(l_orderkey, l_linenumber, pipeline_time)) filter (where slowdown = {v}))[3] as c_{v}" for v in SLOW) + " from p group by filter_size")
def profile_pivot_last(spark, sf_dir):
    return profiles.pivot_last(_profile(spark, sf_dir), "filter_size", "slowdown", "pipeline_time", ["l_orderkey", "l_linenumber", "pipeline_time"], SLOW)


@query(f"with {PROFILE_SQL} select l_orderkey, l_linenumber, round(join_time / case when filtered = 0 then 1073741824 else filtered end, 9) as cost from p where selectivity between 0 and 20")
def join_speed(spark, sf_dir):
    rows = _profile(spark, sf_dir).filter(F.col("selectivity").between(0, 20))
    return rows.select("l_orderkey", "l_linenumber", F.round(profiles.join_cost(F.col("join_time"), F.col("filtered")), 9).alias("cost"))


@query(f"with {PROFILE_SQL} select l_orderkey, l_linenumber, round(100.0::double * filtered / 1073741824, 9) as share from p")
def gpu_utilisation(spark, sf_dir):
    return _profile(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(profiles.utilisation(F.col("filtered")), 9).alias("share"))


@query(f"""with {PROFILE_SQL} select l_orderkey, l_linenumber, case when not ((slowdown = 0 and filter_size / 8 >= 8388608) or (slowdown = 50 and filter_size / 8 >= 268435456)) then pipeline_time end as valid_time from p""")
def mask_invalid(spark, sf_dir):
    return _profile(spark, sf_dir).select("l_orderkey", "l_linenumber", profiles.masked(F.col("pipeline_time"), F.col("slowdown"), F.col("filter_size")).alias("valid_time"))


@query(f"with {NUMBERED_SQL} select position, o_orderkey as line from o where position % 4 < 2")
def dedup_every_other_pair(spark, sf_dir):
    """Of every four lines the first two, by their numbers."""
    return _numbered(spark, sf_dir).filter(F.col("position") % 4 < 2).select("position", F.col("o_orderkey").alias("line"))


@query("""with p as (select l_orderkey % 97 as run, l_linenumber, l_quantity, l_tax + 1 as hash_ms, l_discount + 2 as sort_ms, l_quantity + 3 as probe_ms from lineitem)
select run, round(count(*) / (sum(hash_ms) / 1000.0), 4) as hash_rate, round(count(*) / (sum(sort_ms) / 1000.0), 4) as sort_rate, round(count(*) / (sum(probe_ms) / 1000.0), 4) as probe_rate,
round(count(*) / (sum(hash_ms + sort_ms + probe_ms) / 1000.0), 4) as total_rate from p group by 1""")
def stage_throughputs(spark, sf_dir):
    """Rates of each stage of a filter's probe and of all together."""
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("run"), (F.col("l_tax") + 1).alias("hash"), (F.col("l_discount") + 2).alias("sort"), (F.col("l_quantity") + 3).alias("probe"))
    return profiles.stage_rates(rows, ["run"], ["hash", "sort", "probe"], 4)


@query("select l_linenumber, round(count(*) / (sum(l_quantity) / 1000.0), 4) as rows_per_second, round(0.25 * sum(l_quantity) / count(*) * 1e12, 0) as work_ps from lineitem group by 1")
def stage_throughput(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return rows.select("l_linenumber", F.round(profiles.throughput(F.col("n"), F.col("q")), 4).alias("rows_per_second"), F.round(profiles.work_time(F.lit(0.25), F.col("q"), F.col("n")), 0).alias("work_ps"))
