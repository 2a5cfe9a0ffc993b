"""What the operators share: shared scratch tables, word splitting, Arrow helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siftline.session import ship_package

#: Java regex for the separators of words (space and U+0009 to U+000D).
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of text are worked off in slices of about this many bytes.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a temporary folder takes its place in local mode, where all share one machine; on a
    cluster that would lose what other machines write, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.get(app) or _LOCAL.setdefault(app, f"file://{tempfile.mkdtemp(prefix='siftline-')}")
    return base


#: Folders of local sessions without a shared one.
_LOCAL: dict[str, str] = {}
_MADE: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # what can't be deleted does no harm
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made inside when it ends; what is read later must be written elsewhere."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            delete_path(spark, path)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the table that :func:`written` made; nothing may read it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs are in it."""
    return f"`{name.replace('`', '``')}`"


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns of docs as they are."""
    return [F.col(quoted(c)) for c in docs.columns]


def with_text(docs: DataFrame, text: Column) -> list[Column]:
    """All columns of docs with ``text`` for its text, and n_chars, where there is one, renewed where the text is not null."""
    out = []
    for c in docs.columns:
        kind = docs.schema[c].dataType
        if c.lower() == "text":
            out.append(text.cast(kind).alias(c))
        elif c.lower() == "n_chars":
            out.append(F.when(text.isNull(), F.col(quoted(c))).otherwise(F.length(text).cast(kind)).alias(c))
        else:
            out.append(F.col(quoted(c)))
    return out


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """``array<string>`` of the words of a text; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda inside reads it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, and one row at least."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        n, begin = batch.num_rows, 0
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        held = 0
        for i, s in enumerate(sizes):
            if i > begin and held + s > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += s
        yield batch.slice(begin, n - begin)


def from_texts(docs: DataFrame, fields: list[StructField], make: Callable[[list[str | None]], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None), and ``fields`` that ``make`` computes from slices of whole texts.

    ``fields`` may not have names of kept columns.
    """
    kept = docs.columns if keep is None else keep
    plain = [f"c{i}" for i in range(len(kept) + len(fields))]  # the workers' names: some signs in names are too much for Spark

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *make(batch.column(len(kept)).to_pylist())], names=plain)

    sent = docs.select(*(F.col(quoted(c)).alias(p) for c, p in zip(kept, plain, strict=False)), F.col("text").cast("string").alias("text"))
    schema = StructType([*sent.schema.fields[:-1], *(StructField(p, f.dataType) for p, f in zip(plain[len(kept) :], fields, strict=True))])
    names = [*kept, *(f.name for f in fields)]
    return sent.mapInArrow(compute, schema).select(*(F.col(p).alias(n) for p, n in zip(plain, names, strict=True)))


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
