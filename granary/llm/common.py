"""What the operators of this subpackage share: shared folders, Arrow batch sizes, null rules."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.storage import discard, scratch, settle  # noqa: F401

#: Rows and bytes of one Arrow batch. Both bound what a Python worker holds at once.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A new path in the folder that all executors share, and a frame written there and read again, which cuts its lineage and outlives executors.
workspace, materialize = scratch, settle


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context: their Python may not find it otherwise."""
    sc = spark.sparkContext
    if getattr(sc, "_granary_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="granary-code-")) / "granary.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in package.rglob("*"):
            if path.suffix in (".py", ".npz"):
                z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._granary_shipped = True


def small_batches(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parallelism(df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows of df: as many as its input has splits, and never fewer than the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, null texts as empty; other columns only if they are named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def row_key() -> Column:
    """128 bits that tell rows with other doc_ids or texts apart; a null doc_id is unlike any number, a null text is like an empty one."""
    doc_id, text = F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")
    return F.unhex(F.md5(F.encode(F.concat(F.coalesce(doc_id, F.lit("-")), F.lit(" "), F.coalesce(text, F.lit(""))), "UTF-8")))


#: Bits of a filter of keys, for each key and in all at most (half a megabyte).
KEY_BITS, MOST_KEY_BITS = 32, 1 << 22


def may_be_among(keys: DataFrame, name: str) -> Callable[[str], Column]:
    """A test of a column: false where its value is surely none of the keys. A join of whole rows with few keys then moves few rows; with so many keys that all bits are set
    it moves all of them, and the result is the same. The bits are one value, made by aggregates and used as a scalar subquery."""
    spark = keys.sparkSession
    bits = min(MOST_KEY_BITS, max(1 << 10, 1 << (KEY_BITS * keys.count()).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.xxhash64(name).alias("h")).select(F.shiftright(bit, 6).alias("id"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("id").agg(F.expr("bit_or(b)").alias("b"))
    row = spark.range(bits >> 6).join(words, "id", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("bits"))
    row = materialize(row, "bits")

    def test(column: str) -> Column:
        h = F.xxhash64(column)
        return F.getbit(F.get(row.scalar(), F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def give_back() -> None:
    """Returns memory that this process has freed to the system. Workers outlive their tasks, and what they keep counts as the executor's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *forget: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, with forget() called and freed memory given back at the end of each task."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return held


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as df needs to have no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def per_row(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple]], *cols: str) -> DataFrame:
    """One output row for each input row. make() runs once for each task and returns a function of the columns' values."""
    from pyspark.sql.types import StructType

    arrow_schema = to_arrow(df.sparkSession, schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            rows = [one(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), arrow_schema, strict=True)], schema=arrow_schema)

    return df.select(*cols).mapInArrow(lean(run), StructType.fromDDL(schema))


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of df, all columns as they are, of whose column the function that make() returns is true. make() runs once for each task."""
    small_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            yield batch.filter(pa.array([keep(x) for x in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)


def change_texts(docs: DataFrame, make: Callable[[], Callable[[str | None], str | None]]) -> DataFrame:
    """docs with each text replaced by what the function that make() returns gives; n_chars, where there is such a column, is the length of a text that changed. All other columns
    and rows stay as they are."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in batches:
            before = batch.column(at).to_pylist()
            after = [change(x) for x in before]
            columns = list(batch.columns)
            columns[at] = pa.array(after, batch.schema.field(at).type)
            if n_at is not None:
                kind = batch.schema.field(n_at).type
                lengths = [n if new == old else len(new) for old, new, n in zip(before, after, columns[n_at].to_pylist(), strict=True)]
                columns[n_at] = pa.array(lengths, kind)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)


def to_arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
