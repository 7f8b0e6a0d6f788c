"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with one below it for this application. A local one is taken only
    where driver and executors are one process and the session names none; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file:///tmp/filigrane-shared"
    return f"{named.rstrip('/')}/filigrane-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_shared(spark: SparkSession) -> bool:
    """Remove all tables that this application wrote to the shared folder. Results that were not read or written
    elsewhere before are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n. A null id counts as the text 'null'."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(n)).cast("int")


def pieces(batches: Iterable[pa.RecordBatch], column: str | int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about `limit` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(as_binary(batch.column(column))), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def as_binary(array: pa.Array) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_string(array.type):
        return array.cast(pa.binary())
    if pa.types.is_large_string(array.type):
        return array.cast(pa.large_binary())
    return array


def utf8(array: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes the empty text."""
    return [b or b"" for b in as_binary(array).to_pylist()]


def worker_store() -> dict:
    """What a Python worker keeps from one task to the next, until a task of another operator ends in it."""
    import sys
    import types

    return sys.modules.setdefault("_filigrane_worker", types.ModuleType("_filigrane_worker")).__dict__


def release(keep: bool = False, collect: bool = True) -> None:
    """Give memory that a Python worker no longer uses back to the system: workers live on for other tasks.

    keep: leave what is stored for the next task of the same operator. collect: also look for cycles, such as the
    classes that come with a task and what they hold.
    """
    import ctypes
    import gc

    stored = [] if keep else [k for k in worker_store() if not k.startswith("__")]
    for name in stored:
        del worker_store()[name]
    if stored or collect and not keep:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


ARROW_ROWS = 1000


def without(columns: list[str], names, spark: SparkSession) -> list[str]:
    """Columns but for those that the session takes for one of the names: letter case counts only if it says so."""
    same = (lambda c: c) if spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    gone = {same(n) for n in names}
    return [c for c in columns if same(c) not in gone]


def packed(df: DataFrame, *own: Column, columns: list[str] | None = None) -> DataFrame:
    """The rows of `df` as one column `row` beside columns of the operator, so that no names can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]).alias("row"), *own)


def unpacked_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches for rows that hold whole texts. The session's size is only touched if it is the default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def map_arrow(df: DataFrame, work: Callable, schema, collect: bool = True) -> DataFrame:
    """mapInArrow with small batches, and with memory given back when a task ends."""
    small_batches(df.sparkSession)

    def run(batches):
        release(collect=collect)
        try:
            yield from work(batches)
        finally:
            release(collect=collect)

    return df.mapInArrow(run, schema)


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    into: str | None = None,
) -> DataFrame:
    """Every row of `df` with the columns of `fields`, computed batch by batch in Arrow.

    `make` runs once per task and returns the function that maps a piece (with its texts in the column `__text`) to the
    new columns. A column of `df` that has the name of a result column (in any letter case, where the session does not
    tell them apart) is replaced by it; with `into`, the results are one struct column of that name and all others stay.
    """
    inner = fields.fieldNames()
    names = [into] if into else inner
    kept = without(df.columns, names, df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    types = {f.name: to_arrow_type(f.dataType) for f in fields}
    schema = T.StructType([df.schema[c] for c in kept] + ([T.StructField(into, fields)] if into else list(fields)))
    beside = [] if text_col in kept else [F.col(f"`{text_col}`").alias("__text")]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *beside)
    text = len(kept) if beside else kept.index(text_col)

    def run(batches):
        work = make()
        for piece in pieces(batches, text):
            found = work(piece.column(text))
            arrays = [piece.column(i) for i in range(len(kept))]
            new = [x if isinstance(x := found[n], pa.Array) else pa.array(x, types[n]) for n in inner]
            arrays += [pa.StructArray.from_arrays(new, names=inner)] if into else new
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

    return map_arrow(source, run, schema)


FILTER_BITS = 1 << 23


def narrowed(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose `key` may be among those of `wanted`: a prefilter before a join with it.

    The keys' hashes set bits in a bitmap of a fixed size (1 MB), which is what is broadcast, however many keys there
    are. Rows with a wanted key always stay; with many keys more of the others do.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    maps = wanted.select(bit.alias("__bit")).groupBy(F.expr("__bit div 32768").alias("__part"))
    maps = maps.agg(F.bitmap_construct_agg((F.col("__bit") % 32768).cast("int")).alias("__map"))
    own = rows.withColumn("__bit", bit).withColumn("__own", F.expr("__bit div 32768"))
    near = own.join(F.broadcast(maps), F.col("__own") == F.col("__part"))
    byte = F.expr("cast(conv(hex(substring(__map, cast((__bit % 32768) div 8 as int) + 1, 1)), 16, 10) as bigint)")
    return near.where(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1).drop("__bit", "__own", "__part", "__map")
