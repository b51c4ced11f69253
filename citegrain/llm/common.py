"""Shared helpers: tables in the shared folder, batching of texts, word rules."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
BLANKS = "\t\n\x0b\x0c\r "
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Characters that Python helpers hold at once, so that memory follows neither the table nor the batch.
CHUNK_CHARS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, as in tests, the folder set by hand, or one
    beside the session's warehouse."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def new_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: lineage ends there and any executor may be lost."""
    path = new_table(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint of a small table."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send at most `rows` rows to a worker at once; the session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of one key that a join leaves in one place; keys of more rows are dealt to several.
HUB = 512
#: Such keys up to this number are sent to all tasks (some 30 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 100_000


def spread_join(many: DataFrame, one: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """Inner join on `key` of a table with many rows of a key and one with one row of a key. Keys of over HUB rows (in `counted`, else in
    `many`) are counted first; their rows are dealt by a hash of the whole row, and `one` has a copy for each part."""
    counts = (many if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hubs = checkpointed(counts.where(is_hub()).select(key, _parts()))
    return _dealt_join(many, one, key, hubs, hubs.count())


def counted_join(many: DataFrame, one: DataFrame, key: str, n: int) -> DataFrame:
    """spread_join where `one` brings the rows that `many` has of each key, in `_n`; of its keys n are hubs. Nothing is counted again."""
    return _dealt_join(many, one.drop("_n"), key, one.where(is_hub()).select(key, _parts()), n)


def is_hub() -> Column:
    """Whether a key has `_n` rows too many for one place."""
    return F.col("_n") > HUB


def _parts() -> Column:
    return F.ceil(F.col("_n") / HUB).cast("int").alias("_parts")


def _dealt_join(many: DataFrame, one: DataFrame, key: str, hubs: DataFrame, n: int) -> DataFrame:
    if not n:
        return many.join(one, key)
    hubs = F.broadcast(hubs) if n <= BROADCAST_KEYS else hubs
    dealt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in many.columns)), F.coalesce("_parts", F.lit(1)))
    left = many.join(hubs, key, "left").withColumn("_part", dealt.cast("int")).drop("_parts")
    right = one.join(hubs, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def give_back() -> None:
    """Hands the memory that a worker has freed back to the system. Workers live on after their tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with glibc
    if trim:
        trim(0)


def chunks(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of texts (null: empty) of about `limit` characters; a longer text is a run of its own."""
    run: list[str] = []
    held = 0
    for text in texts:
        text = text or ""
        if run and held + len(text) > limit:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text (null: none), native."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def crc_fold(key: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def row_chance(seed: int, *columns: str) -> Column:
    """A number from 0 to 1 for each row, by a hash of `columns` and of the row's place: rows alike in all columns, however many, are drawn each on
    its own. Alike again where the table's files are dealt to tasks alike."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns, F.monotonically_increasing_id()), 11) / F.lit(float(1 << 53))


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
