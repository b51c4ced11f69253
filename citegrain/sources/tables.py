"""Tables in the cluster's shared folder: intermediate ones, and ones bucketed by a key that joins on it don't shuffle."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, as in tests, one in the session's warehouse."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (place or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once in the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, in even parts: Spark cuts by bytes, so that a few megabytes of rows that take long to work on would be one task's."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def unsent(df: DataFrame) -> DataFrame:
    """`df`, to be joined by a sort of both sides. Spark judges a side by the bytes of its files, which packed or exploded rows outgrow many times over, and would
    send it whole through the driver to all tasks."""
    return df.hint("merge")


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """`df` as a table at `path`, bucketed and sorted by `key`. Every bucket is one task's file."""
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_name(path)))


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table that write_bucketed() wrote, in any session: joins on `key` move the other side only, and send neither to all tasks."""
    if not spark.catalog.tableExists(_name(path)):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {_name(path)} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return unsent(spark.table(_name(path)))


def publish(spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[], None] = lambda: None) -> None:
    """Lets `write` fill a draft folder, and makes it `path` when it is whole and `check` doesn't raise: readers see all of it or nothing. An existing folder is not touched."""
    place, draft = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.{uuid.uuid4().hex}"))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place):
        raise FileExistsError(path)
    try:
        write(draft.toString())
        check()
        if files.exists(place) or not files.rename(draft, place):
            raise FileExistsError(path)
    finally:
        files.delete(draft, True)


def _name(path: str) -> str:
    return "t_" + hashlib.md5(path.encode()).hexdigest()
