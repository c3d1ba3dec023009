"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word rule of every operator here has it.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names; only where that is unset (tests,
    one machine) a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = now.get() if now.isDefined() else tempfile.mkdtemp(prefix="loom-")
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Unlike a checkpoint the reread table has a known size, so that the planner
    can tell whether it may be broadcast, and its files stay until ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``stored``, once all that was to be read of them is written elsewhere."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(conf).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that are done with.

    Spark drops them when the driver's collector finds their plans, which on a
    large heap may take half an hour, while a job of many steps fills the disks.
    It takes a second round for what the first one unties.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != F.lit(""))


def by_bytes(columns: list[list], weights: list[int], most: int = 4_000_000) -> Iterator[slice]:
    """Slices of a batch with about ``most`` bytes each, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(weights):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(weights):
        yield slice(start, len(weights))


def texts_of(column) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]
