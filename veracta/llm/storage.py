"""Intermediate tables on the storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Rows of one or two numbers that are broadcast at most; their hashed form takes some 50 bytes each.
MOST_SENT = 2_000_000
#: Of the driver's largest heap, what may be taken up when a table has been written.
HELD = 0.4


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one of this machine on a local
    master, whose tasks all run here; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veracta-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def relieve(spark: SparkSession, held: float = HELD) -> bool:
    """Collect the driver's garbage if its heap has grown beyond ``held`` of the most that it may take, and say whether.

    A heap grows while many tasks report and gives nothing back by itself until long after, and the shuffle files and
    broadcasts of finished jobs stay until a collection finds that nothing holds them.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    full = heap.totalMemory() > held * heap.maxMemory()
    if full:
        spark._jvm.java.lang.System.gc()
    return full


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    That cuts the lineage, survives a lost executor, lets later reads take
    only the columns they need, and lets the driver drop what it held for the
    job. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    relieve(spark)
    return spark.read.parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` gave and that nothing reads again."""
    spark = df.sparkSession
    for path in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def only(rows: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows whose ``key`` (numbers) is in ``keys``. Up to ``MOST_SENT`` keys go to the rows; more than that, and both are
    dealt by key."""
    if keys.count() <= MOST_SENT:
        keys = broadcast(keys)
    return rows.join(keys, key, "left_semi")
