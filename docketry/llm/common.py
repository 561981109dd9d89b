"""What the corpus operators share: tables, the shared scratch folder, small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made for applications on one machine that name none.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, with its scheme.

    Where it is unset an application on one machine, as in tests, gets a temporary folder; on a cluster
    that is an error, for executors don't share such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString().rstrip("/")


#: Bytes of a batch that goes to a Python worker, about: it bounds the worker's memory, however long the texts.
BATCH_BYTES = 4 << 20


#: Bytes of one side's partition up to which Spark may join it by a hash table instead of sorting both sides.
HASHED_BYTES = 64 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on batches of the session hold BATCH_BYTES at most, or one row, and joins hash what was measured to be small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(HASHED_BYTES))


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names below a folder of any store that Spark reads, sorted; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, grouped by application so that it can be cleared later."""
    small_batches(spark)
    return f"{shared_folder(spark)}/docketry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than one in so many rows is heavy.
HEAVY = 1000


def skew_join(left: DataFrame, right: DataFrame, key: str | list[str], n: str) -> DataFrame:
    """left with right's columns, where right has one row a key and n tells how many rows of left hold it.

    Keys with more than a HEAVY-th of these rows, HEAVY at most, are sent to left's tasks, so that none
    of them is dealt to one task; the others meet by a shuffle. Both tables are read twice.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    heavy = F.col(n) * HEAVY > total
    hot = right.filter(heavy).withColumn("__hot", F.lit(True))
    known = left.join(F.broadcast(hot), key, "left")
    rest = known.filter("__hot IS NULL").select(*left.columns).join(right.filter(~heavy), key)
    return known.filter("__hot").drop("__hot").select(*rest.columns).unionByName(rest)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add under the same names, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
