"""Session settings and the size checks that decide between broadcasting and shuffling."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_private: str | None = None
BROADCAST_BYTES = 64 << 20  # largest side that is ever broadcast on purpose


def local_session(app: str = "spanseek", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster passes its own session to every operator instead."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.driver.memory", os.environ.get("SPANSEEK_DRIVER_MEMORY", "12g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers once per application, so that a run does not depend on the folder it starts in."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="spanseek-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = f"{folder}/spanseek_code.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, f"{root.name}/{file.relative_to(root)}")
        spark.sparkContext.addPyFile(archive)  # served to the executors by the driver
        _shipped.add(application)
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir`` or by ``setCheckpointDir``. Where neither is set, a private one in local mode
    (tests); on a cluster that would lose rows without an error, so it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return f"{folder.rstrip('/')}/spanseek-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _private
    if _private is None:
        _private = tempfile.mkdtemp(prefix="spanseek-")
        atexit.register(shutil.rmtree, _private, ignore_errors=True)
    return _private


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe against lost executors, and of a size the optimizer
    knows, so that later joins against it are broadcast exactly when it is small."""
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core. A scan that already has more is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


SURELY_SMALL = 1 << 20  # files of this size stay below BROADCAST_BYTES even when unpacked to sixty times as much
_NOT_GROWING = {"Project", "Filter", "Aggregate", "Distinct", "LogicalRelation", "Relation", "LocalRelation", "SubqueryAlias"}


def _file_bytes(df: DataFrame) -> int | None:
    """Size of the files below ``df``, when nothing in its plan can make rows more than they are there; known without a job."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size, node = int(str(plan.stats().sizeInBytes())), plan
    while True:
        if node.nodeName().split(" ")[0] not in _NOT_GROWING:
            return None
        if node.children().isEmpty():
            return size
        node = node.children().head()


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of payload in ``df``: a single aggregate over it, never a collect. Small written tables are judged by their files."""
    on_disk = _file_bytes(df)
    if on_disk is not None and on_disk <= SURELY_SMALL:
        return on_disk
    size = F.lit(16)
    for field in df.schema.fields:
        col = F.coalesce(F.col(f"`{field.name}`"), F.lit(None).cast(field.dataType))
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(col), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            size = size + 8 * F.greatest(F.size(col), F.lit(0))
        else:
            size = size + 8
    return df.agg(F.sum(size).alias("n")).first()["n"] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring; beyond the limit the plain join shuffles (with AQE skew handling)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def skew_join(left: DataFrame, right: DataFrame, on: str, salt_from: str, how: str = "inner",
              hot_rows: int = 1_000_000) -> DataFrame:
    """Equi-join whose left side may hold one key in a third of its rows.

    A key with more than ``hot_rows`` left rows is spread (by a hash of ``salt_from``) over as many sub-keys as leave about ``hot_rows`` in
    each, and only the right rows of such keys are copied. There are at most rows/hot_rows of them, so their list is small.
    """
    hot = (left.groupBy(on).count().where(F.col("count") > hot_rows)
           .select(on, F.ceil(F.col("count") / (hot_rows / 2)).cast("int").alias("_hot")))
    hot = broadcast_if_small(written(hot))
    salted_left = (left.join(hot, on, "left")
                   .withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(salt_from), F.col("_hot"))).otherwise(0))
                   .drop("_hot"))
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.col("_hot") - 1)).otherwise(F.array(F.lit(0)))
    salted_right = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    salted_right = salted_right.withColumn("_salt", F.col("_salt").cast("bigint"))
    salted_left = salted_left.withColumn("_salt", F.col("_salt").cast("bigint"))
    return salted_left.join(salted_right, [on, "_salt"], how).drop("_salt")


def sized_join(left: DataFrame, right: DataFrame, on: str, salt_from: str) -> DataFrame:
    """Equi-join of many rows with a side that is broadcast while it is small; beyond that both move, with the hot keys of ``left`` spread."""
    return left.join(F.broadcast(right), on) if estimated_bytes(right) <= BROADCAST_BYTES else skew_join(left, right, on, salt_from)
