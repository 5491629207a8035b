"""Spark session helpers.

Cluster jobs read ``spark.checkpoint.dir`` from the session (a shared,
fault-tolerant folder named by the cluster).  Only when it is unset -- local
tests -- do we create a scratch folder of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # no broadcast from static size estimates (string widths are guessed);
    # AQE may still broadcast a side whose measured shuffle output is small
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "spanveil", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    share_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Only a session in local mode may do without: it
    gets a folder of its own; on a cluster every executor would write to its own disk, so that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="spanveil-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


#: shuffle files of a query go when it ends, not when the driver happens to collect its garbage
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_cleared(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written in this block leaves no shuffle files."""
    return _held(spark, SHUFFLE_CLEANUP, "true")


#: rows of whole texts that are sent to a Python worker at once, where several work in one task
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written in this block goes through the Python workers in batches of ``BATCH_ROWS`` rows, or fewer if the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(spark.conf.get(key))
    return _held(spark, key, str(min(most, BATCH_ROWS) if most > 0 else BATCH_ROWS))


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Materialize ``df`` as a parquet table in the shared checkpoint folder
    and read it back: the plan is computed once (an RDD checkpoint would
    compute it twice), the lineage is cut, and the files survive the loss of
    any executor.  Never a local checkpoint.  The shuffle files of the write
    are removed with its end, as nothing reads them again."""
    spark = df.sparkSession
    share_package(spark)
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    with shuffles_cleared(spark):
        df.write.mode("overwrite").parquet(path)
    # the schema is known: reading it back needs no footer-inference job
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut_lineage`` returned and that no DataFrame in use reads any more; others are left alone."""
    for table in tables:
        if path := _written.pop(table, None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def share_package(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it (a cluster gets it by ``--py-files`` or an
    installed package; then this path is simply not there)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: rows of texts that one task works on, about; a part of more than twice as many is dealt out
TASK_ROWS = 20_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly where its files cannot keep the cores busy: a small table in few row groups is read by few tasks, and
    long work on its rows would run in those alone.  So is a table with a part of too many rows (a row group is read by one task,
    however large the file and its number of parts), into tasks whose number grows with the rows.  Others are left where they
    lie.  Counting the rows of the parts reads only the footers of the files."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    busy, most, rows = parts.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    if busy >= cores and most <= 2 * TASK_ROWS:
        return df
    return df.repartition(max(cores * 2, -(-(rows or 0) // TASK_ROWS)))


def sql_over(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """``query`` over DataFrames named in braces.  The names are global, so DataFrames of several sessions (a
    micro-batch runs in a cloned one) can meet, and live only until the plan is analyzed."""
    names = {k: f"_sv_{k}_{uuid.uuid4().hex}" for k in views}
    for k, v in views.items():
        v.createOrReplaceGlobalTempView(names[k])
    try:
        return spark.sql(query.format(**{k: f"global_temp.{n}" for k, n in names.items()}))
    finally:
        for n in names.values():
            spark.catalog.dropGlobalTempView(n)
