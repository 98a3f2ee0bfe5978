"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()

#: Setting and size of an Arrow batch. By rows alone a batch, and each worker that turns it into ids, grows with the texts.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def build_session(master: str | None = None, app: str = "tokenloom", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # One row can be a whole file, so an Arrow batch holds few of them.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        BATCH_SETTING: str(BATCH_BYTES),
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name storage that all executors share. Only a local
    session, where driver and executors are one machine, gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="tokenloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and fixes the rows for later passes."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Store as Parquet below the shared folder and read back (keeps column pruning)."""
    return written_to(df, scratch_path(df.sparkSession, label))


def written_to(df: DataFrame, path: str, *beside: str) -> DataFrame:
    """Store as Parquet at ``path`` and read back as one table, with the tables of equal columns at ``beside``."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path, *beside)


def bucketed(df: DataFrame, label: str, *columns: str) -> DataFrame:
    """Store below the shared folder as a table bucketed and sorted by columns.

    A join on those columns reads its buckets where the other side's rows are sent, so the table
    itself is never shuffled.
    """
    spark = df.sparkSession
    name = f"tokenloom_{label}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(parts, *columns).write.format("parquet").option("path", scratch_path(spark, label))
     .bucketBy(parts, *columns).sortBy(*columns).saveAsTable(name))
    return spark.table(name)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` would on a cluster."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tokenloom-"), "tokenloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
