"""Session and scratch-space helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for an application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    home = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(home):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="loomspark-"), "loomspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one that the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) without that setting gets a
    temporary folder; elsewhere executors would each write to their own disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomspark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a DataFrame through a reliable checkpoint in the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a DataFrame once as Parquet in the shared folder and read it back.

    Like ``checkpointed``, but columnar and compressed: later steps read only
    the columns they use, and a lost executor loses nothing. ``options`` are
    those of the writer.
    """
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting to remove the shuffle files of a query as soon as it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_lean(df: DataFrame, label: str) -> DataFrame:
    """``stored`` for large tables: packed more densely, and the shuffle files of the write don't stay until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return stored(df, label, compression="zstd")
    finally:
        conf.set(CLEANUP, before)


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` or ``stored_lean`` returned; nothing that is still to be computed may read it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {jvm.org.apache.hadoop.fs.Path(f).getParent() for f in df.inputFiles()[:1]}
    for folder in folders:
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if folder.getParent() == files.makeQualified(jvm.org.apache.hadoop.fs.Path(scratch(spark))):
            files.delete(folder, True)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """The side of a join, to be broadcast if it is found to have at most so many rows; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
