"""Session helpers: nothing here starts or configures a cluster."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """The session tests and the bench use on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("urna")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # One small file is one task: a join by shuffle spreads its rows over the cores.
        .config("spark.sql.autoBroadcastJoinThreshold", "1m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="urna-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A session that names none has its warehouse, the other folder that driver and
    executors share on any cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark's switch for removing a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's limit on a compiled method, in bytes of code, and the length from which the JVM interprets a method for good.
_LONGEST, _COMPILED = "spark.sql.codegen.hugeMethodLimit", "8000"


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def leaving_no_shuffles(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Queries that start in here remove their shuffle files when they end: for those that write all they make.

    Spark otherwise does so when the driver collects the plans, which may be never on an idle driver.
    """
    return _setting(spark, _CLEANUP, "true")


def in_compiled_methods(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Queries that start in here split a projection of very many expressions into methods that the JVM compiles.

    As one method, which Spark makes of it otherwise, it would be interpreted row by row.
    """
    return _setting(spark, _LONGEST, _COMPILED)


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table once and read it back, columnar and splittable.

    For costly steps that several later ones share: it survives lost executors
    and cuts the lineage the optimiser has to carry. Its shuffle files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    with leaving_no_shuffles(spark):
        df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Remove stages whose last reader has been written itself; others are left alone."""
    for df in staged:
        path = getattr(df, "stage_path", None)
        if path is not None:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            df.stage_path = None


def tidy(spark: SparkSession) -> None:
    """Let Spark remove shuffle files that no plan refers to any more.

    It does so when the driver's objects are collected, which on an idle driver may
    come long after a costly step has been written.
    """
    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="urna-"), "urna_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as bundle:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
