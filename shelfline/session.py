"""Session construction and the shared settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def build_session(
    app_name: str = "shelfline",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str = "12g",
) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's own session."""
    cores = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(master or f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_shelfline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="shelfline-"), "shelfline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._shelfline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a temporary folder is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    # An earlier call, or the application itself, may have set one on the context.
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="shelfline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so a lost executor loses nothing."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def compressed(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, compressed by column: for large tables that several steps read in part."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread rows with costly expressions over all shuffle partitions.

    Adaptive execution sizes partitions by bytes; rows that are small but slow to compute would end up
    in a single task. A fixed number of partitions is left alone by it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fixed_partitions(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys in a fixed number of partitions, for joins whose pairs are costly although their sides are small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def evaluate_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """Select kept and computed columns so that later filters read the results instead of repeating the work.

    A filter on a computed column is normally pushed below the projection and evaluates the expression
    again. It cannot pass a generator, so the values are produced by one row of ``inline``.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
