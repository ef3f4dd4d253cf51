"""Where jobs keep state: the folder that driver and executors share, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = Path(__file__).resolve().parents[2]


def one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder on a local master; on a cluster no folder is known to be shared, so
    that is an error."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: lineage ends there, and executors may be lost afterwards."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package: by path on one machine, as a zip file that Spark hands out on a cluster. Batches to
    Python are bounded by bytes, as texts may be long."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":  # Spark's own default; a value that was set stays
        spark.conf.set(BATCH_BYTES, "16m")
    context = spark.sparkContext
    if one_machine(spark):
        known = context.environment.get("PYTHONPATH", "").split(os.pathsep)
        if str(ROOT) not in known:
            context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), *known) if x)
    elif not getattr(context, "_graphloom_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"  # read by the driver's file server alone
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted((ROOT / "graphloom").rglob("*")):
                if file.is_file() and "__pycache__" not in file.parts:
                    z.write(file, file.relative_to(ROOT))
        context.addPyFile(str(archive))
        context._graphloom_shipped = True


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing is read from any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
