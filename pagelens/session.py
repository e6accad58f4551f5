"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import gc
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Rows of one Arrow batch handed to a Python worker. Texts may be long, so the batches are kept short.
ARROW_ROWS = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep their Arrow batches small. Safe to call again and again."""
    env = spark.sparkContext.environment
    parts = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: the cluster's ``spark.checkpoint.dir``. A local one is made only where that is unset and
    everything runs in one process, as in tests; a cluster without a shared folder is an error."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not set_dir and not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(set_dir or f"file:///tmp/pagelens-checkpoint-{os.getpid()}")
    return set_dir or sc._jsc.sc().getCheckpointDir().get()


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects the plans that made them; after a cut nothing needs them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Folders of written tables that go when the driver ends.
_folders: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _sweep() -> None:
    """Results are read when they are asked for, so their tables stay until the driver ends. A context that has ended before cannot remove them."""
    for spark, folder in _folders:
        if spark.sparkContext._jsc is not None:
            _remove(spark, folder)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def stored(df):
    """A DataFrame written as compressed Parquet in the shared folder and read again: smaller than a checkpoint."""
    spark = df.sparkSession
    path = own_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    del df
    release(spark)
    return spark.read.parquet(path)


def discard(*tables) -> None:
    """Deletes the files of tables made by ``stored`` that no later plan reads."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("table-"):
                path.getFileSystem(conf).delete(path, True)


def cut(df):
    """Reliable checkpoint of a DataFrame in the shared folder (never localCheckpoint)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    release(spark)
    return out


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
