"""What the training-data operators share: reading, shared-folder tables, shipping the package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so Python tasks can import it anywhere."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")  # rows may be long texts
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(), f"tracelens_{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((top / "tracelens").rglob("*.py")):
            z.write(p, p.relative_to(top))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


_user = [""]


def lean(user: str) -> None:
    """For the start of a Python task: where this worker last ran another operator, what that one has kept goes (tables,
    dictionaries of tokens), and freed memory goes back to the system. Spark reuses workers for all operators."""
    if _user[0] == user:
        return
    _user[0] = user
    for name in ("bpe", "near_dup", "words"):
        module = sys.modules.get(f"tracelens.llm.{name}")
        if module is not None and name != user:
            module.forget()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode, an error on a cluster."""
    sc: SparkContext = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tracelens-')}"
        sc.setCheckpointDir(root)
    return root


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends at replicated files.

    The folder goes by discard(), at the latest when the application ends (deleteOnExit of its file system)."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tracelens/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop, files = _hadoop(spark, path)
    files.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that saved() has made and that nothing reads any more."""
    for f in frames:
        if f in _paths:
            hadoop, files = _hadoop(f.sparkSession, _paths.pop(f))
            files.delete(hadoop, True)
