"""Session helpers: table access, shared working folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: dict[str, SparkSession] = {}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="symgrove-package-")) / "symgrove.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(path))
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests, a laptop) a folder of
    this process is made and removed at exit; on a cluster that is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.environ.get("SYMGROVE_SHARED_DIR")
    if not path:
        path = tempfile.mkdtemp(prefix="symgrove-")
        os.environ["SYMGROVE_SHARED_DIR"] = path
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once as a parquet table into the shared folder and read it back.

    Cuts the lineage: later jobs survive the loss of executors, and several
    consumers share one computation. The table goes when the process ends, or
    with :func:`sweep`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, name: str = "cut", **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`cut`, and aggregates of the rows taken while they are written, without a second pass."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    return out, seen.get


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager checkpoint into the shared folder; for the small state of a loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep() -> None:
    """Remove every table that :func:`cut` has written."""
    for path, spark in list(_written.items()):
        _written.pop(path)
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended already
            pass


atexit.register(sweep)


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
