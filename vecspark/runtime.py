"""Session helpers: shipping the package to executors and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every Python worker this package, whatever its own search path.

    The archive goes through Spark's file server, so no folder has to be shared."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="vecspark-"))
    with zipfile.ZipFile(folder / "vecspark_pkg.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(folder / "vecspark_pkg.zip"))
    atexit.register(shutil.rmtree, folder, True)  # the driver serves it as long as it runs
    _SHIPPED.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session without one gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = os.environ.get("VECSPARK_LOCAL_SHARED") or os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"file://{base}"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_root(spark)}/vecspark/{what}-{uuid.uuid4().hex}"


#: Spark deletes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for what runs within."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def tidy(spark: SparkSession):
    """Executions within leave no shuffle files: their results are written, and nothing reads their shuffles again."""
    return settings(spark, {CLEANUP: "true"})


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._stored_at
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
