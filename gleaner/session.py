"""Session defaults and intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even where that costs one more shuffle after the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "gleaner", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for the few tasks that run Python. Once per session;
    not needed where the cluster has the package installed."""
    sc = spark.sparkContext
    if getattr(sc, "_gleaner_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gleaner-package-")) / "gleaner.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._gleaner_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without it (tests): a folder of one machine is of no use to a
    cluster, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="gleaner-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_stages = threading.local()


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what :func:`materialize` writes meanwhile, for jobs that run again and again.

    Nothing that outlives the block may read those tables: write its results before it ends.
    """
    stack = _stages.__dict__.setdefault("open", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    This cuts the lineage of loops, survives lost executors, and gives the next plan real sizes.
    """
    spark = df.sparkSession
    target = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _stages.__dict__.get("open"):
        _stages.open[-1].append(target)
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)
