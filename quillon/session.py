"""Session construction and durable cut points of long plans."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "quillon", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage by writing to the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset and
    the master is local does a temporary folder take its place.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, set as the checkpoint folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quillon-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the shared checkpoint folder, for what later steps read by columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the application's Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillon-package-")
    target = Path(folder, "quillon-package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
