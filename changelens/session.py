"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder of `spark.checkpoint.dir`; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="changelens-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, unless they find it by themselves:
    its folder is on PYTHONPATH, or workers start in it."""
    package = Path(__file__).resolve().parent
    root, sc = str(package.parent), spark.sparkContext
    by_path = root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if by_path or (sc.master.startswith("local") and os.getcwd() == root) or sc.applicationId in _SHIPPED:
        return
    # Spark serves the file as long as the session lives, so it stays.
    shared = re.sub(r"^file:/+", "/", work_path(spark, "package"))
    folder = shared if shared.startswith("/") else tempfile.mkdtemp(prefix="changelens-")
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(root))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def pinned(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage, so that no recomputation can change them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Splitting a hot key also pays when it costs a later shuffle.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("changelens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for name, value in RECOMMENDED.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
