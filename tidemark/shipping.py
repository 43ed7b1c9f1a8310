"""What driver and executors share: the package itself, and a folder for written tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()
_OWN_DIRS: dict[str, str] = {}
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, whose Python workers import it, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-src-")) / "tidemark_core.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SENT.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN_DIRS[app]


def work_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes the tables and files that this application has staged; results that were not written are lost with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts lineage in a way that survives lost executors, and lets later plans read the
    same rows again without computing them again. With ``release`` the shuffle files behind the
    table go as soon as it is written; else they stay until the driver collects its garbage.
    """
    path, schema = new_path(spark, name), df.schema
    before = spark.conf.get(_RELEASE, None)
    if release:
        spark.conf.set(_RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, staged: DataFrame) -> None:
    """Deletes the tables of this application that ``staged`` reads, which no later step may need."""
    own = f"/{work_dir(spark).rsplit('/', 1)[1]}/"
    for folder in {x.rsplit("/", 1)[0] for x in staged.inputFiles() if own in x}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
