"""Session settings that the operators rely on, and the package's way to the executors."""

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session in this process, for tests and benchmarks."""
    conf = CONF | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
    return SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()


_ARCHIVE = "tarn_package.zip"
_SETTLED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, wherever they run and whatever their path: once for each context."""
    context = spark.sparkContext
    if _ARCHIVE in context._python_includes:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tarn-ship-")  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, _ARCHIVE)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is absent and Spark runs in this process (tests), a temporary folder, removed at exit."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tarn-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage and tells joins its size: for iterations and rows read by several plans.

    Shuffle files behind it go as soon as it is written; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}", spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(_CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _SETTLED[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that settled() gave, once everything that follows from them is settled, too."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_SETTLED.pop(table))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
