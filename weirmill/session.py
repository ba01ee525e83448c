"""Session helpers: the shared scratch folder, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, local mode) a private temporary folder is used instead.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if conf:
        if not held:  # named by the session after the context was made
            spark.sparkContext.setCheckpointDir(conf)
        return conf.rstrip("/")
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="weirmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    own = "file://" + folder
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder, under the application's own part of it. What is written there serves lazy
    results, so it stays until that part is removed after the application."""
    return f"{scratch_dir(spark)}/weirmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int, max_bytes: int = 32 << 20) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and, written as JSON, at most ``max_bytes`` bytes; reads no more than one
    row beyond that."""
    got = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return got["n"] <= max_rows and got["b"] <= max_bytes


def checked_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A broadcast hint if ``df`` is counted to hold at most ``max_rows`` rows of at most 32 MB in all, else ``df`` unchanged (a
    shuffle join)."""
    return F.broadcast(df) if small(df, max_rows) else df


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder; none if there is no such folder."""
    fs, at = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, whole."""
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small text file, written under another name and put in place by a rename: a reader sees all of it or none.
    Raises if the file is there or the rename did not happen; nothing is ever deleted or overwritten."""
    fs, at = _fs(spark, path)
    _, part = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(at) or not fs.rename(part, at):
        fs.delete(part, False)
        raise FileExistsError(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_weirmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="weirmill-code-")  # of the driver; Spark's file server hands it out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    sc._weirmill_shipped = True
