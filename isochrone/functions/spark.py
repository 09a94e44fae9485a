"""Session and schema helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def is_date(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.DateType)


_local: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder the session names in ``spark.checkpoint.dir``.

    A session with executors of its own must have that setting: a folder of one machine is invisible
    to the others. Only a local session without it gets a temporary folder, deleted at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local:
            _local.append(scratch_folder())
        root = _local[0]
    return f"{root.rstrip('/')}/isochrone/{name}-{uuid.uuid4().hex}"


def scratch_folder() -> str:
    """A new local folder for one run's intermediates, deleted at exit; for local sessions only."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back.

    Cuts lineage without relying on any executor staying alive: the result is a plain file scan.
    """
    return read_shared(df.sparkSession, write_shared(df, name), df.schema)


def write_shared(df: DataFrame, name: str) -> str:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


def delete_shared(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``write_shared`` made, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file complete or not at all; False when the path is taken.

    The file is made under another name and renamed without overwriting, so of two writers one gets it
    (where the file system renames atomically, as HDFS does).
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    target = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, no_overwrite)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def read_shared(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A table of the shared folder, or None when it has been cleared away."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail when a table is empty (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_none(df: DataFrame, message: str) -> None:
    """Fail when a violations table has rows, quoting at most ten of them."""
    rows = df.limit(10).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")
