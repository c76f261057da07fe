"""Intermediate tables in the shared folder, owned by the session that wrote them."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

import revlens
from revlens.session import ensure_checkpoint_dir


def folder(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``; Hadoop deletes it when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/revlens-llm/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and go on from the copy: lineage is cut, a lost executor costs nothing."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application (what ``--py-files`` does)."""
    sc = spark.sparkContext
    if any(x.endswith("/revlens-code.zip") for x in sc._python_includes) or "revlens-code.zip" in sc._python_includes:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(revlens.__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="revlens-code-"), "revlens-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder_, _, names in os.walk(os.path.join(root, "revlens")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder_, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
