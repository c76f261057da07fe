"""O-06 for growing inputs: a rollup that new files are added to (mergeable partial results).

A store holds one folder of partial results per batch of files and a manifest
of the files behind it. An update aggregates the files that the manifest
doesn't name and adds their folder; the rollup merges the partial rows of all
batches, so files that were read before are never read again. A file that
changed or vanished starts the store anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.sources.files import path_exists

__all__ = ["input_files", "update_rollup"]

_MANIFEST = "path string, size long, changed long, batch string"


def input_files(spark: SparkSession, path: str, suffix: str = "") -> list[tuple[str, int, int]]:
    """(path, size, time) of the data files under a folder: metadata only."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while found.hasNext():
        f = found.next()
        name = f.getPath().getName()
        if not name.startswith(("_", ".")) and name.endswith(suffix):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def _generation(spark: SparkSession, store: str, fresh: bool) -> str:
    """The folder of the current generation; ``fresh`` opens the next one."""
    n = 0
    while path_exists(spark, f"{store}/gen-{n + 1}"):
        n += 1
    return f"{store}/gen-{n + 1 if fresh else n}"


def update_rollup(spark: SparkSession, inputs: str, store: str, read: Callable[[list[str]], DataFrame],
                  partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], suffix: str = "") -> DataFrame:
    """The rollup of all files under ``inputs``; only files that the store doesn't know are read.

    ``read`` scans a list of files, ``partial`` aggregates them to mergeable
    rows, ``merge`` adds such rows up. A batch counts once its files are in
    the manifest, which is written after its results: an update that is cut
    short is done again. Without any file there is nothing to roll up
    (ValueError).
    """
    store = store.rstrip("/")
    files = input_files(spark, inputs, suffix)
    if not files:
        raise ValueError(f"no files under {inputs}")
    at = _generation(spark, store, fresh=False)
    known = {}
    if path_exists(spark, f"{at}/manifest"):
        known = {r["path"]: (r["size"], r["changed"], r["batch"]) for r in spark.read.schema(_MANIFEST).parquet(f"{at}/manifest").collect()}
    now = {p: (size, changed) for p, size, changed in files}
    if any(now.get(p) != k[:2] for p, k in known.items()):
        at, known = _generation(spark, store, fresh=True), {}
    new = [f for f in files if f[0] not in known]
    batches = {k[2] for k in known.values()}
    if new:
        batch = hashlib.md5(repr(new).encode(), usedforsecurity=False).hexdigest()
        partial(read([p for p, _, _ in new])).write.mode("overwrite").parquet(f"{at}/parts/{batch}")
        spark.createDataFrame([(*f, batch) for f in new], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{at}/manifest")
        batches.add(batch)
    return merge(spark.read.parquet(*[f"{at}/parts/{b}" for b in sorted(batches)]))
