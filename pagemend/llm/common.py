"""Shared pieces: settings, checkpoints in the shared folder, byte-level text rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all text contracts: space and U+0009..U+000D.
NONSPACE = "[^\\x20\\x09-\\x0D]+"


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch of long texts can hold in a Python worker."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)),
        ("spark.sql.execution.pythonUDF.arrow.enabled", "true"),
    ):
        try:
            spark.conf.set(key, value)
        except Exception:  # a Spark release without the setting
            pass


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def settle() -> None:
    """Give what a Python worker no longer uses back to the machine: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode alone, where one machine is all, a folder of our own if unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file:///tmp/checkpoints/{sc.applicationId}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


#: Files of the tables that are cut inside each open ``scratch``, innermost last.
_OPEN: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Only narrow tables (ids, hashes, sketches, counts) are cut; texts never are.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _OPEN:
        _OPEN[-1] += _files_of(out)
    return out


def _files_of(df: DataFrame) -> list[str]:
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return [file.get()] if file.isDefined() else []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """``with scratch(spark) as keep``: tables cut inside are deleted at the end, but for what ``keep`` has cut."""
    _OPEN.append([])

    def keep(df: DataFrame) -> DataFrame:
        shared_folder(spark)
        out = df.checkpoint(eager=True)
        if len(_OPEN) > 1:
            _OPEN[-2] += _files_of(out)
        return out

    try:
        yield keep
    finally:
        for file in _OPEN.pop():
            delete_uri(spark, file)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that were cut and aren't read again, and let go of the shuffle files behind all tables that have been cut.

    Spark removes those once nothing refers to them, but looks for them seldom; asking for a
    collection frees the disks between the steps of a long operator.
    """
    for table in tables:
        for file in _files_of(table):
            delete_uri(spark, file)
            for own in _OPEN:
                if file in own:
                    own.remove(file)
    gc.collect()
    spark._jvm.System.gc()


def reserved(table: DataFrame, *prefixes: str) -> None:
    """ValueError if a column of the table begins with a name that the operator uses for its own."""
    taken = [c for c in table.columns if c.lower().startswith(tuple(prefixes))]
    if taken:
        raise ValueError(f"columns {taken} clash with the operator's own; rename them first")


def scratch_uri(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_uri(spark: SparkSession, uri: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hashed_unit(*cols, bits: int = 20):
    """A uniform number k / 2**bits from the md5 of the columns' text (the same in any engine)."""
    text = F.md5(F.concat_ws("|", *cols).cast("binary"))
    top = F.conv(F.substring(text, 1, 8), 16, 10).cast("long")
    return (top % F.lit(1 << bits)).cast("double") / F.lit(float(1 << bits))
