"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The table, written once: what reads it neither plans nor computes it again, and a lost executor loses none of it.

    The folder is spark.checkpoint.dir. Only in local mode, where one machine is all, is there
    one of our own if that is unset.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or f"file:///tmp/checkpoints/{sc.applicationId}")
    return df.checkpoint(eager=True)


#: Characters of a table that may be sent to every executor.
SMALL = 4_000_000


def small(df: DataFrame, text: str):
    """F.broadcast if the texts of the table, which has been cut, have few characters, else nothing: the other side of a join then doesn't move."""
    rows, chars = df.agg(F.count("*"), F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0))).first()
    return F.broadcast if chars + 100 * rows <= SMALL else lambda df: df
