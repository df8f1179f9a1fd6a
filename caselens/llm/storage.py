"""Intermediate tables in the shared folder, and joins with sides of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder

BROADCAST_ROWS = 1 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: compact, and it
    survives lost executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def small_or_not(df: DataFrame) -> DataFrame:
    """A stored table of few numbers a row, marked for broadcast while its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free_name(name: str, taken) -> str:
    """``name``, or with underscores in front until no column of ``taken`` has it."""
    taken = {column.lower() for column in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name
