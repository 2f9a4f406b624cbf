"""Helpers the operators share: tables by path, staged results, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import staging_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what is expensive runs
    once and a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else Spark joins by
    shuffling, and splits hot keys at run time. The result is the same."""
    return F.broadcast(df) if df.count() <= rows else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def held_out(key: Column) -> Column:
    """Whether a row is kept for evaluation: crc32 of the key as text leaves 2 by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def whole(text: str | None) -> str:
    """A text, empty for null."""
    return text if isinstance(text, str) else ""


def batches(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of at most ``rows``."""
    for frame in frames:
        for start in range(0, len(frame), rows):
            yield frame.iloc[start : start + rows]
