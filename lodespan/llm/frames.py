"""Frames whose columns are renamed by place, so that names of a caller's columns clash with nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... in order; toDF with the old names, dotted or not, turns it back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """What numbered(df) calls the column name."""
    return f"c{df.columns.index(name)}"
