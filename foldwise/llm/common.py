"""Reading, writing and text expressions shared by the operators.

White space is always the six ASCII characters of ``WS_CHARS``; a word is a
longest run of other characters.  A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.session import materialise

__all__ = ["WS", "WS_CHARS", "materialise", "table", "text_of", "words"]

WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, WS), "")
