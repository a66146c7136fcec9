"""Small column helpers shared by the native operators."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of text that an Arrow batch brings to a Python worker at most; smaller settings stay.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f(spark, ...)`` in a session whose Arrow batches are small, so that workers need little memory
    however long the texts are. The settings stay, because ``f`` gives a plan that runs later."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        for key, most in BATCH.items():
            now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
            if not 0 < now <= most:
                spark.conf.set(key, str(most))
        return f(spark, *args)

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where ``body`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def id_key(df: DataFrame, id_col: str) -> Column:
    """An id as a key that is never null and orders null last: a number where ids are whole numbers, else a struct."""
    kind = dict(df.dtypes)[id_col]
    if kind in _WHOLE:
        return F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1))
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def unused(df: DataFrame, name: str) -> str:
    """``name``; an error where ``df`` has such a column, because no operator replaces a caller's column."""
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {name}")
    return name


def words(text: Column) -> Column:
    """The words of a text; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def indices(n: Column) -> Column:
    """0 .. n - 1, empty where n < 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
