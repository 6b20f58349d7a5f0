"""Hints on how a plan is cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_built: dict[tuple, Column] = {}


def built_once(key: tuple, build: Callable[[], Column]) -> Column:
    """A large expression, built once for each application: building talks to the JVM thousands of times."""
    sc = SparkContext._active_spark_context
    key = (sc.applicationId if sc else None, repr(key))
    if key not in _built:
        _built[key] = build()
    return _built[key]


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with these columns computed once before anything that uses them.

    The optimizer copies an expression into each of its uses, which multiplies with every layer of
    checks on checks; a generator of one row, in the same stage, is a line it doesn't cross.
    """
    once = F.explode(F.array(F.struct(*columns))).alias("_once")
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, once).select(*rest, *(F.col(f"_once.{c}").alias(c) for c in columns))


def apart(c: str) -> Column:
    """A column to put into a layer of many checks, from any plain column of it.

    Spark writes the layers of a stage as few methods, and the JVM interprets a method of more than 8,000 bytes for
    good. A layer with a lambda is a projection of its own, which Spark cuts into small methods.
    """
    return F.transform(F.array(c), lambda x: x)
