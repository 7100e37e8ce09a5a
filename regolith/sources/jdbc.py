"""The registry's tables from a database over JDBC, read in parts by a numeric key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a part, as far as keys are evenly dealt, and parts at most (each is a connection).
PART, MOST_PARTS = 1_000_000, 64


def tables(spark: SparkSession, url: str, keys: dict[str, str], options: dict[str, str] | None = None, part: int = PART) -> Callable[[str], DataFrame]:
    """A reader of tables by name, for `Registry`. keys: the numeric key that a table is parted by.

    Filters and column choices reach the database. A table without a known key, or without rows, is read in one part.
    """
    base = {"url": url, **(options or {})}

    def read(name: str) -> DataFrame:
        plain = spark.read.format("jdbc").options(**base, dbtable=name).load()
        if name not in keys:
            return plain
        column = next(c for c in plain.columns if c.lower() == keys[name].lower())
        least, most, n = plain.agg(F.min(column).cast("long"), F.max(column).cast("long"), F.count(F.lit(1))).first()
        if not n or least == most:
            return plain
        parts = max(1, min(MOST_PARTS, -(-n // part)))
        return spark.read.format("jdbc").options(**base, dbtable=name, partitionColumn=column, lowerBound=least, upperBound=most + 1, numPartitions=parts).load()

    return lambda name: _lower(read(name))


def _lower(df: DataFrame) -> DataFrame:
    """Databases may fold names to upper case."""
    return df.select([F.col(c).alias(c.lower()) for c in df.columns])
