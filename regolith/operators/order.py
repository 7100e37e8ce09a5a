"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.operators.graph import cut

#: Rows of a range.
RANGE = 2_000_000


def numbered(df: DataFrame, by: list[str], out: str = "place") -> DataFrame:
    """Rows with their place (from 0) in order of `by`: ranges of rows are numbered apart, and then each range starts after
    those before it. There are as many ranges as the rows need; their sizes, one row each, are summed up in one task."""
    df = cut(df)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE))
    dealt = cut(df.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = dealt.withColumn(out, F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1)
    return own.join(before, "_range").withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")
