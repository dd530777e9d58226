"""Row numbers of a sorted table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.sources.scratch import materialize


def number(df: DataFrame, order: list[Column | str], name: str, by: str | None = None) -> DataFrame:
    """df with its place (from 1) in the given total order, within each value of by where that is given.

    Rows are dealt by ranges of the order and sorted there; a place is the row's place in its range plus the rows of earlier ranges. Only
    counts of ranges (and values of by in them) are joined back. Equal rows in the order have places in any order."""
    keys = [F.col(by), *order] if by else list(order)
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    spread = materialize(spread.withColumns({"_at": at, "_range": F.shiftright(at, 33)}), "sorted")
    if by is None:
        spread = spread.withColumn("_by", F.lit(0))
    else:
        spread = spread.withColumn("_by", F.col(by))
    sizes = spread.groupBy("_range", "_by").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    # counts only: a row for each range and value that meet
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", F.col("_by").alias("_of"), "first", before.alias("before"))
    out = spread.alias("s").join(starts.alias("t"), (F.col("s._range") == F.col("t._range")) & F.col("s._by").eqNullSafe(F.col("t._of")))
    return out.select(*[f"s.{c}" for c in df.columns], (F.col("_at") - F.col("first") + F.col("before") + 1).alias(name))
