"""Dense numbers in a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

_LOCAL = (1 << 33) - 1


def numbered(rows: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """Adds 0, 1, 2, ... in the given order, which should be total.

    Rows are dealt out by ranges of the order and sorted within; a range's numbers begin after all rows of
    the ranges before it, a table of one row a range. Ranges are stored, as both parts must see the same ones
    even if an executor is lost in between.
    """
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    numbers = F.col("__before") + F.col("__id").bitwiseAND(F.lit(_LOCAL))
    return ranged.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, numbers).drop("__part", "__id", "__before")
