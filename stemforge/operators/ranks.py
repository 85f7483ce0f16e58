"""Order statistics of whole columns and of groups of any size: percent ranks and medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered
from .store import released, stored


def joined_by_count(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`left` joined with the one row of each key in `right`, which has `rows`, the key's rows in `left`, of `total`.

    Keys of over a thousandth of all rows are fewer than a thousand: those are broadcast. The others are small and shuffled.
    """
    many = F.col("rows") > max(1, total // 1000)
    hot = F.broadcast(right.where(many).drop("rows"))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(~many).drop("rows"), keys)
    return left.join(hot, keys).unionByName(rest)


def percent_ranked(rows: DataFrame, value: str, name: str = "percent_rank") -> DataFrame:
    """Adds each row's percent rank by `value`, as the window function over the whole table has it; nulls get null.

    Rows are numbered over ranges; of equal values, wherever the ranges cut them, all take the first one's number.
    """
    known = stored(numbered(rows.where(F.col(value).isNotNull()), F.col(value), name="__n"))
    total = known.count()
    first = stored(known.groupBy(value).agg(F.min("__n").alias("__first"), F.count("*").alias("rows")))
    ranked = joined_by_count(known, first, [value], total).withColumn(name, F.col("__first") / F.lit(max(1, total - 1))).select(*rows.columns, name)
    return ranked.unionByName(rows.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double")))


def medians(rows: DataFrame, group: str, value: str, buckets: int = 1024, few: int = 10_000) -> DataFrame:
    """(group, median): the exact median of each group's numbers, null where it has none.

    The middle ranks are searched by histograms: each round counts the values of the range that a group's rank lies
    in by bucket, and goes on with the bucket that holds it, from its smallest to its largest value. A range of
    one value, or of at most `few` values, which are sorted, settles it. No task holds more of a group than that.
    """
    every = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    known = stored(every.where("v is not null and not isnan(v)"))
    sizes = known.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("rank")
    todo = stored(sizes.select("g", ranks, "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    done = []
    while True:
        done.append(todo.where("lo = hi").select("g", "rank", F.col("lo").alias("v")))
        done.append(_sorted(known, todo.where((F.col("lo") < F.col("hi")) & (F.col("inside") <= few))))
        wide = todo.where((F.col("lo") < F.col("hi")) & (F.col("inside") > few))
        if wide.isEmpty():
            break
        part = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.least(F.floor(part * buckets), F.lit(buckets - 1))
        counts = _inside(known, wide).groupBy("g", "rank", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # a group's histogram is at most `buckets` rows
        lists = counts.groupBy("g", "rank").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "lo", "hi"))).alias("h"))
        met = wide.select(F.col("g").alias("wg"), F.col("rank").alias("wrank"), "below")
        lists = lists.join(met, F.col("g").eqNullSafe(F.col("wg")) & (F.col("rank") == F.col("wrank")))
        start = F.struct(F.col("below").alias("below"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

        def step(acc, b):
            here = acc["n"].isNull() & (F.col("rank") < acc["below"] + b["n"])
            return F.when(acc["n"].isNotNull(), acc).when(here, F.struct(acc["below"].alias("below"), b["n"].alias("n"), b["lo"].alias("lo"), b["hi"].alias("hi"))).otherwise(F.struct((acc["below"] + b["n"]).alias("below"), acc["n"].alias("n"), acc["lo"].alias("lo"), acc["hi"].alias("hi")))

        todo = stored(lists.select("g", "rank", F.aggregate("h", start, step).alias("e")).select("g", "rank", "e.lo", "e.hi", "e.below", F.col("e.n").alias("inside")))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    middle = found.groupBy("g").agg(F.avg("v").alias("median"))
    groups = every.select("g").distinct()
    out = groups.join(middle.withColumnRenamed("g", "mg"), F.col("g").eqNullSafe(F.col("mg")), "left").select(F.col("g").alias(group), "median")
    out = stored(out)
    released(known)
    return out


def _inside(known: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values with each range of their group that they lie in; a group has two ranges at most."""
    ranges = ranges.select(F.col("g").alias("rg"), "rank", "lo", "hi", "below")
    return known.join(ranges, F.col("g").eqNullSafe(F.col("rg")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("rg")


def _sorted(known: DataFrame, ranges: DataFrame) -> DataFrame:
    lists = _inside(known, ranges).groupBy("g", "rank", "below").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return lists.select("g", "rank", F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v"))
