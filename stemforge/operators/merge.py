"""Insert-or-ignore, upserts with a rule for each column, and fills of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import merge_maps


def first_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """One row a key, the first in `order`; a partial aggregate, so equal keys shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    if rest == [order]:
        return rows.groupBy(*keys).agg(F.min(order).alias(order))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """`target` with the rows of new keys, the first row of each."""
    fresh = first_wins(rows, keys, order).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def fold(rows: DataFrame, keys: list[str], order: str, keep_given: list[str], keep_filled: list[str], replace: list[str]) -> DataFrame:
    """Rows of one batch folded by key in order: last given, last non-empty array, or last value of each column.

    Rows where a column does not count are left out of its maximum by a null order.
    """
    aggs: list[Column] = []
    for c in keep_given:
        aggs.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c))
    for c in keep_filled:
        aggs.append(F.max_by(c, F.when(F.size(c) > 0, F.col(order))).alias(c))
    for c in replace:
        aggs.append(F.max_by(c, order).alias(c))
    return rows.groupBy(*keys).agg(*aggs)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_given: list[str] = (), keep_filled: list[str] = (), replace: list[str] = (), maps: list[str] = (), now: int | Column | None = None) -> DataFrame:
    """Full outer join of a table with a folded batch.

    keep_given: coalesce(new, old). keep_filled: new unless empty. replace: new wherever the key is in the
    batch. maps: shallow union. `now` sets updated_at of touched rows and created_at of new ones.
    """
    o, n = old.alias("o"), new.withColumn("__in", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    touched = F.coalesce(F.col("n.__in"), F.lit(False))
    out = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    out += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in keep_given]
    out += [F.when(F.size(f"n.{c}") > 0, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in keep_filled]
    out += [F.when(touched, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in replace]
    out += [merge_maps(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in maps]
    if now is not None:
        stamp = now if isinstance(now, Column) else F.lit(now)
        out += [F.coalesce("o.created_at", stamp).alias("created_at"), F.when(touched, stamp).otherwise(F.col("o.updated_at")).alias("updated_at")]
    return joined.select(*out)


def fill_missing(rows: DataFrame, found: DataFrame, key: str, columns: dict[str, str], arrays: dict[str, str] | None = None, note: Column | None = None) -> DataFrame:
    """Set columns only where they are null, and array columns where empty; `note` is merged into `sources`
    of rows that changed, so provenance is not lost and rows that did not change stay as they are.
    """
    joined = rows.alias("r").join(found.alias("f"), F.col(f"r.{key}") == F.col(f"f.{key}"), "left")
    arrays = arrays or {}
    changed = F.lit(False)
    new: dict[str, Column] = {}
    for c, src in columns.items():
        new[c] = F.coalesce(f"r.{c}", f"f.{src}")
        changed = changed | (F.col(f"r.{c}").isNull() & F.col(f"f.{src}").isNotNull())
    for c, src in arrays.items():
        hole, given = F.coalesce(F.size(f"r.{c}"), F.lit(0)) <= 0, F.coalesce(F.size(f"f.{src}"), F.lit(0)) > 0
        new[c] = F.when(hole & given, F.col(f"f.{src}")).otherwise(F.col(f"r.{c}"))
        changed = changed | (hole & given)
    if note is not None:
        new["sources"] = F.when(changed, merge_maps(F.col("r.sources"), note)).otherwise(F.col("r.sources"))
    return joined.select(*[new.get(c, F.col(f"r.{c}")).alias(c) for c in rows.columns], changed.alias("changed"))


def overlay_first(rows: DataFrame, pairs: DataFrame, column: str, on: str = "lemma") -> DataFrame:
    """Fill `column` where null from (word, column, ord) pairs; the first pair of a word counts."""
    best = pairs.groupBy(F.col("word").alias(on)).agg(F.min_by(column, "ord").alias("__v"))
    return rows.join(best, on, "left").withColumn(column, F.coalesce(column, "__v")).drop("__v")


def overlay_last(rows: DataFrame, pairs: DataFrame, column: str, value: str, on: str = "lemma") -> DataFrame:
    """Set `column` from (word, value, ord) pairs wherever a word has one; the last pair counts."""
    best = pairs.groupBy(F.col("word").alias(on)).agg(F.max_by(value, "ord").alias("__v"))
    return rows.join(best, on, "left").withColumn(column, F.coalesce("__v", column)).drop("__v")
