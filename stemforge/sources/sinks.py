"""Sinks: nested export, key-value upsert, rebuild, dry run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebuild(rows: DataFrame, path: str) -> None:
    """Replace a table as a whole, also by rows that are read from it.

    The new table is written beside the old one. When it is complete the old one is moved aside, the new one
    takes its place, and only then the old one is deleted; if it can't, the old one is moved back. What a
    run that broke off in between moved aside is put back first.
    """
    sc = rows.sparkSession.sparkContext
    here, new, old = (sc._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".new", ".old"))
    fs = here.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(here):
        fs.rename(old, here)
    rows.write.mode("overwrite").parquet(new.toString())
    fs.delete(old, True)
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"{path} could not be moved aside; the new table is in {new.toString()}")
    if not fs.rename(new, here):
        fs.rename(old, here)
        raise OSError(f"{path} could not be replaced; the new table is in {new.toString()}")
    fs.delete(old, True)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def dry_run(rows: DataFrame) -> None:
    """Run the whole plan and write nothing."""
    rows.write.format("noop").mode("overwrite").save()


def put(old: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """Key-value table after an upsert: of a key's new values the last one in `order` replaces the old one."""
    last = new.groupBy("key").agg(F.max_by("value", order).alias("value"))
    return old.join(new, "key", "left_anti").select("key", "value").unionByName(last)


def export_document(clusters: DataFrame, stats: DataFrame, path: str, layout: dict[str, str | int] | None = None, version: int = 3) -> None:
    """A nested document as compact JSON lines: a head (version, stats, layout if given), then a line a cluster.

    clusters: ord and the fields of a cluster. stats: one row. Lines are written side by side by many tasks;
    `read_document` puts them in order again.
    """
    fields = [c for c in clusters.columns if c != "ord"]
    parts = [F.lit(version).alias("version"), F.struct(*stats.columns).alias("stats")]
    if layout is not None:
        parts.append(F.struct(*[F.lit(v).alias(k) for k, v in layout.items()]).alias("layout"))
    head = stats.select(F.to_json(F.struct(*parts)).alias("value"))
    lines = clusters.select(F.to_json(F.struct("ord", F.struct(*fields).alias("cluster"))).alias("value"))
    head.unionByName(lines).write.mode("overwrite").text(path)
