"""Tables between the steps of a loop, kept where every machine of the cluster can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below spark.checkpoint.dir; it is removed when the driver ends.

    A folder of our own takes its place only in local mode with none set, as in tests.
    """
    sc = spark.sparkContext
    got = getattr(sc, "_stemforge_tables", None)
    if got is None:
        top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not top:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            top = tempfile.mkdtemp(prefix="stemforge-")
        got = sc._stemforge_tables = f"{top.rstrip('/')}/stemforge-tables-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(got)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return got


def stored(rows: DataFrame, *partitioned: str) -> DataFrame:
    """`rows` as a Parquet table in the shared folder, which cuts the lineage and survives lost executors."""
    folder = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.partitionBy(*partitioned).option("compression", "zstd").parquet(folder)
    out = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    out._stemforge_table = folder
    return out


def released(*tables: DataFrame | None) -> None:
    """Delete tables that `stored` gave and no plan that is still to run reads."""
    for t in tables:
        folder = getattr(t, "_stemforge_table", None)
        if folder:
            sc = t.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
