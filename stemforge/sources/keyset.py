"""Changes of a table as a stream of pages: a Python data source whose offset is the last (stamp, key) delivered.

    spark.dataSource.register(KeysetSource)
    spark.readStream.format("keyset").option("path", p).option("stamp", "updated_at").option("key", "id").load()

A batch is the next `limit` rows after the offset, by stamp and then key, so rows that share the stamp of a page's
end come with the next page, and a restart goes on after the last page that was committed. Between pages nothing
is held. The table is a Parquet file or folder that only grows at its end: a row whose stamp is before the
offset when it is added is not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType, TimestampNTZType

from ..operators.order import numbered
from ..operators.store import stored

#: Rows of a page, as many as the change service gives at most.
PAGE = 2000


def _dataset(path: str) -> pads.Dataset:
    fs, root = pafs.FileSystem.from_uri(path)
    return pads.dataset(root, filesystem=fs, format="parquet", exclude_invalid_files=False)


def _plain(kind: pa.DataType) -> pa.DataType:
    """The type in which an offset can be written down: times as numbers."""
    return pa.int32() if pa.types.is_date32(kind) else pa.int64() if pa.types.is_temporal(kind) else kind


class _Pages(SimpleDataSourceStreamReader):
    """A page is a bounded list of rows, so it may pass through the driver, as this kind of reader does."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.stamp, self.key = options["path"], options["stamp"], options["key"]
        self.limit, self.schema, self.columns = int(options.get("limit", PAGE)), schema, schema.names
        if not 1 <= self.limit <= 1_000_000:
            raise ValueError("limit must be from 1 to 1000000")

    def initialOffset(self) -> dict:
        return {"stamp": None, "key": None}

    def _scalars(self, table: pads.Dataset, offset: dict) -> list[pa.Scalar]:
        kinds = [table.schema.field(n).type for n in (self.stamp, self.key)]
        return [pa.scalar(offset[c], _plain(t)).cast(t) for c, t in zip(("stamp", "key"), kinds, strict=True)]

    def _rows(self, start: dict, end: dict | None) -> pa.Table:
        """Rows after `start`, up to `end` or the first `limit` of them, in order.

        The condition goes to the scan, which leaves out row groups by their statistics; of what comes, no more
        than `limit` rows and a batch are held.
        """
        table = _dataset(self.path)
        stamp, key = pads.field(self.stamp), pads.field(self.key)
        wanted = stamp.is_valid() & key.is_valid()
        if start["key"] is not None:
            s, k = self._scalars(table, start)
            wanted &= (stamp > s) | ((stamp == s) & (key > k))
        if end is not None:
            s, k = self._scalars(table, end)
            wanted &= (stamp < s) | ((stamp == s) & (key <= k))
        columns = list(dict.fromkeys([*self.columns, self.stamp, self.key]))
        order = [(self.stamp, "ascending"), (self.key, "ascending")]
        kept, held = None, []
        for batch in table.scanner(columns=columns, filter=wanted, batch_size=8192).to_batches():
            held.append(batch)
            if sum(b.num_rows for b in held) >= self.limit and end is None:
                kept, held = self._least(kept, held, order), []
        got = self._least(kept, held, order, cut=end is None)
        return got if got is not None else table.schema.empty_table().select(columns)

    def _least(self, kept: pa.Table | None, held: list[pa.RecordBatch], order: list, cut: bool = True) -> pa.Table | None:
        parts = ([kept] if kept is not None else []) + ([pa.Table.from_batches(held)] if held else [])
        if not parts:
            return None
        got = pa.concat_tables(parts)
        got = got.take(pc.sort_indices(got, sort_keys=order))
        return got.slice(0, self.limit) if cut else got

    def _tuples(self, rows: pa.Table) -> Iterator[tuple]:
        rows = rows.select(self.columns)
        for i, f in enumerate(rows.schema):
            if pa.types.is_timestamp(f.type):
                naive = isinstance(self.schema[f.name].dataType, TimestampNTZType)
                rows = rows.set_column(i, f.name, rows.column(i).cast(pa.timestamp("us"), safe=False).cast(pa.timestamp("us", None if naive else "UTC")))
        return iter([tuple(r[c] for c in self.columns) for r in rows.to_pylist()])

    def _offset(self, rows: pa.Table) -> dict:
        last = {c: rows.column(n)[-1] for c, n in (("stamp", self.stamp), ("key", self.key))}
        return {c: v.cast(_plain(v.type)).as_py() for c, v in last.items()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start, None)
        return self._tuples(rows), self._offset(rows) if rows.num_rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A page again, after a failure."""
        return self._tuples(self._rows(start, end)) if end["key"] is not None else iter(())

    def commit(self, end: dict) -> None:
        pass


class KeysetSource(DataSource):
    """Options: path, stamp and key (columns), limit (rows of a page)."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        fields = _dataset(self.options["path"]).schema
        # times of 96 bits, as Spark writes them, are moments, though the file does not say so
        moments = [f.with_type(pa.timestamp("us", "UTC")) if f.type == pa.timestamp("ns") else f for f in fields]
        return from_arrow_schema(pa.schema(moments))

    def simpleStreamReader(self, schema: StructType) -> _Pages:
        return _Pages(self.options, schema)


def changes(spark: SparkSession, path: str, stamp: str, key: str, limit: int = PAGE) -> DataFrame:
    """A stream of the table's rows in the order of stamp and key, at most `limit` a batch."""
    spark.dataSource.register(KeysetSource)
    return spark.readStream.format("keyset").option("path", path).option("stamp", stamp).option("key", key).option("limit", str(limit)).load()


def paged(rows: DataFrame, stamp: str, key: str, limit: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """(rows with their `page`, directory of pages): pages of `limit` rows by stamp and key, numbered from 0.

    The directory holds a row a page: its number, its first stamp (`since`), the stamp and key of its last row. A stream of it, by
    `changes`, is a stream of pages of which only their ends pass through the driver, many a batch; `rows_of` reads
    their rows. The rows are stored in order, so that a span of pages is read without the others.
    """
    placed = numbered(rows.where(F.col(stamp).isNotNull() & F.col(key).isNotNull()), F.col(stamp), F.col(key))
    placed = placed.withColumn("page", F.floor(F.col("n") / limit)).drop("n")
    ends = placed.groupBy("page").agg(F.min(stamp).alias("since"), F.max(F.struct(stamp, key)).alias("end"))
    return placed, stored(ends.select("page", "since", f"end.{stamp}", f"end.{key}"))


def rows_of(placed: DataFrame, ends: DataFrame, stamp: str) -> DataFrame:
    """Rows of a batch of pages. They follow one another, so a span tells them; that of stamps is pushed down."""
    span = ends.agg(F.min("page").alias("first"), F.max("page").alias("last"), F.min("since").alias("since"), F.max(stamp).alias("stop")).first()
    return placed.where(F.col("page").between(span["first"], span["last"]) & F.col(stamp).between(span["since"], span["stop"]))
