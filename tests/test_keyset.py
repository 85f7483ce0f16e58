"""The change source: pages in order, ties at a page's end, restarts, rows that come later."""

import datetime as dt

import pytest

from stemforge.sources import keyset

SCHEMA = "id string, updated_at timestamp, v int"


def rows(n, first=0):
    """Stamps with long ties: seven rows share each."""
    at = dt.datetime(2024, 1, 1)
    return [(f"k{(i * 37) % 1000:04d}", at + dt.timedelta(seconds=(first + i) // 7, microseconds=5), i) for i in range(n)]


def run(spark, path, out, checkpoint, limit, batches=None):
    """Pages into a table; with `batches` the query is stopped after so many."""
    seen = []

    def keep(page, number):
        found = page.collect()
        seen.append((number, [(r["updated_at"], r["id"]) for r in found]))
        page.write.mode("append").parquet(out)
        if batches is not None and len(seen) >= batches:
            raise InterruptedError("stopped here")

    q = keyset.changes(spark, path, "updated_at", "id", limit).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    except Exception as e:
        assert batches is not None and "stopped here" in str(e), e
    finally:
        q.stop()
    return seen


def test_pages_and_restarts(spark, tmp_path):
    path, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    table = rows(60)
    spark.createDataFrame([*table, ("none", None, 1), (None, table[0][1], 2)], SCHEMA).repartition(4).write.parquet(path)
    order = sorted((t, i) for i, t, _ in table)
    first = run(spark, path, out, cp, 10, batches=3)  # the third page fails after it was written
    assert [p for _, page in first for p in page] == order[:30]
    second = run(spark, path, out, cp, 10)
    assert second[0] == first[2] and [p for _, page in second for p in page] == order[20:]  # that page comes again, whole, under its number
    assert max(len(page) for _, page in first + second) == 10
    spark.createDataFrame(rows(25, first=70), SCHEMA).write.mode("append").parquet(path)
    third = run(spark, path, out, cp, 10)
    assert [p for _, page in third for p in page] == sorted((t, i) for i, t, _ in rows(25, first=70))
    assert run(spark, path, out, cp, 10) == []


def test_bounds(spark, tmp_path):
    spark.createDataFrame([(i, i // 4, "x") for i in range(30)], "key long, seq long, v string").write.parquet(str(tmp_path / "in"))
    reader = keyset._Pages({"path": str(tmp_path / "in"), "stamp": "seq", "key": "key", "limit": "7"}, keyset.KeysetSource({"path": str(tmp_path / "in")}).schema())
    at, got = reader.initialOffset(), []
    for _ in range(9):
        page, end = reader.read(at)
        page = list(page)
        assert list(reader.readBetweenOffsets(at, end)) == page or not page
        got += [r[0] for r in page]
        at = end
    assert got == list(range(30))
    with pytest.raises(ValueError, match="limit"):
        keyset._Pages({"path": "p", "stamp": "s", "key": "k", "limit": "0"}, reader and keyset.KeysetSource({"path": str(tmp_path / "in")}).schema())


def test_pages_by_their_ends(spark, tmp_path):
    """Only ends of pages are streamed, many a batch; their rows are all rows in order, `limit` a page."""
    table = rows(60)
    placed, ends = keyset.paged(spark.createDataFrame([*table, ("none", None, 1)], SCHEMA).repartition(4), "updated_at", "id", 7)
    got, batches = [], []

    def keep(pages, number):
        batches.append(pages.count())
        got.extend(tuple(r) for r in keyset.rows_of(placed, pages, "updated_at").select("page", "updated_at", "id").collect())

    q = keyset.changes(spark, ends._stemforge_table, "updated_at", "id", 4).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    order = sorted((t, i) for i, t, _ in table)
    assert batches == [4, 4, 1] and sorted(got) == [(n // 7, *r) for n, r in enumerate(order)]
