"""Periodic runs, WARC archives and centroid clusters against plain restatements of their contracts."""

import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from helpers import frame, sample, words
from pyspark.sql import functions as F

from stemforge.llm import centroids, periodic, warc

SPACE = "[^\x20\x09-\x0D]+"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_runs(ws):
    """Every maximal stretch by trying all periods; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(ws) // 2 + 1):
        i = 0
        while i + q < len(ws):
            s = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            if i > s and i - s + q >= max(12, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_report(doc_id, text, plant=True):
    ws = re.findall(SPACE, text or "")
    n = len(ws)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(ws)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha(lines), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def run_rows():
    rng = random.Random(3)
    rows = sample()
    rows += [(1000 + i, words(rng, rng.randint(0, 200))) for i in range(120)]
    rows += [(2000, "a " * 12), (2001, "a " * 11), (2002, "a b " * 6), (2003, "x " + "a b c d e f g " * 2), (2004, "x " + "a b c d e f " * 2), (2005, "a b a b a " * 8 + "c"), (2006, "  \x85 a\x1cb " * 9), (2007, ("p q r " * 30 + "s ") * 4), (2008, "\n a \t a\r" * 7)]
    rows += [(3000 + i, " ".join(rng.choice("abc"[: 1 + i % 3]) for _ in range(rng.randint(10, 90)))) for i in range(60)]
    block = words(rng, 700)
    return rows + [(4000, f"{block} {block} tail"), (4001, f"{block} other {block}"), (4002, f"{block} {block} {block[: len(block) // 2]}")]


def test_periodic_runs_equal_all_periods(spark):
    rows = run_rows()
    docs = frame(spark, rows)
    planted = docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))
    got = periodic.run_report(periodic.find_runs(planted)).collect()
    expected = [plain_report(i, t) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected)) and sum(e[1] for e in expected) > 60


def test_periodic_runs_of_nothing_and_of_much(spark):
    empty = frame(spark, [(0, "x")]).where("doc_id = 1")
    assert periodic.run_report(periodic.find_runs(empty)).count() == 0
    found = {r["doc_id"]: r for r in periodic.find_runs(frame(spark, [(1, None), (2, " \n"), (3, "a b"), (4, "w " * 300_000), (5, words(random.Random(1), 200_000))])).collect()}
    assert [found[i]["n_words"] for i in (1, 2, 3)] == [0, 0, 2] and found[1]["collapsed"] == found[2]["collapsed"] == "" and found[3]["collapsed"] == "a b"
    assert [tuple(r) for r in found[4]["runs"]] == [(0, 300_000, 1)] and found[4]["collapsed"] == "w" and found[5]["runs"] == []


def test_tandem_repeats_branch():
    """Each repeat stands once, at its right end, and the walk takes the smaller half only."""
    symbols = np.array([0, 1, 0, 1, 0, 2, -1])
    levels, suffixes = periodic._ranks(symbols)
    start, period = periodic.tandem_repeats(levels, suffixes)
    assert set(zip(start.tolist(), period.tolist(), strict=True)) == {(1, 2)}
    assert periodic.maximal_runs(np.array([5] * 40 + [-1]))[1].tolist() == [40]


def test_words_of_one_key_are_told_apart(monkeypatch):
    monkeypatch.setattr(periodic, "word_keys", lambda data, s, e: (e - s).astype(np.uint64))
    data = np.frombuffer(b"a b " * 12 + b"c", np.uint8)
    found = periodic.word_runs(data, np.array([0, len(data)]))
    assert [x.tolist() for x in found[3:]] == [[0], [0], [24], [2]]


PAGES = "page_id long, url string, html string, keep string, sha1 string, payload int, key double, hot_key int"


def page_rows():
    big, other = "<p>größer</p>" * 100, "<p>other</p>" * 100
    rows = [(i, f"http://h/{i}", big) for i in range(1, 9)] + [(20, None, other), (21, "http://x/\r\nWARC-Type: fake", other), (22, "u", "z" * 999), (23, "u", "z" * 999), (24, "u", "z" * 1000), (25, "u", "z" * 1000)]
    rows += [(30, "u", None), (31, "u", ""), (None, "u", big), (None, "v", "no id" * 300), (None, "v", "no id" * 300), (40, "u", "twice" * 300), (40, "u", "twice" * 300), (39, "u", "twice" * 300)]
    return rows + [(50, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30), (51, "u", "L" * 3_000_000)]


def page_frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "s", 1, 0.5, 2) for r in rows], PAGES).repartition(3)


def plain_pages(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        keep = max((j for j, _, o in rows if j is not None and (o or "") == (h or "")), default=None) if len(b) >= 1000 else None
        again = keep is not None and keep != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [100, 0])
def test_warc_pages(spark, bound, monkeypatch):
    rows = page_rows()
    whole = warc.deduplicated
    monkeypatch.setattr(warc, "deduplicated", lambda *a: whole(*a, broadcast_rows=bound))
    got = warc.page_report(spark, warc.archive_pages(page_frame(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == plain_pages(rows)
    none = warc.page_report(spark, warc.archive_pages(page_frame(spark, rows).where("page_id < 0")))
    assert none.count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_files_and_pushdown(spark, tmp_path, compression):
    rows = page_rows()
    path = str(tmp_path / "a")
    warc.write_warc(warc.page_records(page_frame(spark, rows)), path, compression=compression, file_bytes="1000")
    assert not [f for f in (tmp_path / "a").iterdir() if f.name.startswith("_")] and len(list((tmp_path / "a").iterdir())) > 3
    every = warc.read_warc(spark, path).collect()
    assert sum(r["record_type"] == "warcinfo" for r in every) == len(list((tmp_path / "a").iterdir()))
    pages = [r for r in every if r["record_type"] != "warcinfo"]
    assert len(pages) == len(rows) and all(r["headers"]["warc-type"] == r["record_type"] for r in pages)
    assert next(r for r in pages if r["headers"].get("x-page-id") == "21")["target_uri"] == "http://x/%0D%0AWARC-Type: fake"
    names = {r["record_id"] for r in pages if r["record_type"] == "response"}
    assert all(r["headers"]["warc-refers-to"] in names for r in pages if r["record_type"] == "revisit")
    some = warc.read_warc(spark, path, "x_page_id long, record_type string, content_length long").where("record_type = 'revisit' and x_page_id > 3 and x_page_id < 7 and content_length is not null")
    assert sorted(r["x_page_id"] for r in some.collect()) == [4, 5, 6]
    pushed = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in pushed, pushed
    assert warc.read_warc(spark, path, "x_page_id long").where("x_page_id is null").count() == 3 + len(list((tmp_path / "a").iterdir()))
    assert sorted(r["x_page_id"] for r in warc.read_warc(spark, path, "x_page_id long, target_uri string").where("x_page_id in (1, 50) or x_page_id = 51").collect()) == [1, 50, 51]
    assert warc.read_warc(spark, path, "record_type string").where("not record_type like 'res%' and record_type <> 'warcinfo'").count() == sum(r["record_type"] == "revisit" for r in pages)
    # a second write adds, an overwrite replaces
    warc.write_warc(warc.page_records(page_frame(spark, rows[:1])), path)
    assert warc.read_warc(spark, path, "record_type string").where("record_type <> 'warcinfo'").count() == len(rows) + 1
    warc.write_warc(warc.page_records(page_frame(spark, rows[:1])), path, mode="overwrite")
    assert warc.read_warc(spark, path, "record_type string").where("record_type <> 'warcinfo'").count() == 1


def test_warc_of_others(spark, tmp_path):
    """Records of another writer: one gzip member for all, members without lengths, folded lines, other content."""
    a = warc.encode_record({"record_type": "metadata", "content_type": "text/plain", "payload": b"m" * 70_000}, False)
    b = b"WARC/1.0\r\nwarc-type: resource\r\nX-Long: one\r\n two\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(a + b + a))
    (tmp_path / "each.warc.gz").write_bytes(gzip.compress(b) + gzip.compress(a) + gzip.compress(b))
    (tmp_path / "plain.warc").write_bytes(a + b)
    got = warc.read_warc(spark, str(tmp_path), "file string, record_type string, x_long string, payload binary").collect()
    assert len(got) == 8 and {(r["record_type"], bytes(r["payload"])) for r in got} == {("metadata", b"m" * 70_000), ("resource", b"abc")}
    assert {r["x_long"] for r in got if r["record_type"] == "resource"} == {"one two"}
    assert warc.read_warc(spark, str(tmp_path), "record_type string").where("record_type = 'resource'").count() == 4
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(a[:-80])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, str(tmp_path / "bad")).collect()


def test_unwanted_payloads_are_not_inflated(monkeypatch, tmp_path):
    """Records that a predicate drops, and all without `payload` in the schema, cost their headers only."""
    big = random.Random(1).randbytes(1 << 20)
    data = b"".join(warc.encode_record({"record_type": t, "payload": big}, True) for t in ("response", "request") * 4)
    (tmp_path / "x.warc.gz").write_bytes(data)
    asked = []
    inflated = warc._Inflated._more
    monkeypatch.setattr(warc._Inflated, "_more", lambda self, want: asked.append(want) or inflated(self, want))
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc.gz")) as f:
        got = list(warc.records(f, len(data), "x", lambda h: h["warc-type"] == "request", False))
    assert len(got) == 4 and len(asked) <= 24


VECTORS = "vec_id long, embedding array<float>, label int, vector string, cluster string, near int, c int"


def vector_rows(n=400, seed=1, dims=64):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 7 / 9, 0.2, dims)]) for i in range(n)]
    rows += [(i, rows[0][1]) for i in range(n, n + n // 3)] + [(5, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]
    return rows + [(9001, None), (9002, rows[0][1][:-1]), (9003, [*rows[0][1], 0.0]), (9004, [None, *rows[0][1][1:]]), (9005, [math.nan, *rows[0][1][1:]]), (9006, [math.inf, *rows[0][1][1:]])]


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", "c", 2, 3) for i, v in rows], VECTORS).repartition(5)


def plain_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, _, v in sorted((sha(f"1:{'' if i is None else i}"), v, v) for i, v in kept)[:k]]

    def assign():
        x = np.array([v for _, v in kept], dtype=np.int64)
        d = np.stack([((x - np.array(c)) ** 2).sum(1) for c in centres], axis=1)
        return d.argmin(1).tolist(), d.min(1).tolist()

    for _ in range(rounds):
        own, _ = assign()
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own, d = assign()
    inertia = [sum(x for x, o in zip(d, own, strict=True) if o == c) for c in range(len(centres))]
    return [(i, o, x, inertia[o], sum(d), sha(",".join(map(str, centres[o])))) for (i, _), o, x in zip(kept, own, d, strict=True)]


def test_centroid_clusters(spark):
    rows = vector_rows()
    stats = []
    got = centroids.cluster(vector_frame(spark, rows), stats=stats).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_clusters(rows), key=str)
    assert [s["listed"] for s in stats][:2] == [4, 4] and stats[0]["used"] <= 0
    more = centroids.cluster(vector_frame(spark, rows), k=33, rounds=6).collect()
    assert sorted(map(tuple, more), key=str) == sorted(plain_clusters(rows, 33, 6), key=str)


def test_few_and_no_vectors(spark):
    rows = vector_rows(7)
    assert sorted(map(tuple, centroids.cluster(vector_frame(spark, rows)).collect()), key=str) == sorted(plain_clusters(rows), key=str)
    one = [(7, [0.25] * 64)]
    assert sorted(map(tuple, centroids.cluster(vector_frame(spark, one)).collect())) == plain_clusters(one)
    assert centroids.cluster(vector_frame(spark, [(1, None)])).count() == 0
    with pytest.raises(Exception, match="over 134217728"):
        centroids.cluster(vector_frame(spark, [(1, [1e9] * 64)])).collect()


def test_bounds_certify_what_they_skip():
    """After each move of the centroids the nearest one is that of all distances, with ties, lists cut, large numbers."""
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, d, k = rng.integers(1, 300), rng.integers(1, 8), rng.integers(1, 20)
        x = rng.integers(-rng.integers(2, 60), 60, (n, d)).astype(np.int32) * (1_000_000 if trial % 4 == 0 else 1)
        k = min(k, n)
        c = x[rng.choice(n, k, replace=False)].astype(np.int64)
        b = min(max(1, k // 4), k - 1)
        near, bounds = centroids.scan(x, c, b)
        skipped = 0
        for r in range(6):
            own = ((x[:, None, :].astype(np.int64) - c[None]) ** 2).sum(2).argmin(1)
            assert (own == near[:, 0]).all()
            new = np.array([x[own == i].astype(np.int64).sum(0) // (own == i).sum() if (own == i).any() else c[i] for i in range(k)])
            moved, c = np.sqrt(((new - c) ** 2).sum(1).astype(float)), new
            near, bounds, used = centroids.rescan(x, c, moved, near, bounds, b if r < 3 else max(0, b - 1))
            skipped += int((used == 0).sum())
        assert skipped or n < 20
