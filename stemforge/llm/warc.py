"""WARC archives as a Python data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans one partition for some files of about `split_bytes` together. Predicates on the record type and
on header columns are pushed down: a task parses a record's headers first, and only for records that pass, and
only if the schema asks for `payload`, is the block decoded. The rest of the record is stepped over by its
length; in compressed archives each record is a gzip member that names its own compressed length in an extra
field, so that it is stepped over without inflating it. Members without that field are inflated to find their
end, and one member may hold several records.

Columns are named headers: `record_type`, `record_id`, `date`, `target_uri`, `content_type`, `payload_digest`
are the standard ones, and any other name is the header with dashes in place of underscores. `file`, `offset`,
`content_length`, `headers` (all of them, names in lower case) and `payload` are told by the record itself.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_ROWS, cut, shared_folder, ship

SCHEMA = "file string, offset long, record_type string, record_id string, date string, target_uri string, content_type string, content_length long, payload_digest string, headers map<string,string>, payload binary"

#: The format's version line, its header names, the media type of a stored response, the gzip subfield of lengths.
VERSION = b"WARC/1.1\r\n"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest"}
HTTP = "application/http;msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTHS = b"sl"

#: Bytes read ahead, longest header block, rows and payload bytes of an Arrow batch.
AHEAD = 1 << 20
MOST_HEAD = 1 << 20
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def header_name(column: str) -> str:
    return HEADERS.get(column, "-".join(w.capitalize() for w in column.split("_")))


class _Window:
    """Bytes of a file by place, read ahead; what is stepped over further than that is never read."""

    def __init__(self, f, size: int):
        self.f, self.size, self.start, self.data = f, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.data):
            self.data, self.start = self.f.read_at(min(max(n, AHEAD), self.size - at), at) if at < self.size else b"", at
        return self.data[at - self.start : at - self.start + n]


class _Plain:
    """Bytes one after the other from a place of the window; skipping moves the place."""

    def __init__(self, window: _Window, at: int):
        self.window, self.at = window, at

    def head(self) -> bytes:
        n = 1 << 12
        while True:
            got = self.window.get(self.at, n)
            end = got.find(b"\r\n\r\n")
            if end >= 0:
                self.at += end + 4
                return got[: end + 4]
            if len(got) < n or n > MOST_HEAD:
                return b""
            n *= 4

    def take(self, n: int) -> bytes:
        got = self.window.get(self.at, n)
        self.at += n
        return got

    def skip(self, n: int) -> None:
        self.at += n

    def done(self) -> bool:
        return self.at >= self.window.size


class _Inflated:
    """The same over gzip members from a place on: all of them, or just one."""

    def __init__(self, window: _Window, at: int, one: bool):
        self.window, self.at, self.one = window, at, one
        self.inflate, self.rest = zlib.decompressobj(31), b""

    def _more(self, want: int) -> bool:
        while True:
            if self.inflate.eof:
                if self.one or self.at >= self.window.size:
                    return False
                self.inflate = zlib.decompressobj(31)
            piece = self.inflate.unconsumed_tail or self.window.get(self.at, 1 << 16)
            if not piece:
                return False
            fresh = not self.inflate.unconsumed_tail
            got = self.inflate.decompress(piece, max(want, 1 << 13))
            if fresh:
                self.at += len(piece)
            self.at -= len(self.inflate.unused_data)
            if got:
                self.rest += got
                return True

    def head(self) -> bytes:
        while (end := self.rest.find(b"\r\n\r\n")) < 0:
            if len(self.rest) > MOST_HEAD or not self._more(1):
                return b""
        got, self.rest = self.rest[: end + 4], self.rest[end + 4 :]
        return got

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            if not self.rest and not self._more(left):
                break
            parts.append(self.rest[:left])
            self.rest = self.rest[left:]
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n:
            if not self.rest and not self._more(1 << 16):
                return
            n, self.rest = n - min(n, len(self.rest)), self.rest[n:]

    def done(self) -> bool:
        return not self.rest and not self._more(1)


def _member_length(window: _Window, at: int) -> int | None:
    """Compressed length of the gzip member at a place, if its extra field names it."""
    head = window.get(at, 12)
    if len(head) < 12 or not head[3] & 4:
        return None
    extra = window.get(at + 12, head[10] | head[11] << 8)
    i = 0
    while i + 4 <= len(extra):
        size = extra[i + 2] | extra[i + 3] << 8
        if extra[i : i + 2] == LENGTHS and size == 8:
            return struct.unpack("<I", extra[i + 4 : i + 8])[0]
        i += 4 + size
    return None


def _parse(head: bytes, file: str, at: int) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at} of {file}")
    out, last = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP headers of a stored response, or the whole block of another record."""
    if not headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block
    end = block.find(b"\r\n\r\n")
    return block[end + 4 :] if end >= 0 else b""


def records(f, size: int, file: str, wanted: Callable[[dict[str, str]], bool], payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(offset, headers, payload or None) of the wanted records of one archive."""
    window = _Window(f, size)
    packed = window.get(0, 2) == b"\x1f\x8b"
    at, stream = 0, None
    while True:
        length = _member_length(window, at) if packed and stream is None else None
        if length is not None:  # a member of one record
            own = _Inflated(window, at, True)
        else:
            own = stream = stream or (_Inflated(window, at, False) if packed else _Plain(window, at))
        if at >= size or own.done():
            return
        here = at if length is not None or not packed else own.at
        here = own.at if not packed else here
        head = own.head()
        if not head:
            raise ValueError(f"a record's headers at {here} of {file} have no end")
        headers = _parse(head, file, here)
        n = int(headers.get("content-length", "0"))
        if wanted(headers):
            block = own.take(n) if payload else None
            if payload and len(block) < n:
                raise ValueError(f"the record at {here} of {file} is cut off")
            yield here, headers, _payload(headers, block) if payload else None
            if not payload and length is None:
                own.skip(n)
        elif length is None:
            own.skip(n)
        if length is None:
            own.take(4)
        else:
            at += length


def _value(column: str, file: str, offset: int, headers: dict[str, str]):
    if column == "file":
        return file
    if column == "offset":
        return offset
    if column == "headers":
        return list(headers.items())
    return headers.get(header_name(column).lower())


def _typed(value, kind: pa.DataType):
    return int(value) if value is not None and pa.types.is_integer(kind) and not isinstance(value, int) else value


@dataclass
class _Test:
    """A pushed predicate on one column."""

    column: str
    holds: Callable[[object], bool]


def _test(f: ds.Filter) -> _Test | None:
    inner, no = (f.child, True) if isinstance(f, ds.Not) else (f, False)
    column = getattr(inner, "attribute", ())
    if len(column) != 1 or column[0] in ("file", "offset", "headers", "payload"):
        return None
    v = getattr(inner, "value", None)
    kinds = {
        ds.EqualTo: lambda x: x == v, ds.GreaterThan: lambda x: x > v, ds.GreaterThanOrEqual: lambda x: x >= v, ds.LessThan: lambda x: x < v,
        ds.LessThanOrEqual: lambda x: x <= v, ds.In: lambda x: x in v, ds.StringStartsWith: lambda x: x.startswith(v), ds.StringEndsWith: lambda x: x.endswith(v),
        ds.StringContains: lambda x: v in x,
    }
    if isinstance(inner, ds.IsNotNull) or isinstance(inner, ds.IsNull):
        null = isinstance(inner, ds.IsNull) != no
        return _Test(column[0], lambda x: (x is None) == null)
    if type(inner) not in kinds or (type(inner) is ds.In and None in v):
        return None
    holds = kinds[type(inner)]
    return _Test(column[0], lambda x: x is not None and holds(x) != no)  # an unknown comparison drops the row, negated or not


@dataclass
class _Files(ds.InputPartition):
    paths: list[tuple[str, int]]


class _Reader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.split = options["path"], int(options.get("split_bytes", 32 << 20))
        self.schema = to_arrow_schema(schema)
        self.tests: list[_Test] = []

    def pushFilters(self, filters):
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self):
        """Files in order of their names, some together up to `split_bytes`; one file is never cut."""
        fs, path = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        hidden = lambda p: any(part[:1] in ("_", ".") for part in p[len(path) :].split("/"))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not hidden(f.path))
        out, size = [], 0
        for f in files:
            if not out or size + f[1] > self.split:
                out.append([])
                size = 0
            out[-1].append(f)
            size += f[1]
        return [_Files(x) for x in out] or [_Files([])]

    def read(self, partition):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        names, kinds = self.schema.names, {f.name: f.type for f in self.schema}
        payload = "payload" in names

        def wanted(headers: dict[str, str]) -> bool:
            return all(t.holds(_typed(_value(t.column, "", 0, headers), kinds.get(t.column, pa.string()))) for t in self.tests)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(self.schema)], schema=self.schema)

        rows, size = [], 0
        for path, length in partition.paths:
            with fs.open_input_file(path) as f:
                for offset, headers, block in records(f, length, path, wanted, payload):
                    rows.append(tuple(block if c == "payload" else _typed(_value(c, path, offset, headers), kinds[c]) for c in names))
                    size += len(block or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


@dataclass
class _Written(ds.WriterCommitMessage):
    paths: list[str]


def _line(value: str) -> str:
    """A header's value: a line break in it would begin another header, so it is written as in a URL."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(row: dict, compress: bool) -> bytes:
    """One record, with its end, as it stands in an archive."""
    headers = {header_name(c): row[c] for c in row if c not in ("file", "offset", "content_length", "headers", "payload") and row[c] is not None}
    headers |= {k: v for k, v in (row.get("headers") or []) if k.lower() not in {h.lower() for h in headers} | {"content-length"}}
    block = row.get("payload") or b""
    if headers.get("Content-Type", "").startswith("application/http"):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(block), block)
    head = "".join(f"{k}: {_line(str(v))}\r\n" for k, v in headers.items()).encode()
    whole = b"%b%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (VERSION, head, len(block), block)
    if not compress:
        return whole
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(whole) + deflate.flush()
    length = 10 + 2 + 12 + len(body) + 8
    if length >> 32 or len(whole) >> 32:  # too long for the field: the member is inflated to find its end
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + struct.pack("<II", zlib.crc32(whole), len(whole) & 0xFFFFFFFF)
    extra = LENGTHS + struct.pack("<HII", 8, length, len(whole))
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(whole), len(whole))


class _Writer(ds.DataSourceArrowWriter):
    """Archives are written below a hidden folder and moved when all tasks have ended; tasks run twice leave nothing."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex
        self.file_bytes, self.compress = int(options.get("file_bytes", 256 << 20)), options.get("compression", "gzip") == "gzip"

    def _hidden(self, path: str) -> str:
        return f"{path}/_temporary-{self.run}"

    def write(self, iterator):
        fs, path = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(self._hidden(path), recursive=True)
        names, out, size = [], None, 0
        info = encode_record({"record_type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid4()}>", "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"}, self.compress)
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.compress else ''}")
                    out, size = fs.open_output_stream(f"{self._hidden(path)}/{names[-1]}", compression=None), 0
                    out.write(info)
                data = encode_record(row, self.compress)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages):
        fs, path = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(path, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File] if self.overwrite else []
        for m in messages:
            for name in m.paths if m is not None else ():
                fs.move(f"{self._hidden(path)}/{name}", f"{path}/{name}")
        for f in old:
            fs.delete_file(f)
        self._drop(fs, path)

    def abort(self, messages):
        fs, path = pafs.FileSystem.from_uri(self.path)
        self._drop(fs, path)

    def _drop(self, fs, path: str) -> None:
        if fs.get_file_info(self._hidden(path)).type == pafs.FileType.Directory:
            fs.delete_dir(self._hidden(path))


class WarcSource(ds.DataSource):
    """Options: path (a file or folder of any store that Arrow opens), split_bytes; for writes file_bytes, compression (gzip or none)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let its filters be pushed down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


def write_warc(rows: DataFrame, path: str, mode: str = "append", **options: str) -> str:
    register(rows.sparkSession)
    rows.write.format("warc").options(**options).mode(mode).save(path)
    return path


def _record_id(item: Column, digest: Column) -> Column:
    """A record's name by item and payload, so that a revisit can name its response without a lookup."""
    h = F.md5(F.concat_ws(" ", item.cast("string"), digest))
    return F.format_string("<urn:uuid:%s-%s-%s-%s-%s>", *[F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def deduplicated(rows: DataFrame, key: str, item: str, long_enough: Column, broadcast_rows: int = BROADCAST_ROWS // 4) -> DataFrame:
    """`rows` with `keep`: the largest item among rows of equal key, where several are long enough; else null.

    Up to `broadcast_rows` groups are broadcast. Beyond, groups of more than a ten-thousandth of all repeated rows
    are fewer than ten thousand and still are, whatever the table's size; those left are small and are
    joined by a shuffle on their keys.
    """
    groups = cut(rows.where(long_enough).groupBy(key).agg(F.max(item).alias("keep"), F.count("*").alias("n")).where("n > 1"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("groups")).first()
    if total["groups"] <= broadcast_rows:
        return rows.join(F.broadcast(groups.select(key, "keep")), key, "left")
    hot = F.col("n") > total["n"] / 10_000
    large = groups.where(hot).select(F.col(key).alias("hot_key"), F.col("keep").alias("hot_keep"))
    rest = groups.where(~hot).select(F.col(key).alias("cold_key"), F.col("keep").alias("cold_keep"))
    marked = rows.join(F.broadcast(large), F.col(key) == F.col("hot_key"), "left")
    # rows without a group left to find go anywhere
    anywhere = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    keyed = marked.withColumn("own_key", F.when(long_enough & F.col("hot_key").isNull(), F.col(key)).otherwise(anywhere))
    joined = keyed.join(rest, F.col("own_key") == F.col("cold_key"), "left")
    return joined.withColumn("keep", F.coalesce("hot_keep", "cold_keep")).drop("hot_key", "hot_keep", "own_key", "cold_key", "cold_keep")


def page_records(pages: DataFrame, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One record a page: a response, or a revisit of the page of the same payload with the largest page_id.

    Payloads of at least `least_bytes` bytes are shared; smaller ones are always stored. A null html is an empty
    payload. Pages without an id revisit like others, and are responses where no page of the payload has one;
    rows that repeat the largest id are responses each. A null url has no header; line breaks in a url are
    written as in URLs. Payloads are told apart by SHA-1 and SHA-256 together.
    """
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page", "url", "payload", F.sha1("payload").alias("sha1")).withColumn("key", F.concat("sha1", F.sha2("payload", 256)))
    found = deduplicated(rows, "key", "page", F.octet_length("payload") >= least_bytes)
    again = F.col("keep").isNotNull() & ~F.col("page").eqNullSafe(F.col("keep"))
    return found.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), _record_id(F.col("page"), F.col("sha1")).alias("record_id"), F.lit(date).alias("date"),
        F.col("url").alias("target_uri"), F.lit(HTTP).alias("content_type"), F.concat(F.lit("sha1:"), "sha1").alias("payload_digest"),
        F.when(again, _record_id(F.col("keep"), F.col("sha1"))).alias("warc_refers_to"), F.when(again, F.lit(PROFILE)).alias("warc_profile"),
        F.col("page").cast("string").alias("x_page_id"), F.when(again, F.col("keep").cast("string")).alias("x_refers_to_page"), F.octet_length("payload").cast("string").alias("x_payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the page records of a folder.

    Length and digest of a response are those of its payload as read back; a digest that differs from the
    record's header is an error. Revisits are read without payloads and carry those of the full payload.
    """
    page = F.col("x_page_id").alias("page_id")
    stored = read_warc(spark, path, "record_type string, x_page_id long, payload_digest string, payload binary").where("record_type = 'response'")
    digest = F.sha1("payload")
    checked = F.when(F.col("payload_digest") == F.concat(F.lit("sha1:"), digest), digest).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("string"))
    responses = stored.select(page, F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, "record_type string, x_page_id long, payload_digest string, x_payload_length long, x_refers_to_page long").where("record_type = 'revisit'")
    return responses.unionByName(again.select(page, F.col("x_payload_length").alias("payload_bytes"), F.substr("payload_digest", F.lit(6)).alias("payload_digest"), "record_type", F.col("x_refers_to_page").alias("refers_to")))


def archive_pages(pages: DataFrame) -> str:
    """Write the pages' records to archives in the shared folder; gives their path."""
    spark = pages.sparkSession
    return write_warc(page_records(pages), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
