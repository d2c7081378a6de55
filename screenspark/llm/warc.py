"""WARC archives of captured pages, and their capture histories by an external index merge.

``write_archives`` writes one WARC/1.1 record per page as gzip-compressed archives, by Spark's
own writer: the payload is the page in UTF-8.  Of pages with equal payloads of at least
``min_bytes`` bytes the one with the smallest id is a ``response`` record, the others are ``revisit`` records
that keep the HTTP header but no body and refer to it; smaller payloads are all responses.

``read_archives`` walks every archive by its Content-Length headers and yields the captures of
an archive as one run, locally sorted by URL key and timestamp.  ``capture_history`` cuts the
key space into ranges; in a range, the sorted runs are merged k-way by a loser tree.  Ranges are
ordered by ``history_range`` and their captures by ``history_pos``, so the two give the global
order.  Keys include timestamp and id, so a host with a third of all captures is cut as well.

Defined results: null html is an empty payload; a null url has no target URI and the empty
key; a null id is kept, sorts first, and is the response only where all ids of the payload
are null; rows that repeat the smallest id of a payload are all responses; no pages give no
archives' records and an empty history; extra columns are ignored; equal keys and timestamps are ordered by id; a long page is one
record, held whole by the tasks that write and read it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, HOT_ROWS, materialise, scratch_dir

MIN_BYTES = 0
#: Records of one archive file.
PER_ARCHIVE = 2000
#: Captures of one key range, which one task merges.
RANGE_ROWS = 50_000
EPOCH = 1_704_067_200
_END = "\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload):
    """Base32 (RFC 4648, upper case) of a column's SHA-1: five hex digits are four base32 digits."""
    sha = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(sha, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, path: str | None = None) -> str:
    """Writes the archives of ``page_id, url, html`` and returns their folder."""
    spark = pages.sparkSession
    path = path or scratch_dir(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    # only payloads that occur more than once are looked up, so that pages are not shuffled where such payloads are counted few
    named = rows.select("page_id", "n", "digest").filter(F.col("n") >= min_bytes)
    again = materialise(named.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1"))
    if again.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        rows = rows.join(F.broadcast(again.drop("copies")), "digest", "left")
    else:  # payloads of many pages by broadcast, so that none fills a task; there are at most one per HOT_ROWS pages
        heavy, light = again.filter(F.col("copies") > HOT_ROWS).drop("copies"), again.filter(F.col("copies") <= HOT_ROWS).drop("copies")
        rows = rows.join(F.broadcast(heavy), "digest").unionByName(rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest", "left"))
    # a null first id of a payload that occurs once, or whose ids are all null, names the row itself
    rows = rows.withColumn("first_id", F.coalesce("first_id", "page_id"))
    revisit = (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_END))
    date = F.to_utc_timestamp(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))), F.current_timezone())
    body = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        name,
        F.lit(">\r\nWARC-Date: "),
        F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(f">\r\nWARC-Profile: {_REVISIT}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        body.cast("string"),
        F.lit(_END),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    rows.select(record.alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", PER_ARCHIVE).text(path)
    return path


class _Stream:
    """Reads a gzip-compressed archive piece by piece."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.data, self.step, self.at, self.out, self.offset = data, step, 0, bytearray(), 0
        self.unzip = zlib.decompressobj(31)

    def _more(self) -> bool:
        while self.at < len(self.data):
            if self.unzip.eof:  # the next member
                self.unzip = zlib.decompressobj(31)
            piece = self.data[self.at : self.at + self.step]
            self.at += len(piece)
            self.out += self.unzip.decompress(piece)
            if self.unzip.eof:
                self.at -= len(self.unzip.unused_data)
            if self.out:
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            before = len(self.out)
            if not self._more() or len(self.out) == before and self.at >= len(self.data):
                break
        got = bytes(self.out[:n])
        if len(got) < n:
            raise ValueError("the archive ends inside a record")
        del self.out[:n]
        self.offset += n
        return got

    def head(self) -> bytes | None:
        """The header lines up to the empty line, or None at the end."""
        end, seen = self.out.find(b"\r\n\r\n"), 0
        while end < 0:
            seen = max(0, len(self.out) - 3)
            if not self._more():
                if self.out:
                    raise ValueError("the archive ends inside a header")
                return None
            end = self.out.find(b"\r\n\r\n", seen)
        return self.take(end + 4)


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, headers, block)`` of every record of an archive."""
    stream = _Stream(data)
    while True:
        at = stream.offset
        head = stream.head()
        if head is None:
            return
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:] if line)
        block = stream.take(int(headers["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has no end")
        yield at, headers, block


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; scheme and fragment are dropped."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    query = "?" + parts.query if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + query


_FIELDS = [
    ("page_id", pa.int64(), "long"),
    ("payload_bytes", pa.int64(), "long"),
    ("payload_digest", pa.string(), "string"),
    ("record_type", pa.string(), "string"),
    ("refers_to", pa.int64(), "long"),
    ("url", pa.string(), "string"),
    ("url_key", pa.string(), "string"),
    ("captured_at", pa.string(), "string"),
    ("archive", pa.string(), "string"),
    ("record_offset", pa.int64(), "long"),
]
_PLACE = [("history_range", pa.int32(), "int"), ("history_pos", pa.int64(), "long")]
_INDEX = pa.schema([(n, t) for n, t, _ in _FIELDS])
_HISTORY = pa.schema([(n, t) for n, t, _ in _FIELDS + _PLACE])


def _ddl(fields) -> str:
    return ", ".join(f"{n} {kind}" for n, _, kind in fields)


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def sort_key(row: tuple) -> tuple:
    return row[6], row[7], row[0] is not None, row[0] or 0


def captures(data: bytes, archive: str) -> list[tuple]:
    """The captures of an archive, sorted by URL key, timestamp and page."""
    rows = []
    for at, headers, block in records(data):
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = int(next(line for line in http.decode().split("\r\n") if line.lower().startswith("content-length:")).split(":")[1])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = headers["WARC-Type"]
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if len(payload) != declared or found != digest:
                raise ValueError(f"{archive}: the payload at {at} differs from its header")
        url = headers.get("WARC-Target-URI")
        rows.append((_page(headers["WARC-Record-ID"]), declared, digest, kind, _page(headers.get("WARC-Refers-To")), url, url_key(url), headers["WARC-Date"], archive, at))
    return sorted(rows, key=sort_key)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _index(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            yield _batch(captures(content.as_buffer().to_pybytes(), path.rsplit("/", 1)[-1]), _INDEX)


def read_archives(spark, path: str) -> DataFrame:
    """The capture index: one locally sorted run per archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_index, _ddl(_FIELDS))


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers, so an output costs one leaf-to-root path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.size = max(1, len(runs))
        self.heads = [self._head(i) for i in range(len(runs))]
        self.loser = [-1] * self.size
        for i in range(len(runs)):
            self._play(i)

    def _head(self, i: int):
        run, at = self.runs[i], self.at[i]
        return (0, self.key(run[at]), i) if at < len(run) else (1, (), i)

    def _play(self, winner: int) -> None:
        node = (winner + self.size) >> 1
        while node:
            other = self.loser[node]
            if other < 0 and not getattr(self, "ready", False):  # the first to come here waits
                self.loser[node] = winner
                return
            if other >= 0 and self.heads[other] < self.heads[winner]:
                self.loser[node], winner = winner, other
            node >>= 1
        self.loser[0] = winner
        self.ready = True

    def __iter__(self):
        while self.runs and self.heads[winner := self.loser[0]][0] == 0:
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            self.heads[winner] = self._head(winner)
            self._play(winner)


def _merge(batches):
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n, _, _ in _FIELDS), strict=True):
            runs.setdefault(row[8], []).append(row)
    place, out, n = TaskContext.get().partitionId(), [], 0
    for row in LoserTree(list(runs.values()), sort_key):
        out.append((*row, place, n))
        n += 1
        if len(out) == 10_000:
            yield _batch(out, _HISTORY)
            out = []
    if out:
        yield _batch(out, _HISTORY)


def capture_history(index: DataFrame, ranges: int | None = None) -> DataFrame:
    """Globally ordered captures: ranges of keys, in each the loser-tree merge of the sorted runs."""
    spark = index.sparkSession
    # as many ranges as keep the rows of one, which its merge holds, at about RANGE_ROWS whatever the input
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // RANGE_ROWS))
    dealt = index.repartitionByRange(ranges, "url_key", "captured_at", F.col("page_id").asc_nulls_first())
    # rows of one run arrive together and in order; the sort spills, the merge holds one range
    dealt = dealt.sortWithinPartitions("archive", "url_key", "captured_at", F.col("page_id").asc_nulls_first())
    return dealt.mapInArrow(_merge, _ddl(_FIELDS + _PLACE))


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and returns the capture history."""
    path = write_archives(pages, min_bytes)
    return capture_history(materialise(read_archives(pages.sparkSession, path)))
