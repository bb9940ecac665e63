"""WARC archives of captured pages, and capture histories merged from the sorted index runs of the archives."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values of the format
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = "url_key string, captured_at string, page long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def base32(hex40: Column) -> Column:
    """Base32 of a SHA-1 in hex digits: five hex digits are four letters."""
    groups = [F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(g, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)])


def record_id(page: Column) -> Column:
    """URN of a page's record; the page number can be read back from it."""
    h = F.lpad(F.lower(F.hex(page)), 16, "0")
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8000-8000-"), F.substring(h, 13, 4), F.lit("00000000>"))


def page_of(urn: str) -> int | None:
    p = urn[10:-1].split("-")
    if len(p) != 5:
        return None
    n = int(p[0] + p[1] + p[4][:4], 16)
    return n - (1 << 64) if n >> 63 else n


def write_archives(pages: DataFrame, path: str, page: str = "page", file: str = "file", captured_at: str = "captured_at", content: str = "content", least: int = 0, records: int = 1000) -> None:
    """Write a WARC 1.1 record per captured page asset, in archives of at most ``records`` records.

    ``pages`` has a number, the address of the file, the time of capture and the content as text. Of pages
    whose contents are equal and have at least ``least`` bytes, the one with the largest number is a response
    record and the others are revisit records that refer to it; all others are responses. Archives
    are gzip files that Spark's own writer commits, so a lost task leaves nothing behind.

    Null contents count as empty, null addresses as ``urn:page:`` with the number, blanks in an address are
    escaped. A page without a number is a response. Rows of one number are as many records; other
    columns are not read.
    """
    body = F.coalesce(F.col(content), F.lit(""))
    rows = pages.select(
        F.col(page).cast("bigint").alias("page"), F.coalesce(F.regexp_replace(F.col(file), r"[\x00-\x20]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")))).alias("file"),
        F.coalesce(F.date_format(F.col(captured_at).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")).alias("at"), body.alias("body"),
        F.sha1(F.encode(body, "UTF-8")).alias("sha"), F.octet_length(body).cast("bigint").alias("size"))
    # only digests and numbers are gathered, added up before the shuffle
    same = rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = same.select(F.col("sha").alias("_sha"), F.col("size").alias("_size"), "first")
    rows = rows.join(same, (F.col("size") == F.col("_size")) & (F.col("sha") == F.col("_sha")), "left").withColumn("to", F.when(F.col("page") < F.col("first"), F.col("first")))
    revisit = F.col("to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(record_id(F.col("page")), F.lit("<urn:page:>"))), F.concat(F.lit("WARC-Date: "), F.col("at")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("file")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("to")), F.lit("\r\nWARC-Profile: " + PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    # the line separator of the writer is the end of a record
    rows.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def url_key(address: str) -> str:
    """Sort key of an address: the host from its end, then path and query in lower case, without fragment.

    An address without a host, or one that cannot be taken apart, is its own key in lower case.
    """
    try:
        u = urlsplit(address)
    except ValueError:
        return address.lower()
    if not u.netloc:
        return address.lower()
    host = u.netloc.lower().split("@")[-1].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + ((u.path or "/") + ("?" + u.query if u.query else "")).lower()


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record; blocks are taken by their length, whatever they hold."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield at, headers, data[stop + 4:stop + 4 + size]
        at = stop + 4 + size + 4


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, data in zip(b.column(0).to_pylist(), b.column(1)):
            rows = []
            for at, h, block in parse_archive(zlib.decompress(data.as_py(), 47)):
                http, _, payload = block.partition(b"\r\n\r\n")
                if h["WARC-Type"] == "response":
                    size, digest, to = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None
                else:
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest, to = h["WARC-Payload-Digest"].removeprefix("sha1:"), page_of(h["WARC-Refers-To"])
                rows.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], page_of(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], to, name.rpartition("/")[2], at))
            rows.sort(key=_place)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], names=_NAMES)


_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in CAPTURE.split(", ")]


def _place(row: tuple) -> tuple:
    """Order of captures: address, time, number (none first), archive and offset."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of the archives below ``path``: each archive is read whole and gives one run, sorted by address key and time."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInArrow(_run, CAPTURE)


class LoserTree:
    """k-way merge of sorted lists: the inner nodes keep the losers, so the next row costs one match per level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _first(self, i: int) -> tuple | None:
        return _place(self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._first(a), self._first(b)
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # an empty seat while the tree is built
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs:
            w = self.tree[0]
            if self._first(w) is None:
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._play(w)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            runs.setdefault(row[7], []).append(row)
    out: list[tuple] = []
    for row in LoserTree(list(runs.values())):
        out.append(row)
        if len(out) == 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)


def capture_histories(runs: DataFrame) -> DataFrame:
    """Globally ordered capture histories out of sorted runs (``read_runs``).

    Runs are cut at common bounds of (address key, time, number), so that each task merges one stretch of
    all runs by a loser tree; as the number is part of the bounds, an address with very many captures is cut
    as well. Partitions follow each other in order. Equal captures stay as many rows.
    """
    cut = runs.repartitionByRange("url_key", "captured_at", "page", "archive", "offset")
    return cut.sortWithinPartitions("archive", "url_key", "captured_at", "page", "offset").mapInArrow(_merge, CAPTURE)
