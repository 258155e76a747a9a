"""WARC archives with revisits, read back, and a globally ordered capture index (operator 10).

Writing: of the pages with equal payloads of at least ``min_revisit_bytes``, the
one with the largest id is a ``response`` record; the others are ``revisit``
records that name it and carry no payload.  Records are written by Spark's text
writer whose line separator is the record's closing CR LF CR LF, so the files are
plain (gzip) WARC on any store that Spark can write; one file per task.

Reading: every archive is parsed by its Content-Length fields; each payload is
digested again and must match its record.  Each archive gives one run of
captures, sorted by URL key, time and id.

Index: captures are range-partitioned by (URL key, time, id), so that a URL with
very many captures is split as well; in each range the archives' runs are merged
by a loser tree.  Partitions in order give the whole history in order.

Nulls and odd rows: a null html is an empty payload, a null URL an empty one (CR
and LF in URLs are percent-encoded).  A row without an id is written and read
back with a null id and revisits a payload's response if there is one with an id.
Rows that repeat the response's id and payload are all responses.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import work_folder

END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_CAPTURE, CAPTURE_SPAN = "2024-01-01 00:00:00", 31_536_000
_RECORD = "archive string, type string, page_id bigint, urlkey string, url string, ts string, payload_bytes bigint, payload_digest string, refers_to bigint, offset bigint, length bigint"
_FIELDS = [f.split()[0] for f in _RECORD.split(", ")]


def sha1_base32(text: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits give four letters."""
    digest = F.sha1(text)
    groups = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    letters = [F.substring(F.lit(BASE32), F.shiftright(g, shift).bitwiseAND(31) + 1, F.lit(1)) for g in groups for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def capture_time(page_id: Column) -> Column:
    """Where the pages carry no time, their id stands for it, within one year."""
    seconds = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(CAPTURE_SPAN))
    return F.date_format(F.to_timestamp_ntz(F.lit(FIRST_CAPTURE)) + F.make_dt_interval(secs=seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """One row per page: the text of its WARC record without the closing separator."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.replace(F.replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), url.alias("url"), html.alias("html"))
    payload = [F.sha1("html").alias("sha1"), F.xxhash64("html").alias("xx"), F.octet_length("html").alias("bytes")]
    shared = rows.select("id", *payload).filter(F.col("bytes") >= min_revisit_bytes).groupBy("sha1", "xx", "bytes")
    shared = shared.agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1 and keeper is not null").drop("n")
    joined = rows.select("*", *payload).join(shared, ["sha1", "xx", "bytes"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Target-URI", F.col("url")), line("WARC-Date", capture_time(F.col("id"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("html")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("keeper"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string"), F.lit(END),
    )
    return joined.select(F.concat(header, block).alias("value"))


def write_archives(pages: DataFrame, path: str, **options) -> str:
    records(pages, **options).write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query: captures of one site sort together."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def _number(urn: str | None) -> int | None:
    digits = urn.rpartition(":")[2].rstrip(">") if urn else "null"
    return None if digits == "null" else int(digits)


def parse(data: bytes, archive: str) -> Iterator[tuple]:
    """The records of one archive; a payload that does not match its digest is an error."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8").split("\r\n")[1:])
        start, size = stop + 4, int(fields["Content-Length"])
        body = data.index(b"\r\n\r\n", start) + 4
        http = dict(x.split(b": ", 1) for x in data[start : body - 4].split(b"\r\n")[1:])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        length = int(http[b"Content-Length"])
        if fields["WARC-Type"] == "response":
            payload = memoryview(data)[body : start + size]
            digest, told, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), digest, len(payload)
            if digest != told:
                raise ValueError(f"{archive} at {at}: payload does not match its digest")
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"{archive} at {at}: record does not end where its length says")
        url = fields["WARC-Target-URI"]
        ts = dt.datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").strftime("%Y%m%d%H%M%S")
        end = start + size + 4
        yield (archive, fields["WARC-Type"], _number(fields["WARC-Record-ID"]), url_key(url), url, ts, length, digest, _number(fields.get("WARC-Refers-To")), at, end - at)
        at = end


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if "bigint" in f else pa.string() for f in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _FIELDS)


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            data = gzip.decompress(content.as_buffer())
            rows: list[tuple] = []
            for r in parse(data, path.as_py().rpartition("/")[2]):
                rows.append(r)
                if len(rows) == 10_000:
                    yield _as_batch(rows)
                    rows = []
            if rows:
                yield _as_batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(_parse_all, _RECORD)


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, the winner goes on to the root."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.heads = [self._head(i) for i in range(len(runs))]
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._play(1) if len(runs) > 1 else 0

    def _head(self, run: int):
        at = self.at[run]
        return (0, self.key(self.runs[run][at]), run) if at < len(self.runs[run]) else (1, (), run)

    def _play(self, node: int) -> int:
        """Leaves are the nodes from len(runs) on."""
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        first, second = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.losers[node] = second
        return first

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while k and self.heads[self.winner][0] == 0:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self._head(run)
            node = (run + k) // 2
            while node >= 1 and k > 1:
                if self.heads[self.losers[node]] < self.heads[run]:
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def _order(r: tuple) -> tuple:
    """URL key, time, id with null ids first, place in the archives."""
    return r[3], r[5], -1 if r[2] is None else 0, r[2] or 0, r[0], r[9]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    runs: list[list] = []
    last = None
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[0] != last:
                runs.append([])
                last = r[0]
            runs[-1].append(r)
    rows: list[tuple] = []
    for r in LoserTree(runs, _order):
        rows.append(r)
        if len(rows) == 10_000:
            yield _as_batch(rows)
            rows = []
    if rows:
        yield _as_batch(rows)


def merged_index(captures: DataFrame) -> DataFrame:
    """The captures in global order of URL key, time and id, by partition and within each."""
    place = ["urlkey", "ts", "page_id"]
    runs = captures.repartitionByRange(*place, "archive", "offset").sortWithinPartitions("archive", *place, "offset")
    return runs.mapInArrow(_merge, _RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` as archives into the shared folder, reads them back and merges their index."""
    spark = pages.sparkSession
    path = write_archives(pages, work_folder(spark, "warc"), **options)
    return merged_index(read_archives(spark, path))
