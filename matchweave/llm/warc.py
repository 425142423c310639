"""WARC archives of pages, and one index over them by an external merge.

Writing: each page becomes a record whose payload is its html. Of equal payloads (by SHA-1,
length and at least ``min_bytes`` bytes) the one with the smallest page_id is a response and
the others are revisits that refer to it. Records are written by Spark's text writer, whose
line separator is the blank line that ends a WARC record; so archives go to any file system
that Spark reaches.

Only payloads that occur twice are looked up; their list is written before it is joined, so that
Spark broadcasts a small one and splits the partition of a payload that very many pages have.

Reading: each archive is inflated and parsed record by record, so a task holds an archive's
compressed bytes, one record and the entries of its captures; response payloads are digested
again and must match. Its captures, sorted by URL key, timestamp and id, form one run. All runs
are range-partitioned by that key, in ranges of about ``RANGE_ROWS`` captures, and in each range a
loser tree merges its k runs: the ranges in order are the whole capture history in order. A URL
with very many captures is split over ranges by timestamp and id.

Edge cases: null html is an empty payload; a null url is written as an empty one; a row
without page_id is always a response; rows that repeat a page_id and payload are the same kind
of record; an empty table writes no records; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Pages carry no capture time; without one given, page n was captured n seconds after this, n modulo ``SECONDS``.
EPOCH, SECONDS = 1_704_067_200, 1_000_000_000
#: An archive holds so many records at most, fewer where pages are long: about ``ARCHIVE_BYTES`` in all.
RECORDS_PER_ARCHIVE, ARCHIVE_BYTES = 20_000, 1 << 28
#: Captures that one task merges, about.
RANGE_ROWS = 500_000

_CRLF = "\r\n"
#: Ids are digits until the end: a batch with nulls would make them floats.
_ENTRY = "page_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, urlkey string, timestamp string, run string, seq long"
_COLUMNS = [c.split()[0] for c in _ENTRY.split(", ")]


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 160-bit digest given in hex: forty bits are eight letters."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str) -> str:
    """Sortable form of a URL: host parts from the right, then port, path and query."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)(:\d+)?([^#]*)", url.strip(), re.I)
    if not m:
        return url.strip().lower()
    host, port, path = m[1].lower().removeprefix("www."), m[2] or "", m[3] or "/"
    port = "" if port in (":80", ":443") else port
    return f"{','.join(reversed(host.split('.')))}{port}){path.lower()}"


def records(pages: DataFrame, min_bytes: int = 0, captured: Column | None = None) -> DataFrame:
    """(page_id, record): each page's WARC record without the blank line that ends it."""
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
        (captured if captured is not None else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0).cast("long")), F.lit(SECONDS)))).alias("at"),
    ).withColumns({"sha": F.sha1(F.encode("payload", "utf-8")), "size": F.octet_length("payload").cast("long")})
    first = page.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = page.join(cut(first, "payloads"), ["sha", "size"], "left")
    revisit = (F.col("size") >= min_bytes) & (F.col("page_id") > F.col("first"))
    known = known.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("size"), F.lit(_CRLF * 2))
    block = F.concat("http", F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first"), F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}"),
        line("Content-Length", F.octet_length("block")),
    )
    return known.withColumn("http", http).withColumn("block", block).select("page_id", F.concat(head, F.lit(_CRLF), F.col("block")).alias("record"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, captured: Column | None = None) -> None:
    usual = pages.select(F.avg(F.octet_length("html"))).first()[0] or 0
    most = max(1, min(RECORDS_PER_ARCHIVE, int(ARCHIVE_BYTES / (usual + 500))))
    records(pages, min_bytes, captured).select("record").write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of each record of an archive, one after another."""

    def fields(lines: list[bytes]) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in lines)}

    while archive.readline():  # the version
        lines = []
        while (line := archive.readline()) not in (b"\r\n", b""):
            lines.append(line)
        warc = fields(lines)
        head, _, payload = archive.read(int(warc["content-length"])).partition(b"\r\n\r\n")
        yield warc, fields(head.split(b"\r\n")[1:]), payload
        archive.read(4)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below ``path``; each archive's are a sorted run."""

    def page_of(urn: str | None) -> str | None:
        return (urn or "").removeprefix("<urn:page:").removesuffix(">") or None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                found = []
                for warc, http, payload in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)):
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    if warc["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{name}: payload of {warc['warc-record-id']} does not match its digest")
                    stamp = re.sub("[^0-9]", "", warc["warc-date"])
                    found.append((page_of(warc["warc-record-id"]), warc["warc-type"], page_of(warc.get("warc-refers-to")), digest, int(http["content-length"]), url_key(warc["warc-target-uri"]), stamp))
                found.sort(key=lambda x: _order(x[5], x[6], x[0]))
                yield pd.DataFrame([(*x, name, i) for i, x in enumerate(found)], columns=_COLUMNS)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return archives.select("path", "content").mapInPandas(run, _ENTRY)


def _order(urlkey: str, stamp: str, page: str | None) -> tuple[str, str, bool, int]:
    """What captures are sorted by; those without an id go first, as Spark puts nulls."""
    return urlkey, stamp, page is not None, int(page or 0)


class LoserTree:
    """Merges sorted lists: inner nodes remember the loser of their match, the winner is next."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.loser = [-1] * k
        for i in range(k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's next goes before run b's; ended runs go last, ties to the earlier run."""
        x = self.runs[a][self.at[a]] if self.at[a] < len(self.runs[a]) else None
        y = self.runs[b][self.at[b]] if self.at[b] < len(self.runs[b]) else None
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node > 0:
            if self.loser[node] < 0:  # first to arrive waits here
                self.loser[node] = i
                return
            if self._less(self.loser[node], i):
                i, self.loser[node] = self.loser[node], i
            node //= 2
        self.loser[0] = i

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) of every item, in order."""
        if not self.runs:
            return
        while self.at[self.loser[0]] < len(self.runs[self.loser[0]]):
            i = self.loser[0]
            yield i, self.at[i]
            self.at[i] += 1
            node = (i + len(self.runs)) // 2
            while node > 0:
                if self._less(self.loser[node], i):
                    i, self.loser[node] = self.loser[node], i
                node //= 2
            self.loser[0] = i


def merge(captures: DataFrame) -> DataFrame:
    """The runs as one history: partitions in order, and rows in order in each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=_COLUMNS), *batches], ignore_index=True)
        starts = [*rows.index[rows["run"] != rows["run"].shift()], len(rows)]
        keys = [*map(_order, rows["urlkey"], rows["timestamp"], rows["page_id"])]
        order = [starts[k] + i for k, i in LoserTree([keys[a:b] for a, b in zip(starts, starts[1:])])]
        yield rows.iloc[order].astype({"payload_bytes": "int64", "seq": "int64"})

    runs = cut(captures, "runs")
    return runs.repartitionByRange(max(1, -(-runs.count() // RANGE_ROWS)), "urlkey", "timestamp", F.col("page_id").cast("long")).sortWithinPartitions("run", "seq").mapInPandas(run, _ENTRY).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives, reads them back, and returns the merged history."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes)
    return merge(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")
