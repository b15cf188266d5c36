"""WARC archives with revisit records, and their histories by external index merge.

Writing: equal payloads (by SHA-1 and length) of at least ``min_revisit`` bytes are stored once, in the record of the
smallest page_id; the others refer to it.  Records are built as text in the JVM, become one gzip member each, so that a
record can be read alone from its offset, and are written by Spark's text sink: archives go to any store Spark writes
to, commits are atomic and a lost executor only repeats its files.  An archive holds about ``ARCHIVE`` bytes of payload.

Reading: each archive gives a run of index entries, sorted locally by (url key, time).  The runs are written out,
dealt into ranges of (url key, time, page) of about ``RANGE`` entries however many there are, and merged in each range
by a loser tree over the runs, which gives captures of a url next to each other in time order, globally sorted.  Ranges
hold index entries, never payloads, and cut through the captures of one url where it has very many.

Defined cases: null html is an empty payload; a null url has an empty key; rows that repeat a page_id stay rows of
their own; a null page_id never becomes the one referred to; an empty table gives an archive without records; a page
is a unit that one task handles, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, durable, partitions_for, scratch_path

# fixed values: RFC 4648 base32 and the WARC 1.1 profile of identical payloads
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
EPOCH = 1_704_067_200
#: Bytes of payload in an archive, index entries in a range of the merge, and bytes of a gzip member.
ARCHIVE, RANGE, MEMBER = 64 << 20, 100_000, 8 << 20

INDEX = (
    "url_key string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, url string, run long, archive string, place long, stored long"
)


def base32_of_hex(digits: Column) -> Column:
    """Base32 of 40 hexadecimal digits: every five of them are four letters."""
    fives = [F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    letters = [F.substring(F.lit(BASE32), F.shiftright(x, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for x in fives for j in range(4)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """Host labels from the top, then path and query: ``org,example)/a?b``."""
    host = F.translate(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1), UPPER, UPPER.lower())
    rest = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^#]*)", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, min_revisit: int = 0, captured: str | None = None) -> DataFrame:
    """One WARC record per row of ``pages`` (page_id, url, html).

    ``captured`` names a timestamp column; without one, a page's time is EPOCH plus page_id seconds.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    when = F.col(captured) if captured else F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0)))
    rows = pages.select(
        "page_id",
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "%20").alias("_url"),
        payload.alias("_payload"),
        F.octet_length(payload).cast("long").alias("_bytes"),
        F.sha1(payload).alias("_sha1"),
        F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_date"),
    )
    shared = (
        rows.where(F.col("_bytes") >= min_revisit)
        .groupBy("_sha1", "_bytes")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) & F.col("_first").isNotNull())
        .drop("_n")
    )
    joined = rows.join(shared, ["_sha1", "_bytes"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    block = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("_payload")))
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", identity(F.col("page_id"))),
        _header("WARC-Target-URI", F.col("_url")),
        _header("WARC-Date", F.col("_date")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("_sha1")))),
        _header("WARC-Refers-To", F.when(revisit, identity(F.col("_first")))),
        _header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _header("X-Payload-Length", F.col("_bytes").cast("string")),
        _header("X-URL-Key", F.regexp_replace(url_key(F.col("_url")), r"[\x00-\x20]", "%20")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(head, block, F.lit("\r\n\r\n")).alias("value"))


def _members(data: bytes) -> bytes:
    """``data`` as gzip; a record of more than MEMBER bytes takes several members, each of which ends in a zero byte."""
    out = []
    for at in range(0, len(data) + 1, MEMBER):  # one that is full is never the last
        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
        out.append(packer.compress(data[at : at + MEMBER]) + packer.flush())
    return b"".join(out)


@F.pandas_udf(T.BinaryType())
def _packed(text: pd.Series) -> pd.Series:
    # a member ends with its length, whose last byte is 0 below 16 MB: the sink's line separator puts it back
    return pd.Series([_members(t.encode("utf-8", "surrogatepass"))[:-1] for t in text], dtype=object)


def write_archives(pages: DataFrame, path: str, min_revisit: int = 0, captured: str | None = None, records_each: int = 2000) -> None:
    """Archives of at most ``records_each`` records, fewer where pages are so long that they would pass ARCHIVE bytes on average."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    each = int(max(1, min(records_each, ARCHIVE // max(1, int(mean) + 1000))))
    packed = records(pages, min_revisit, captured).select(_packed("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", each).text(path)


def _page(value: str | None) -> int | None:
    digits = (value or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(place, stored bytes, content) of each record of an archive: one member, or several up to one that isn't full."""
    view, at = memoryview(data), 0
    while at < len(data):
        first, content = at, []
        while True:
            unpacker = zlib.decompressobj(31)
            size = 0
            while not unpacker.eof:
                fed = view[at : at + (1 << 16)]
                if not len(fed):
                    raise ValueError(f"the member at {first} is cut off")
                part = unpacker.decompress(fed)
                at += len(fed) - len(unpacker.unused_data)
                size += len(part)
                content.append(part)
            if size < MEMBER or at >= len(data):
                break
        yield first, at - first, b"".join(content)


def parse_record(record: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """Header and block of one record."""
    stop = record.index(b"\r\n\r\n")
    lines = record[:stop].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"{where}: no record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    end = stop + 4 + int(head["Content-Length"])
    if record[end:] != b"\r\n\r\n":
        raise ValueError(f"{where}: the record doesn't end where it says")
    return head, record[stop + 4 : end]


def parse_archive(data: bytes, archive: str) -> list[tuple]:
    """Index entries of one archive, sorted by (url key, time, page); digests of stored payloads are checked."""
    run, out = zlib.crc32(archive.encode()), []
    for at, stored, record in members(data):
        head, block = parse_record(record, f"{archive} at {at}")
        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
        if head["WARC-Type"] == "response":
            payload = block[len(HTTP_HEAD) :]
            size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if own != digest:
                raise ValueError(f"{archive}: payload at {at} is {own}, not {digest}")
        page, first = _page(head["WARC-Record-ID"]), _page(head.get("WARC-Refers-To"))
        out.append((head["X-URL-Key"], head["WARC-Date"], page, head["WARC-Type"], size, digest, first, head["WARC-Target-URI"], run, archive, at, stored))
    return sorted(out, key=_order)


def record_at(spark: SparkSession, path: str, entry) -> tuple[dict[str, str], bytes]:
    """Header and block of an index entry's record, of whose archive only its own bytes are read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{entry['archive']}")
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(entry["place"])
        data = bytes(stream.readNBytes(entry["stored"]))
    finally:
        stream.close()
    return parse_record(next(members(data))[2], entry["archive"])


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is None, entry[2] or 0, entry[8], entry[10]


_COLUMNS = [x.split()[0] for x in INDEX.split(", ")]


def _frame(entries: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(entries, columns=_COLUMNS, dtype=object)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "run": "int64", "place": "int64", "stored": "int64"})


def _runs(batches):
    for files in batches:
        for path, content in zip(files["path"], files["content"]):
            yield _frame(parse_archive(bytes(content), path.rsplit("/", 1)[-1]))


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so a new head plays one match per level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for k in range(len(runs)):
            self._play(k)

    def _key(self, run: int):
        return (0, _order(self.runs[run][self.at[run]])) if self.at[run] < len(self.runs[run]) else (1, ())

    def _play(self, winner: int) -> None:
        node = (winner + self.size) // 2
        while node > 0:
            rival = self.losers[node]
            if rival < 0:
                self.losers[node] = winner
                return
            if self._key(rival) < self._key(winner):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.runs and self.at[best := self.losers[0]] < len(self.runs[best]):
            yield self.runs[best][self.at[best]]
            self.at[best] += 1
            self._play(best)


def _merge(batches):
    runs: dict[int, list[tuple]] = {}
    for batch in batches:
        for entry in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
            runs.setdefault(entry[8], []).append(entry)
    for entries in runs.values():  # slices of a run come in order; a retried fetch may not
        if any(_order(a) > _order(b) for a, b in zip(entries, entries[1:])):
            entries.sort(key=_order)
    out = []
    for entry in LoserTree(list(runs.values())):
        out.append(entry)
        if len(out) == 10_000:
            yield _frame(out)
            out = []
    if out:
        yield _frame(out)


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """The archives' index entries in global order of (url key, time, page)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = durable(files.mapInPandas(_runs, INDEX), "index-runs")
    ranges = partitions_for(spark, runs.count(), RANGE)
    ranged = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "place")
    return ranged.mapInPandas(_merge, INDEX)


def archive_and_read(pages: DataFrame, min_revisit: int = 0, captured: str | None = None) -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit, captured)
    return read_histories(pages.sparkSession, path)
