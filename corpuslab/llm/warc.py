"""WARC archives and their index: records written and read back, identical payloads revisited, and capture runs merged in key order.

``write`` makes one record a page. Of pages with equal payloads (SHA-1) of at least ``min_bytes`` bytes, that with the smallest id is a ``response``, the
others are ``revisit`` records that name it and hold no payload; smaller ones are responses. Files are plain WARC 1.1, written by Spark's text
writer with a record's end as its line end, so they go to any store that Spark can write.

``read`` parses archives by Content-Length, checks each payload against its digest and sorts the index lines of each file: a capture run.
``merge_runs`` deals the runs' lines by ranges of (URL key, timestamp, id, place) and merges the runs' parts in each range with a loser tree, which gives globally
ordered capture histories; ``position`` is a line's place in them. Runs are taken as they arrive; where one is not in order, it is two runs to the merge.

Cases: null html is an empty payload, a null URL an empty target; a null page id comes back as null, and is a revisit where an equal payload has an id. Repeated
rows: all with the smallest id are responses. Ties of URL, time and id are ordered by file and offset. Line ends within URLs are percent-encoded. An empty table gives an empty index.
Extra columns are not read.

Scale: payloads are never shuffled while the digests that several pages share can be broadcast (counted first); beyond that they are joined, and Spark's skew
join splits a digest that a third of all pages share. A file has ``file_bytes`` bytes at most, or one larger record, so no more than that is held to read it. A merge task holds the
index lines of one range (``range_bytes`` bytes on average) as they came, in Arrow's form, and its tree takes each run's lines from there as it needs them; payloads are never held. No two lines
have the same place, so neither a URL with a third of all captures nor repeated rows make a range longer.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, materialise, shared_dir, small

# Names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"

INDEX = "urlkey string, ts string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, offset long, length long"
KEY = ["urlkey", "ts", "page_id", "file", "offset"]


def base32(hex_digest: Column) -> Column:
    """Of 40 hex digits: five of them are four characters."""
    out = []
    for k in range(0, 40, 5):
        v = F.conv(F.substring(hex_digest, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record_id(page_id: Column) -> Column:
    """A UUID of version 8 that holds the id."""
    h = F.lpad(F.hex(page_id), 16, "0")
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(16, 1), F.lit("00-000000000000>"))


def page_of(record: str) -> int:
    """The id in a record's UUID."""
    h = re.sub("[^0-9A-Fa-f]", "", record.partition("uuid:")[2])
    value = int(h[:12] + h[13:16] + h[17:18], 16)
    return value - (1 << 64) if value >> 63 else value


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", ts: Column | None = None, min_bytes: int = 0, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, ts, payload, payload_bytes, payload_digest, record_type, refers_to. ``ts``: capture times; else page ids count seconds from 2024 on."""
    payload = F.coalesce(F.col(html), F.lit(""))
    when = F.coalesce(ts if ts is not None else F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col(page_id).cast("long"), F.lit(1 << 31))), F.lit("2024-01-01").cast("timestamp"))
    base = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32(F.sha1(payload)).alias("payload_digest"),
    )
    shared = base.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "first_id")
    shared = materialise(shared, "digests")
    shared = F.broadcast(shared) if small(shared, max_broadcast) else shared
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= min_bytes)
    return base.join(shared, "payload_digest", "left").select(
        *base.columns, F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def _record(r: DataFrame) -> Column:
    """A record as text, without its end."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(record_id(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), F.col("payload_digest"), F.lit(">")))),
        F.concat(F.lit("WARC-Date: "), F.col("ts")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *head), F.lit(END), block)


def write(recs: DataFrame, path: str, file_bytes: int = 32 << 20) -> None:
    """Archives of at most ``file_bytes`` bytes, or of one larger record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if held and size + n > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(held)])], ["value"])
                    held, size = [], 0
                held.append(record.as_py())
                size += n + len(END)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)])], ["value"])

    with bounded_batches(recs.sparkSession):
        records = recs.select(_record(recs).alias("record")).select("record", F.octet_length("record").alias("n"))
        records.mapInArrow(run, "value string").write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def url_key(url: str) -> str:
    """Host labels from the last to the first, then the rest, for sorting."""
    low = url.lower()
    try:
        s = urlsplit(low)
        return ",".join(reversed((s.hostname or "").split("."))) + (f":{s.port}" if s.port else "") + ")" + s.path + (f"?{s.query}" if s.query else "")
    except ValueError:
        return low


def parse(name: str, data: bytes) -> list[tuple]:
    """Index lines of an archive; an error where it is damaged."""
    out, at = [], 0
    while at < len(data):
        if not data.startswith(VERSION.encode(), at):
            raise ValueError(f"{name}: no record at {at}")
        stop = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[at:stop].decode().split("\r\n")[1:])
        start = stop + 4
        end = start + int(head["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"{name}: the record at {at} does not end at {end}")
        body = data.index(b"\r\n\r\n", start, end) + 4
        size = int(re.search(rb"\r\nContent-Length: (\d+)", data[start:body])[1])
        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
        if kind == "response" and (end - body != size or base64.b32encode(hashlib.sha1(data[body:end]).digest()).decode() != digest):
            raise ValueError(f"{name}: the payload at {body} does not match its digest")
        own, url = head["WARC-Record-ID"], head["WARC-Target-URI"]
        page = page_of(own) if "uuid:" in own else None
        refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
        out.append((url_key(url), head["WARC-Date"], page, url, kind, digest, size, refers, name, at, end + 4 - at))
        at = end + 4
    return out


def _order(line) -> tuple:
    return line[0], line[1], (line[2] is not None, line[2] or 0), line[8], line[9]


NAMES = [c.split()[0] for c in INDEX.split(", ")]
KINDS = [pa.int64() if c.endswith(" long") else pa.string() for c in INDEX.split(", ")]


def _batch(lines: list[tuple], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in lines], kind) for i, kind in enumerate(KINDS)], *more.values()], [*NAMES, *more])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archives' index lines, one sorted run a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                yield _batch(sorted(parse(name.as_py(), data.as_py()), key=_order))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, INDEX)


class LoserTree:
    """Merges k sorted iterators with one comparison a level for each item.

    Node 0 holds the winner, the inner nodes 1 to k-1 the losers of their matches, as numbers of iterators.
    """

    def __init__(self, runs: list, key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(self.k):
            self._pull(i)
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i, first=True)

    def _pull(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else (self.key(self.heads[i]), i)

    def _beats(self, a: int, b: int) -> bool:
        """An exhausted run loses to every other."""
        return self.keys[b] is None or (self.keys[a] is not None and self.keys[a] < self.keys[b])

    def _play(self, i: int, first: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            if self.tree[node] == -1 and first:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self._pull(w)
            self._play(w)


def rows_of(table: pa.Table, start: int, stop: int, step: int = 64) -> Iterator[tuple]:
    for at in range(start, stop, step):
        yield from zip(*[c.to_pylist() for c in table.slice(at, min(step, stop - at)).columns], strict=True)


def natural_runs(table: pa.Table, key) -> list[Iterator[tuple]]:
    """The ascending runs of a table, each an iterator over its rows: cut where the order falls."""
    cuts, last = [], None
    for i, x in enumerate(rows_of(table, 0, table.num_rows, 4096)):
        k = key(x)
        if last is None or k < last:
            cuts.append(i)
        last = k
    return [rows_of(table, i, j) for i, j in zip(cuts, [*cuts[1:], table.num_rows], strict=True)]


def merge_runs(index: DataFrame, range_bytes: int = 32 << 20) -> DataFrame:
    """Index lines in global order, partition by partition and within each, with their ``position`` from 0. A range has some ``range_bytes`` bytes of lines."""
    size = index.agg(F.sum(F.lit(300) + 2 * F.coalesce(F.octet_length("url"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-size // range_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        runs = natural_runs(pa.Table.from_batches(held), _order) if held else []
        merged, done = iter(LoserTree(runs, _order)), 0
        while chunk := list(islice(merged, 10_000)):
            at = pa.array(range(done, done + len(chunk)), pa.int64())
            yield _batch(chunk, range=pa.array([place] * len(chunk), pa.int32()), at=at)
            done += len(chunk)

    merged = materialise(index.select(*NAMES).repartitionByRange(n, *KEY).mapInArrow(run, f"{INDEX}, range int, at long"), "merged")
    sizes = merged.groupBy("range").agg(F.count("*").alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("range", before.alias("before"))
    return merged.join(F.broadcast(sizes) if n <= BROADCAST_ROWS else sizes, "range").select(*NAMES, (F.col("before") + F.col("at")).alias("position"))


def archive(pages: DataFrame, path: str | None = None, file_bytes: int = 32 << 20, **options) -> DataFrame:
    """Writes the pages' records to ``path`` (default: a new shared folder), reads them back and returns the merged index."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write(records(pages, **options), path, file_bytes)
    with bounded_batches(spark, rows=4, size=64 << 20):
        runs = materialise(read(spark, path), "capture-runs")
    return merge_runs(runs)
