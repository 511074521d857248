"""Web pages as WARC archives, and the archives' captures in global order.

Writing: of records with equal payloads the one of the largest page id is a response, which
holds the payload; the others revisit it and hold headers only. Payloads meet by digest with one
row left for each digest and task before they are shuffled, so that copies are not moved.
An archive is a gzipped WARC 1.1 file of bounded size, written by Spark's text writer, whose
line separator is the blank lines that end a record; a payload may hold any bytes, as readers go
by Content-Length.

Reading back: archives are read as whole files of bounded size, one record after the other, and
payload digests are computed again and compared. The captures of an archive, sorted by URL key
and time, are a run, written to the shared folder. Key ranges of about ENTRIES_PER_RANGE captures
each merge their slices of all runs by a loser tree. A range is cut by key, time, id and
place, so that captures of one URL spread over many ranges; the number of a capture in its URL's
history is then the number in its range and that of the ranges before, which takes one row a range.

Rows: a null html is an empty payload; a null url has no target and the key ")/"; a null id is
smaller than all ids and captured at EPOCH; of repeated rows one is the response if their id is
the largest of their payload, and the others revisit it. No pages give no archives and no captures.
Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litrewise.placement import fits_broadcast, settle, shared_folder

ARCHIVE_BYTES = 32 * 1024 * 1024
BATCH_ROWS = 2000
ENTRIES_PER_RANGE = 100_000
# Captures of pages without a time of their own: seconds from here on, by page id.
EPOCH = 1_600_000_000
ID_SECONDS = 100_000_000
RECORD_END = "\r\n\r\n"

ENTRY = (
    "run string, offset long, record_type string, page_id long, url string, captured long, "
    "payload_bytes long, payload_digest string, refers_to long"
)
ORDER = ["url_key", "captured", "page_id", "payload_digest", "record_type", "run", "offset"]


def url_key(url: Column) -> Column:
    """The sort-friendly form of a URL: host labels from the last to the first, then the path.
    Scheme, "www.", default ports, fragment and the host's case are left out."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    rest = F.regexp_replace(rest, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^/?]*)", 1)
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    plain = F.regexp_replace(F.regexp_replace(F.lower(host), r":(80|443)$", ""), r"^www\.", "")
    labels = F.array_join(F.reverse(F.split(plain, r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.when(path == "", "/").otherwise(path))


def time_of_page(page_id: Column) -> Column:
    return F.lit(EPOCH) + F.coalesce(F.pmod(page_id, F.lit(ID_SECONDS)), F.lit(0))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per WARC record: page_id, url, captured, digest (SHA-1 in hex), bytes, copy, html
    (null for revisits) and of revisits first_id, first_url and first_captured of the response.

    Payloads of fewer than `least_bytes` bytes are all responses.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        time_of_page(F.col("page_id")).cast("long").alias("captured"),
        F.sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"),
        html.alias("html"),
    )
    place = ["page_id", "url", "captured"]
    first = [F.lit(None).cast(t).alias(f"first_{c}") for c, t in zip(("id", "url", "captured"), ("long", "string", "long"))]
    shared = rows.filter(F.col("bytes") >= least_bytes)
    largest = shared.groupBy("digest", "bytes").agg(F.max(F.struct(*place, "html")).alias("w"))
    responses = largest.select("w.page_id", "w.url", "w.captured", "digest", "bytes", F.lit(0).alias("copy"), "w.html", *first)
    # The same choice on narrow rows, for the revisits.
    copies = shared.groupBy(*place, "digest", "bytes").agg(F.count(F.lit(1)).cast("int").alias("n"))
    chosen = copies.groupBy("digest").agg(F.max(F.struct(*place)).alias("w"))
    same = [F.col(c).eqNullSafe(F.col(f"w.{c}")) for c in place]
    revisits = (
        copies.join(chosen, "digest")
        .withColumn("from", F.when(same[0] & same[1] & same[2], 1).otherwise(0))
        .filter("n > from")
        .withColumn("copy", F.explode(F.sequence(F.col("from"), F.col("n") - 1)))
        .select(
            *place, "digest", "bytes", "copy", F.lit(None).cast("string").alias("html"),
            F.col("w.page_id").alias("first_id"), F.col("w.url").alias("first_url"), F.col("w.captured").alias("first_captured"),
        )
    )
    found = responses.unionByName(revisits)
    if least_bytes > 0:
        small = rows.filter(F.col("bytes") < least_bytes)
        found = found.unionByName(small.select(*place, "digest", "bytes", F.lit(0).alias("copy"), "html", *first))
    return found


def _moment(seconds: int) -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(seconds))


def _seconds(moment: str) -> int:
    import calendar

    return calendar.timegm(time.strptime(moment, "%Y-%m-%dT%H:%M:%SZ"))


def _record_id(kind: str, page_id: int | None, digest: str, copy: int) -> str:
    name = f"{kind}/{page_id}/{digest}/{copy}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name.encode()).digest())}>"


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def _headers(lines: Sequence[tuple[str, object]]) -> bytes:
    text = "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None)
    return f"WARC/1.1\r\n{text}\r\n".encode("utf-8", "surrogatepass")


def _warcinfo(number: int) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    lines = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", _record_id("warcinfo", number, "", 0)),
        ("WARC-Date", _moment(EPOCH)),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", len(block)),
    ]
    return _headers(lines) + block


def warc_record(row: dict) -> bytes:
    """One record, without the blank lines that end it."""
    revisit = row["html"] is None
    payload = b"" if revisit else row["html"]
    kind = "revisit" if revisit else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(kind, row["page_id"], row["digest"], row["copy"])),
        ("WARC-Date", _moment(row["captured"])),
        ("WARC-Target-URI", None if row["url"] is None else _one_line(row["url"])),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()),
        ("X-Page-Id", row["page_id"]),
    ]
    if revisit:
        lines += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id("response", row["first_id"], row["digest"], 0)),
            ("WARC-Refers-To-Target-URI", None if row["first_url"] is None else _one_line(row["first_url"])),
            ("WARC-Refers-To-Date", _moment(row["first_captured"])),
            ("X-Refers-To-Page-Id", row["first_id"]),
        ]
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + len(payload))]
    return _headers(lines) + http + payload


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    compression: str = "gzip",
) -> None:
    """Write all pages to archives of about `archive_bytes` (before compression) below `path`."""
    rows = records(pages, least_bytes)
    rows = rows.withColumn("html", F.col("html").cast("binary"))

    def built(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled = 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                numbers, made = [], []
                for row in batch.slice(start, BATCH_ROWS).to_pylist():
                    for record in ([_warcinfo(number)] if filled == 0 else []) + [warc_record(row)]:
                        numbers.append(number)
                        made.append(record)
                        filled += len(record) + len(RECORD_END)
                    if filled >= archive_bytes:
                        number, filled = number + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(made, pa.binary())], names=["archive", "record"])

    # The cast keeps the bytes as they are, and so does the writer.
    made = rows.mapInArrow(built, "archive long, record binary").select("archive", F.col("record").cast("string"))
    made.write.partitionBy("archive").option("lineSep", RECORD_END).option("compression", compression).text(path)


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode("utf-8", "surrogateescape").split("\r\n")
    return first, {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def parse_archive(content: bytes) -> Iterator[dict]:
    """The captures of one archive in order; raises ValueError where it is damaged."""
    data = zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        version, head = _fields(data[at:end])
        if end < 0 or version != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        block, upto = end + 4, end + 4 + int(head["content-length"])
        if data[upto : upto + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has another length")
        if head["warc-type"] in ("response", "revisit"):
            body = data.index(b"\r\n\r\n", block, upto) + 4
            _, http = _fields(data[block : body - 4])
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            if head["warc-type"] == "response":
                payload = data[body:upto]
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(http["content-length"]):
                    raise ValueError(f"the payload at {at} is not the one that was written")
            page, first = head.get("x-page-id"), head.get("x-refers-to-page-id")
            yield {
                "offset": at,
                "record_type": head["warc-type"],
                "page_id": None if page is None else int(page),
                "url": head.get("warc-target-uri"),
                "captured": _seconds(head["warc-date"]),
                "payload_bytes": int(http["content-length"]),
                "payload_digest": digest,
                "refers_to": None if first is None else int(first),
            }
        at = upto + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per capture in the archives below `path` (run: the archive's name), in the order
    of the archives: the columns of ENTRY and url_key."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("run", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()),
                ("url", pa.string()), ("captured", pa.int64()), ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()), ("refers_to", pa.int64()),
            ]
        )
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = [{"run": name, **capture} for capture in parse_archive(content.as_py())]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return files.mapInArrow(parsed, ENTRY).withColumn("url_key", url_key(F.col("url")))


def merged_order(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, place) of all items of sorted `runs` in common order, by a tree of losers: each
    inner node keeps the loser of the match between the winners below it, so that an item's
    successor meets one opponent a level."""
    k = len(runs)
    places = [0] * k
    heads: list[tuple | None] = [run[0] if run else None for run in runs]

    def beats(x: int, y: int) -> bool:
        if heads[x] is None or heads[y] is None:
            return heads[y] is None and (heads[x] is not None or x < y)
        return (heads[x], x) < (heads[y], y)

    # Leaves are k .. 2k-1, the node above i is i // 2; node 0 keeps the winner of all.
    winners = [0] * k + list(range(k))
    losers = [0] * max(k, 1)
    for node in range(k - 1, 0, -1):
        left, right = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (left, right) if beats(left, right) else (right, left)
    winner = winners[1] if k > 1 else 0
    while k and heads[winner] is not None:
        yield winner, places[winner]
        places[winner] += 1
        run = runs[winner]
        heads[winner] = run[places[winner]] if places[winner] < len(run) else None
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def _sorted_runs(keys: list[tuple]) -> tuple[list[list[tuple]], list[int]]:
    """Maximal sorted stretches of `keys`, and where each begins."""
    starts = [i for i in range(len(keys)) if i == 0 or keys[i] < keys[i - 1]]
    return [keys[s:e] for s, e in zip(starts, [*starts[1:], len(keys)])], starts


def _merged_range(table: pa.Table) -> pa.Table:
    """The rows of one key range, whose runs arrive one after the other, in global order, with
    the number of each among the range's captures of its URL."""

    def sortable(name: str) -> list:
        values = table.column(name).to_pylist()
        if name in ("url_key", "payload_digest", "record_type", "run"):
            return [(v is not None, (v or "").encode("utf-8", "surrogatepass")) for v in values]
        return [(v is not None, v or 0) for v in values]

    keys = list(zip(*[sortable(c) for c in ORDER]))
    runs, starts = _sorted_runs(keys)
    order = np.array([starts[r] + place for r, place in merged_order(runs)], dtype=np.int64)
    numbers, last, n = [], None, 0
    for i in order:
        n = n + 1 if keys[i][0] == last else 1
        last = keys[i][0]
        numbers.append(n)
    return table.take(pa.array(order)).append_column("number", pa.array(numbers, pa.int64()))


def merge_runs(entries: DataFrame, per_range: int = ENTRIES_PER_RANGE) -> DataFrame:
    """The captures of sorted runs in global order: their columns, `part` and `number`. Parts
    follow each other in the order of ORDER, and so do the rows of each part's file; `number`
    counts the captures of a URL within a part."""
    parts = -(-entries.count() // per_range) or 1
    ranged = entries.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id())

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [b for b in batches if b.num_rows]
        if waiting:
            yield from _merged_range(pa.Table.from_batches(waiting)).to_batches()

    return settle(ranged.mapInArrow(merge, f"{_ddl(ranged)}, number long"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def capture_histories(entries: DataFrame, per_range: int = ENTRIES_PER_RANGE) -> DataFrame:
    """All captures with `capture`, the number of each in the history of its URL key."""
    runs = settle(entries.sortWithinPartitions("run", *ORDER))
    merged = merge_runs(runs, per_range)
    last = F.max(F.struct("url_key", "number"))
    edges = merged.groupBy("part").agg(F.min("url_key").alias("first"), last.alias("last"))
    events = F.array(
        F.struct(F.col("first").alias("url_key"), (F.col("part") * 2).alias("at"), F.lit(0).cast("long").alias("n")),
        F.struct(F.col("last.url_key").alias("url_key"), (F.col("part") * 2 + 1).alias("at"), F.col("last.number").alias("n")),
    )
    # Before a part, its first URL has the captures that earlier parts end with.
    before = F.sum("n").over(Window.partitionBy("url_key").orderBy("at"))
    counted = edges.select(F.explode(events).alias("e")).select("e.*").withColumn("before", before)
    counted = settle(counted.filter("at % 2 = 0 and before > 0").select("url_key", (F.col("at") / 2).cast("int").alias("part"), "before"))
    small = F.broadcast(counted) if fits_broadcast(counted) else counted
    capture = F.col("number") + F.coalesce("before", F.lit(0))
    return merged.join(small, ["url_key", "part"], "left").withColumn("capture", capture).drop("before", "number", "part")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and return each capture with its place in the
    history of its URL."""
    spark = pages.sparkSession
    path = shared_folder(spark)
    write_archives(pages, path)
    found = capture_histories(read_archives(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture")
