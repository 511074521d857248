"""Archives are read back as they were written, and captures come in global order."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from litrewise.llm import warc
from litrewise.placement import shared_folder

SCHEMA = "page_id long, url string, html string, run string, offset long, number long, bytes long"


def page(page_id, url, html):
    """A page with extra columns whose names clash with those of results."""
    return (page_id, url, html, "r", 1, 2, 3)


def odd_pages() -> list[tuple]:
    rng = random.Random(3)
    shared = "<p>copy</p>" * 30
    rows = [
        page(1, "http://a.example.com/x", "one\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ntwo"),
        page(2, None, None),
        page(3, "https://www.Example.com:443?q=1#top", ""),
        page(4, "http://b.example.com/ü\r\nx", "漢字 😀 \x00 \r\n"),
        page(None, None, None),
        page(None, "http://a.example.com/x", "no id"),
        page(None, "http://a.example.com/x", "no id"),
        page(5, "http://a.example.com/x", "twice"),
        page(5, "http://a.example.com/x", "twice"),
        page(6, "http://a.example.com/long", "x" * 3_000_000),
        page(-7, "", "negative"),
    ]
    rows += [page(100 + i, f"http://h{i % 7}.example.org/{i % 3}", shared) for i in range(60)]
    rows += [page(200 + i, "http://hot.example.org/", f"own {rng.random()}") for i in range(90)]
    return rows


def plain_key(url: str | None) -> str:
    rest = (url or "").split("#")[0]
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cut = min([i for i in (rest.find("/"), rest.find("?")) if i >= 0], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    host = host.removesuffix(":80").removesuffix(":443").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (path or "/")


def plain_records(pages: list[tuple]) -> list[tuple]:
    groups: dict[bytes, list] = {}
    for p in pages:
        groups.setdefault((p[2] or "").encode(), []).append(p)
    rows = []
    for payload, members in groups.items():
        members = sorted(members, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or ""))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for p in members[:-1]:
            rows.append((p[0], len(payload), digest, "revisit", members[-1][0]))
        rows.append((members[-1][0], len(payload), digest, "response", None))
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(odd_pages(), SCHEMA).repartition(5).persist()


def text(rows):
    return sorted(map(str, rows))


def test_pages_equal_plain_python(pages):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = warc.archive_pages(pages).select(*columns).collect()
    assert text(tuple(r) for r in found) == text(plain_records(odd_pages()))


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_are_bounded_and_hold_every_byte(spark, pages, compression):
    path = shared_folder(spark)
    warc.write_archives(pages, path, archive_bytes=2000, compression=compression)
    entries = warc.read_archives(spark, path)
    assert entries.count() == pages.count()
    assert entries.select("run").distinct().count() > 5
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    found = set()
    for file in files:
        data = bytes(file.content)
        data = warc.zlib.decompress(data, 31) if compression == "gzip" else data
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        captures = list(warc.parse_archive(bytes(file.content)))
        assert all(data[c["offset"] :].startswith(b"WARC/1.1\r\n") for c in captures)
        assert all(c["offset"] < 2000 for c in captures)
        found |= {c["payload_digest"] for c in captures if c["record_type"] == "response"}
    payloads = {(p[2] or "").encode() for p in odd_pages()}
    assert found == {base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads}


def test_small_payloads_are_all_responses(spark, pages):
    path = shared_folder(spark)
    warc.write_archives(pages, path, least_bytes=100)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == pages.count()
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 100)
    assert sum(r.record_type == "revisit" for r in rows) == 59


def test_damaged_archives_are_told():
    row = {"page_id": 1, "url": None, "captured": 0, "digest": hashlib.sha1(b"abc").hexdigest(), "bytes": 3, "copy": 0, "html": b"abc"}
    whole = warc.warc_record(row) + b"\r\n\r\n"
    assert [c["page_id"] for c in warc.parse_archive(whole)] == [1]
    for damaged in (whole[:-3], whole.replace(b"abc", b"abd"), whole[4:]):
        with pytest.raises(ValueError):
            list(warc.parse_archive(damaged))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 64])
def test_tree_of_losers_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(40),) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(k)]
    merged = [(runs[r][i], r, i) for r, i in warc.merged_order(runs)]
    assert merged == sorted((x, r, i) for r, run in enumerate(runs) for i, x in enumerate(run))


def test_histories_are_in_global_order_over_many_ranges(spark, pages):
    path = shared_folder(spark)
    warc.write_archives(pages, path, archive_bytes=3000)
    entries = warc.read_archives(spark, path)
    runs = warc.settle(entries.sortWithinPartitions("run", *warc.ORDER))
    merged = warc.merge_runs(runs, per_range=20)
    assert merged.select("part").distinct().count() > 5
    by_key: dict[str, list] = {}
    for r in warc.capture_histories(entries, per_range=20).collect():
        by_key.setdefault(r.url_key, []).append(r)
    expected: dict[str, int] = {}
    for p in odd_pages():
        url = None if p[1] is None else p[1].replace("\r", "%0D").replace("\n", "%0A")
        expected[plain_key(url)] = expected.get(plain_key(url), 0) + 1
    assert {k: len(v) for k, v in by_key.items()} == expected
    for rows in by_key.values():
        rows.sort(key=lambda r: r.capture)
        assert [r.capture for r in rows] == list(range(1, len(rows) + 1))
        places = [(r.captured, r.page_id is not None, r.page_id or 0) for r in rows]
        assert places == sorted(places)
    assert max(expected.values()) >= 90


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_are_not_moved(pages):
    plan = warc.records(pages)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "CartesianProduct" not in plan
    assert warc.records(pages).filter(F.col("html").isNull()).count() == 59 + 1 + 1 + 2
