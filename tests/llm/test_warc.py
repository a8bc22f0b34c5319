"""Archives written and read back: every record once, whatever the byte ranges."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from replenish.llm import warc

PAGE = "<p>" + "long enough to be stored once " * 5
ROWS = [
    (5, "http://a/5", PAGE),
    (2, "http://a/2", PAGE),
    (9, None, PAGE),
    (2, "http://a/2", PAGE),
    (None, "http://a/none", PAGE),
    (3, "http://a/3\r\nWARC-Type: revisit", "short"),
    (4, "http://a/4", "short"),
    (6, "", None),
    (7, "http://a/7", ""),
    (8, "http://a/8", "\x1f�\x08 WARC/1.1\r\n\r\nWARC-Type: revisit\r\n" * 30),
    (10, "http://a/ü", "ü\U0001f600" * 30_000),
    (None, None, "x" * 99),
    (None, None, "only without id " * 20),
    (None, None, "only without id " * 20),
]


def want():
    least = {}
    for i, _, t in ROWS:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    out = []
    for i, _, t in ROWS:
        data = (t or "").encode()
        first = least.get(t) if len(data) >= 100 else None
        revisit = first is not None and (i is None or i > first)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*r, "x", 1) for r in ROWS]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first int").repartition(3)


@pytest.fixture(scope="module")
def manifest(pages, tmp_path_factory):
    return warc.write(pages, folder=f"file://{tmp_path_factory.mktemp('warc')}", file_bytes=900).cache()


@pytest.mark.parametrize("size", [7, 100, 1_000, 1 << 20])
def test_round_trip_for_any_ranges(manifest, size):
    got = warc.digest(warc.read(manifest, size)).collect()
    assert sorted((tuple(r) for r in got), key=str) == want()


def test_files_roll_over_and_are_plain_gzip(manifest):
    files = manifest.collect()
    assert len(files) > 3 and sum(f.records for f in files) == len(ROWS)
    content = b"".join(gzip.open(f.file.removeprefix("file://")).read() for f in files)
    assert content.count(b"WARC/1.1\r\nWARC-Type: re") == len(ROWS)
    assert content.count(PAGE.encode()) == 2  # the two rows of the smallest id


def test_urls_and_payloads(manifest):
    got = {r.record_id: r for r in warc.read(manifest).where("record_type = 'response'").collect()}
    assert got["urn:x-page:3"].target_uri == "http://a/3%0D%0AWARC-Type: revisit"
    assert got["urn:x-page:10"].payload.decode() == "ü\U0001f600" * 30_000 and got["urn:x-page:10"].target_uri == "http://a/ü"
    assert got["urn:x-page:6"].payload == b"" and got["urn:x-page:6"].target_uri == ""


def test_damage_and_foreign_members(spark, tmp_path):
    make = lambda i, body: warc.member(f"urn:x-page:{i}", None, "d", len(body), None, body, "2024-01-01T00:00:00Z")
    bodies = [bytes(f"body {i} ", "ascii") * (50 + i) for i in range(40)]
    parts = [make(i, b) for i, b in enumerate(bodies)]
    parts[7] = parts[7][: len(parts[7]) // 2]  # cut short
    parts[20] = parts[20][:-8] + b"\0" * 8  # wrong check sum
    parts.insert(30, gzip.compress(b"no record") + b"junk \x1f\x8b\x08 junk" + gzip.compress(b""))
    parts.append(make(40, b"z" * 500)[:-3])  # ends early
    data = b"".join(parts)
    (tmp_path / "own.warc.gz").write_bytes(data)
    found = warc.listed(spark, str(tmp_path))
    assert found.first().bytes == len(data)
    for size in (13, 400, 1 << 20):
        got = sorted(int(r.record_id.rpartition(":")[2]) for r in warc.read(found, size).collect())
        assert got == [i for i in range(40) if i not in (7, 20)]


def test_a_payload_that_most_pages_share(spark):
    pages = spark.range(3_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.lit(PAGE)).otherwise(F.concat(F.lit(PAGE), F.col("id").cast("string"))).alias("html"))
    got = warc.digest(warc.read(warc.write(pages), 2_000))
    assert got.count() == 3_000 and got.select("page_id").distinct().count() == 3_000
    assert [tuple(r) for r in got.groupBy("refers_to").count().orderBy("refers_to").collect()] == [(None, 1_001), (1, 1_999)]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = warc.write(pages)
    assert manifest.count() == 0 and warc.read(manifest).count() == 0
