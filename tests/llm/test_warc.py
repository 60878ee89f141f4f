"""Archives: what is written is read back; revisits; records that look like separators; missing records."""

import hashlib
import io

import pytest
from pyspark.sql import functions as F

from marquee.llm import warc


def plain(rows):
    out = []
    for page, html in rows:
        data = (html or "").encode()
        same = [p for p, h in rows if (h or "").encode() == data and p is not None]
        first = min(same) if same and len(data) >= 100 else page
        repeats = first != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if repeats else "response", first if repeats else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in warc.round_trip(df).collect()), key=str)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert got(pages) == plain([tuple(r) for r in pages.select("page_id", "html").collect()])


def test_awkward_rows(spark):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n\r\nWARC/1.1\r\n" * 5
    long = "é\r\n\r\n" * 60000
    rows = [(5, tricky), (3, tricky), (9, long), (8, long), (None, long), (1, None), (2, ""), (4, "x" * 99), (6, "x" * 99), (7, "y" * 100),
            (11, "y" * 100), (11, "y" * 100), (None, "alone" * 50)]
    df = spark.createDataFrame([(p, None if p == 5 else f"http://h{p}.x/a b?q={p}#f\r\nX: y", h, "extra", 1.5) for p, h in rows],
                               "page_id LONG, url STRING, html STRING, capture STRING, refers_to DOUBLE")
    assert got(df) == plain(rows)


def test_rows_that_repeat_the_smallest_page_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "z" * 200)] * 3 + [(2, "u", "z" * 200)], "page_id LONG, url STRING, html STRING")
    assert sorted(r[3] for r in got(df)) == ["response"] * 3 + ["revisit"]


def test_empty(spark):
    assert got(spark.createDataFrame([], "page_id LONG, url STRING, html STRING")) == []


def test_nested_rows_hold_the_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.b/c?d", "<p>ü</p>" * 40), (2, "http://a.b/e", "<p>ü</p>" * 40)], "page_id LONG, url STRING, html STRING")
    warc.write_warc(df, f"{tmp_path}/w")
    rows = {r.page_id: r for r in warc.captures(warc.read_records(spark, f"{tmp_path}/w")).collect()}
    assert rows[1].response.payload.decode() == "<p>ü</p>" * 40 and rows[2].response.payload is None
    assert rows[2].refers_to == 1 and rows[2].request.target_uri == "http://a.b/e" and rows[1].metadata.kind == "metadata"


def test_foreign_archives(spark, tmp_path):
    def record(kind, block, **headers):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"

    text = (record("warcinfo", "software: x", WARC_Record_ID="<i>") + record("request", "GET /", WARC_Record_ID="<q>", WARC_Concurrent_To="<r>")
            + record("response", "HTTP/1.1 200 OK\r\n\r\nbody", WARC_Record_ID="<r>") + record("response", "HTTP/1.1 200 OK\r\n\r\n", WARC_Record_ID="<s>"))
    (tmp_path / "x.warc").write_text(text, newline="")
    rows = {r.response.record_id: r for r in warc.captures(warc.read_records(spark, str(tmp_path))).collect()}
    assert rows["<r>"].request.record_id == "<q>" and rows["<r>"].metadata is None and rows["<r>"].response.payload == b"body"
    assert rows["<s>"].request is None and rows["<s>"].payload_bytes == 0
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(text[:-20].encode())))


def test_large_pages_are_spread_over_files(spark, tmp_path):
    """Pages of megabytes get files of their own; small ones share files up to their number."""
    import gzip

    rows = [(i, f"http://x/{i}", ("abcdefgh" * 140_000 + str(i)) if i < 4 else "y" * 70_000 + str(i) if i < 14 else f"small {i} " * 20) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").coalesce(1)
    path = str(tmp_path / "warc")
    warc.write_warc(pages, path, files=((0, 10), (1 << 16, 3), (1 << 20, 1)))
    counts = sorted(gzip.open(f).read().count(b"WARC-Type: response") + gzip.open(f).read().count(b"WARC-Type: revisit") for f in (tmp_path / "warc").glob("*.gz"))
    assert counts == [1, 1, 1, 1, 1, 3, 3, 3, 6, 10, 10]
    back = {r.page_id: r.payload_bytes for r in warc.captures(warc.read_records(spark, path)).collect()}
    assert back == {i: len(html) for i, _, html in rows}
