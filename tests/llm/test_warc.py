"""WARC archives: exact round trips through the index."""

import base64
import hashlib

from waymark.llm.queries import op2_warc
from waymark.llm.warc import lookup, parse_record, response_record, revisit_record, url_key, write_archive

from tests.compare import DATA


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_url_keys():
    assert url_key("http://B.Example.com:80/p?q#f") == "com,example,b:80)/p?q"
    assert url_key("https://example.com") == "com,example)/"
    assert url_key("") == ")/"
    assert " " not in url_key("http://a b/\n c")


def test_records():
    payload = "Zeile\r\n\r\nzwei é".encode()
    fields, body = parse_record(response_record(7, "http://a/\nb", payload, sha(payload), "2024-01-01T00:00:00Z"))
    assert body == payload and fields["warc-type"] == "response" and fields["warc-target-uri"] == "http://a/%0Ab"
    fields, body = parse_record(revisit_record(9, "http://a/", sha(payload), "2024-01-01T00:00:00Z", 7))
    assert fields["warc-type"] == "revisit" and fields["warc-refers-to"].startswith("<urn:uuid:") and body == b""


def plain(rows, least=0):
    first = {}
    for i, _, html in rows:
        first.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        least_id = min(first[p])
        revisit = len(p) >= least and i > least_id
        out.append((i, len(p), sha(p), "revisit" if revisit else "response", least_id if revisit else None))
    return sorted(out)


def digest(found):
    return sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect())


def test_round_trip(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 50}", None if i % 41 == 0 else "x" * (i % 13) if i % 3 else f"<p>page {i} ü</p>" * 50) for i in range(2000)]
    rows += [(5000, None, "<p>no url</p>"), (5001, "not a url", ""), (5002, "http://x/" + "y" * 3000, "z" * 300_000), (5003, "http://x/ \n\x07", "\x00\r\n\r\n"), (5004, "http://x/a\u2028b\x85c {", "<p>separators</p>")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, key string, id int").repartition(5)
    for least in (0, 5):
        archive = write_archive(pages, min_revisit_bytes=least)
        found = lookup(archive, pages).collect()
        assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == plain(rows, least)
        texts = {i: (html or "").encode() for i, _, html in rows}
        assert all(bytes(r["payload"]) == texts[r["page_id"]] for r in found if r["record_type"] == "response")
    some = lookup(archive, spark.createDataFrame([(5, "http://h5.example.com/p5"), (5, "http://other/"), (99999, "http://h5.example.com/p5")], "page_id long, url string"))
    assert [r["page_id"] for r in some.collect()] == [5]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "http://a/", "x"), (3, "http://a/", "x"), (3, "http://a/", "x"), (2, None, None)], "page_id long, url string, html string")
    rows = lookup(write_archive(df), df).collect()
    assert sorted((repr(r["page_id"]), r["record_type"]) for r in rows) == [("2", "response"), ("3", "revisit"), ("3", "revisit"), ("None", "response")]
    assert lookup(write_archive(df.limit(0)), df).count() == 0


def test_captures_of_one_key_are_all_read(spark):
    """Rows alike in id and url but not in payload, and so many without id and url that they fill blocks and shards."""
    rows = [(1, "http://a/", "aa"), (1, "http://a/", "bbb"), (1, "http://a/", "bbb")] + [(None, None, f"payload {k % 1500}") for k in range(2500)] + [(k, f"http://b/{k}", "z") for k in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows make one shard
    try:
        archive = write_archive(df)
        hot = ")/ " + "0" * 20
        assert sum(first <= hot <= last for first, last in zip(archive.firsts, archive.lasts)) > 1
        found = lookup(archive, df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    least = {}
    for i, _, html in rows:
        least[html] = min(least.get(html, 2**63), -1 if i is None else i)
    want = sorted((repr(i), len(html), sha(html.encode()), "revisit" if (-1 if i is None else i) > least[html] else "response") for i, _, html in rows)
    assert sorted((repr(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in found) == want


def test_query(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()]
    assert digest(op2_warc(spark, f"{DATA}/sf0.01")) == plain(rows)
