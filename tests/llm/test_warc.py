import hashlib

from otgraph.llm import warc as W

BIG = "<p>" + "x" * 1200 + "é</p>"
FAKE = W.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"


def test_round_trip_rejects_magic_in_payloads(spark, clash, monkeypatch):
    monkeypatch.setattr(W, "RECORDS_PER_FILE", 9)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")       # several byte ranges per archive
    rows = [(i, f"http://h/{i}", f"<html>{i}" + "y" * (i * 37 % 900)) for i in range(20)]
    rows += [(100 + i, "u", BIG) for i in range(5)]
    rows += [(200, "m", FAKE), (201, "m2", "pre" + FAKE * 3 + W.MAGIC + "zz" * 2000), (202, None, None), (203, "", ""), (None, "n", "null id"),
             (204, "x\r\ny", W.MAGIC), (205, "e", "a\r\n\r\n\r\n\r\n"), (300, "c", "z" * 999), (301, "c", "z" * 999), (302, "c", "z" * 1000), (303, "c", "z" * 1000)]
    try:
        got = W.round_trip(clash(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    lead = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            lead[h] = max(lead.get(h, -1), i)
    want = []
    for i, _, h in rows:
        b, to = (h or "").encode(), lead.get(h)
        to = None if to == i else to
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
