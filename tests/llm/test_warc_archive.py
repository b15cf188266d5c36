import base64
import gzip
import hashlib
import random

import pytest

from tideloom.llm import warc_archive

DDL = "page_id long, url string, html string, place int, _first int"


def test_hard_pages(spark):
    same = "<p>same\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>"
    rows = [(4, "http://B.example/x", same), (2, "http://a.example/", same), (9, None, same), (3, "http://a.example/?q", None), (5, "x\r\ny z", ""), (6, "http://ü.example/", "é" * 100_000), (None, "http://n/", same), (7, "u", "own")]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], DDL)
    out = warc_archive.archive_and_read(df)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(j for j, _, h in rows if j is not None and (h or "") == (html or ""))
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if i == first else ("revisit", first)))
        assert got[i] == want
    keys = [(r["url_key"], r["captured"]) for r in out.collect()]
    assert keys == sorted(keys)


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab", 1, 1), (2, "u", "ab", 1, 1)], DDL)
    assert {r["record_type"] for r in warc_archive.archive_and_read(df, min_revisit=3).collect()} == {"response"}


def test_empty_table(spark):
    assert warc_archive.archive_and_read(spark.createDataFrame([], DDL)).count() == 0


def test_repeated_page_ids_stay_rows_of_their_own(spark):
    rows = [(1, "http://a/", "x"), (1, "http://a/", "x"), (1, "http://a/", "y"), (2, "http://a/", "x"), (2, None, None), (2, None, None)]
    out = warc_archive.archive_and_read(spark.createDataFrame([(*r, 1, 1) for r in rows], DDL))
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in out.collect())
    assert got == [(1, 1, "response", 0)] * 3 + [(2, 0, "response", 0)] * 2 + [(2, 1, "revisit", 1)]


def test_a_record_is_read_alone(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "é" * (i * 700)) for i in range(9)]
    path = str(tmp_path / "archives")
    warc_archive.write_archives(spark.createDataFrame([(*r, 1, 1) for r in rows], DDL), path)
    for entry in warc_archive.read_histories(spark, path).collect():
        head, block = warc_archive.record_at(spark, path, entry)
        assert head["WARC-Target-URI"] == entry["url"] and block[len(warc_archive.HTTP_HEAD) :].decode() == rows[entry["page_id"]][2]


def test_archives_are_bounded(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "x" * 100) for i in range(50)]
    path = str(tmp_path / "archives")
    warc_archive.write_archives(spark.createDataFrame([(*r, 1, 1) for r in rows], DDL).coalesce(1), path, records_each=7)
    found = warc_archive.read_histories(spark, path).groupBy("archive").count().collect()
    assert len(found) >= 8 and max(r["count"] for r in found) <= 7


@pytest.mark.parametrize("size", [0, 5, 63, 64, 65, 128, 200])
def test_members_of_long_records(monkeypatch, size):
    monkeypatch.setattr(warc_archive, "MEMBER", 64)
    rng = random.Random(size)
    records = [bytes(rng.randrange(256) for _ in range(n)) for n in (size, 64, 1, size, 130)]
    packed = b"".join(warc_archive._members(r) for r in records)
    got = list(warc_archive.members(packed))
    assert [r for _, _, r in got] == records and gzip.decompress(packed) == b"".join(records)
    for place, stored, record in got:
        assert gzip.decompress(packed[place : place + stored]) == record and packed[place + stored - 1] == 0
    with pytest.raises(ValueError):
        list(warc_archive.members(packed[:-1]))


def test_loser_tree():
    rng = random.Random(1)
    for k in range(8):
        runs = [sorted([("u%d" % rng.randrange(5), "t%d" % rng.randrange(4), rng.randrange(9), "", 0, "", None, "", r, "", i) for i in range(rng.randrange(6))], key=warc_archive._order) for r in range(k)]
        assert list(warc_archive.LoserTree(runs)) == sorted((e for r in runs for e in r), key=warc_archive._order)
