import gzip
import hashlib
from pathlib import Path

import pytest

from fieldloom.llm import warc

PAGES = "page_id long, url string, html string, payload string, digest string, shard int"
BIG = "<p>" + "x" * 200


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "c", "c", 9) for i, u, h in rows], PAGES)


ROWS = [
    (5, "http://a/é x\n", BIG), (2, "http://b/", BIG), (9, None, BIG), (2, "http://b/", BIG), (3, "u", "short"), (4, "u", "short"),
    (None, "n", BIG), (None, "n", "é" * 80), (None, "n", "é" * 80), (7, "", None), (8, "e", ""), (10, "l", "long " * 100_000),
]


def files(path):
    return {p.name: p.read_bytes() for p in sorted(Path(path).glob("*.warc.gz"))}


def test_round_trip_of_odd_rows(spark, tmp_path):
    path = f"{tmp_path}/a"
    warc.write_archives(pages(spark, ROWS), path)
    got = warc.read_archives(spark, path, payload=True).collect()
    assert len(got) == len(ROWS) and all(r.verified for r in got)
    want = sorted((repr(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in ROWS)
    assert sorted((repr(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    of = lambda i, kind: [r for r in got if r.page_id == i and r.record_type == kind]
    assert len(of(2, "response")) == 1 and [r.refers_to for r in of(2, "revisit")] == [2]
    assert [r.refers_to for i in (5, 9, None) for r in of(i, "revisit")] == [2, 2, 2]
    assert len(of(None, "response")) == 2  # equal payloads, but no id to refer to
    assert all(of(i, "response") and not of(i, "revisit") for i in (3, 4, 7, 8, 10))
    assert of(5, "revisit")[0].url == "http://a/é%20x%0A" and of(9, "revisit")[0].url is None
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert of(10, "response")[0].payload.decode() == ROWS[-1][2]


def test_files_are_alike_whatever_the_partitions(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 37} " + f"{i * i} " * 40) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        a = warc.write_archives(pages(spark, rows).repartition(7), f"{tmp_path}/a", shard_bytes=20_000, roll_bytes=3_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    warc.write_archives(pages(spark, rows[::-1]), f"{tmp_path}/b", shard_bytes=20_000, roll_bytes=3_000)
    one, two = files(f"{tmp_path}/a"), files(f"{tmp_path}/b")
    assert one == two and len(one) > 10
    manifest = a.collect()
    assert [r.name for r in manifest] == sorted(one) and sum(r.records for r in manifest) == 300
    assert all(len(one[r.name]) == r.bytes and hashlib.sha256(one[r.name]).hexdigest() == r.sha256 for r in manifest)
    assert all(r.bytes <= 3_000 or r.records == 1 for r in manifest)
    ends = [(r.first_id, r.last_id) for r in manifest]
    assert ends == sorted(ends) and all(b[0] > a[1] for a, b in zip(ends, ends[1:]))  # ranges of ids
    assert not Path(f"{tmp_path}/a/_temporary").exists()


def test_files_are_plain_warc(spark, tmp_path):
    warc.write_archives(pages(spark, ROWS[:1]), f"{tmp_path}/a")
    ((name, data),) = files(f"{tmp_path}/a").items()
    text = gzip.decompress(data)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and f"WARC-Filename: {name}".encode() in text
    assert b"\r\nContent-Type: application/http; msgtype=response\r\n" in text
    digest = hashlib.sha256(BIG.encode()).hexdigest().encode()
    assert b"WARC-Payload-Digest: sha256:" + digest in text and text.endswith(BIG.encode() + b"\r\n\r\n")


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/a"
    warc.write_archives(pages(spark, ROWS[:3]), path)
    (Path(path) / "999999-00000.warc.gz").write_bytes(b"left over")
    assert warc.read_archives(spark, path).count() == 3


def test_damage_is_noticed(spark, tmp_path):
    row = warc.page_record(1, 0, "u", b"payload " * 30, None)
    headers, block = warc.parse(gzip.decompress(row))
    assert warc.read_record(headers, block, "f")[0]["verified"]
    assert not warc.read_record(headers, block.replace(b"payload ", b"Payload ", 1), "f")[0]["verified"]
    with pytest.raises(ValueError):
        warc.parse(gzip.decompress(row) + b"x")


def test_empty_table(spark, tmp_path):
    path = f"{tmp_path}/a"
    assert warc.write_archives(pages(spark, []), path).collect() == []
    assert warc.read_archives(spark, path).collect() == []
