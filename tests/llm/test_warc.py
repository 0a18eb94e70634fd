import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import Row

from tests.llm.util import same_as_sql
from terrahac.llm import queries, warc
from terrahac.llm.common import new_path

SF = "/root/testdata/sf0.001"
NAMES = ("a.warc.gz", "b.warc", "a name .gz", "!.gz")


def test_against_sql(spark):
    same_as_sql(queries.op4_warc(spark, SF), queries.OP4_SQL, SF)


def test_round_trip_over_small_ranges(spark):
    rng = random.Random(5)
    rows = [Row(page_id=i, url=f"http://a/{i}\r\nx%", html="".join(chr(rng.randint(32, 0x2FFF)) for _ in range(rng.choice([0, 3, 2000, 30_000]))), file="x") for i in range(40)]
    rows += [Row(page_id=100, url=None, html=None, file="y"), Row(page_id=101, url=None, html="", file="y")]
    rows += [Row(page_id=i, url=None, html="same" * 500, file="y") for i in (7000, 7001, 7001, 7002)]
    pages = spark.createDataFrame(rows)
    path = new_path(spark, "warc-test")
    warc.write(pages, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "20000", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.read(spark, path).collect()
            assert len(got) == len(rows)
            for r in got:
                html = next(x.html or "" for x in rows if x.page_id == r.page_id).encode()
                assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha1(html).hexdigest()
                if r.page_id in (7000, 7001):
                    assert (r.record_type, r.refers_to, r.payload) == ("revisit", 7002, None)
                else:
                    assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, html)
            assert {r.url for r in got if r.page_id < 3} == {f"http://a/{i}\r\nx%" for i in range(3)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_magic_inside_a_member():
    inside = b"WARC/" + warc.MAGIC * 3
    stored = warc.member(inside, 0) + b"\0"  # stored, not deflated: the magic shows
    parts = stored.split(warc.MAGIC)[1:]
    assert len(parts) == 4
    r = warc._Range("f", 0)
    assert [r.add(warc.MAGIC + p) for p in parts] == [None, None, None, inside]
    late = warc._Range("f", 5)
    assert [late.add(warc.MAGIC + p) for p in parts[2:]] == [None, None]
    assert b"".join(f[2] for f in late.fragments()) == b"".join(warc.MAGIC + p for p in parts[2:])


def by_hand(kind, block, more=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n{more}\r\n".encode() + block + b"\r\n\r\n"


def standard(rng, n=60):
    """Members of an archive as crawlers write them, and (type, record id, payload) of its records."""
    body = bytes(rng.randrange(256) for _ in range(3000))
    info = by_hand("warcinfo", b"software: x\r\n", "WARC-Record-ID: <urn:uuid:0>\r\nContent-Type: application/warc-fields\r\n")
    members, want = [info], [("warcinfo", "<urn:uuid:0>", b"software: x\r\n")]
    for i in range(1, n):
        page = body[: rng.randrange(3000)] + warc.MAGIC * (i % 3)
        http = b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\n" + page
        ask = by_hand("request", b"GET / HTTP/1.1\r\n\r\n", f"WARC-Record-ID: <urn:uuid:q{i}>\r\nContent-Type: application/http; msgtype=request\r\n")
        digest = base64.b32encode(hashlib.sha1(page).digest()).decode()
        answer = by_hand("response", http, f"WARC-Record-ID: <urn:uuid:r{i}>\r\nWARC-Target-URI: http://h/{i}\r\nContent-Type: application/http; msgtype=response\r\n" + (f"WARC-Payload-Digest: sha1:{digest}\r\n" if i % 2 else ""))
        meta = by_hand("metadata", b"a: b", "WARC-Record-ID: <urn:uuid:m%d>\r\nWARC-Payload-Digest: sha256:00\r\n" % i)
        members += [ask + answer if i % 5 == 0 else ask] + ([] if i % 5 == 0 else [answer]) + [meta]
        want += [("request", f"<urn:uuid:q{i}>", b""), ("response", f"<urn:uuid:r{i}>", page), ("metadata", f"<urn:uuid:m{i}>", b"a: b")]
    return [gzip.compress(x, rng.choice([0, 1, 6]), mtime=0) for x in members], want


def test_standard_archives(spark, tmp_path):
    rng = random.Random(9)
    members, want = standard(rng)
    for name in NAMES:
        (tmp_path / name).write_bytes(b"".join(members))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "3000", "500"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for name in NAMES:
                found = warc.read(spark, str(tmp_path / name))
                assert (found.rdd.getNumPartitions() > 20) == (size != "128m")  # names in .gz are cut too
                got = found.collect()
                assert sorted((r.record_type, r.record_id, bytes(r.payload)) for r in got) == sorted(want)
                assert all(r.page_id is None and r.payload_bytes == len(r.payload) for r in got)
                assert {r.payload_digest is None for r in got if r.record_type == "metadata"} == {True}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_damaged_archives(spark, tmp_path):
    members, want = standard(random.Random(3), 12)
    broken = members[:]
    broken[4] = broken[4][:40] + b"zzzz" + broken[4][44:]
    broken[9] = broken[9][:-6]
    (tmp_path / "c.warc.gz").write_bytes(b"".join(broken) + members[0][:30])
    with pytest.raises(Exception):
        warc.read(spark, str(tmp_path / "c.warc.gz")).collect()
    got = warc.read(spark, str(tmp_path / "c.warc.gz"), strict=False).collect()
    found = [(r.record_type, r.record_id, bytes(r.payload)) for r in got if r.record_type != "damaged"]
    assert set(found) < set(want) and len(found) >= len(want) - 4 and len(got) > len(found)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
