"""Archives: round trips, false members, damage."""

import base64
import gzip
import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from profloom.llm.common import scratch
from profloom.llm.op13_warc import key_of, member, read_warc, record_head, record_starts, warc_files, write_warc


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def folder(spark):
    return f"{scratch(spark)}/{uuid.uuid4().hex}"


@pytest.mark.parametrize("range_bytes", [1 << 20, 61])
@pytest.mark.parametrize("archive_bytes", [1 << 30, 2000])
def test_round_trip(spark, make, range_bytes, archive_bytes):
    rows = [(i, f"http://a/{i} x\n", make.text(make.r.randrange(60)) + "é") for i in range(40)]
    rows += [(100 + i, None, "same") for i in range(9)] + [(200, "u", None), (201, "u", ""), (None, "n", "same"), (7, "again", rows[7][2]), (300, "z", "WARC/1.1\r\n\r\n" * 50)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, digest string, row int").repartition(4)
    found = read_warc(write_warc(df, "page_id", "url", "html", folder(spark), archive_bytes=archive_bytes), range_bytes).collect()
    assert not [r for r in found if r.error]
    groups = {}
    for i, u, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    name = lambda r: int(r.rpartition(":")[2]) if r.rpartition(":")[2] else None
    for body, ids in groups.items():
        mine = [r for r in found if r.payload_digest == sha(body)]
        top = max((i for i in ids if i is not None), default=None)
        assert sorted((name(r.record_id) is not None, name(r.record_id) or 0) for r in mine) == sorted((i is not None, i or 0) for i in ids)
        assert all(r.payload_bytes == len(body) for r in mine)
        (first,) = [r for r in mine if r.record_type == "response"]
        assert name(first.record_id) == top and first.payload == body and first.refers_to is None
        assert all(r.refers_to == first.record_id and r.payload is None for r in mine if r is not first)
    assert {r.target_uri for r in found} >= {"http://a/3%20x%0A", None}


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    found = read_warc(write_warc(df, "page_id", "url", "html", folder(spark), least_bytes=4))
    assert sorted((r.k, r.record_type) for r in found.select(key_of(F.col("record_id")).alias("k"), "record_type").collect()) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]
    assert read_warc(write_warc(df.where("false"), "page_id", "url", "html", folder(spark))).collect() == []


def record(n, payload):
    return member(record_head("response", f"urn:r:{n}", "u", "d", sha(payload), len(payload)), payload)


@pytest.mark.parametrize("range_bytes", [1 << 20, 700, 97])
def test_false_members_inside_payloads(spark, tmp_path, range_bytes):
    r = random.Random(5)
    payloads = []
    for n in range(12):
        noise = r.randbytes(300)  # does not compress, so members inside stand as they are
        payloads.append(noise + record(1000 + n, b"inner" * 3) + b"\x1f\x8b\x08\x00" + noise)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(record(n, p) for n, p in enumerate(payloads)))
    files = warc_files(spark, str(tmp_path))
    found = read_warc(files, range_bytes).collect()
    assert sorted((r.record_id, r.payload) for r in found) == sorted((f"urn:r:{n}", p) for n, p in enumerate(payloads))
    ranges = sorted((r.lo, r.hi) for r in record_starts(files, range_bytes).collect())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_output_pending_at_the_end_of_a_file(spark, tmp_path):
    """Records of all sizes around the pieces that are inflated at once, each the last of its archive."""
    sizes = [*range(3200, 3900), *range(15900, 16200), *range(32400, 32600)]
    for n in sizes:
        (tmp_path / f"{n}.warc.gz").write_bytes(record(n, b"a" * n))
    found = read_warc(warc_files(spark, str(tmp_path)).repartition(4)).collect()
    assert sorted((r.record_id, r.payload_bytes, r.error) for r in found) == sorted((f"urn:r:{n}", n, None) for n in sizes)


@pytest.mark.parametrize("range_bytes", [1 << 20, 150])
def test_damage_costs_one_record(spark, tmp_path, range_bytes):
    parts = [bytearray(record(n, bytes([n]) * 500 + random.Random(n).randbytes(200))) for n in range(6)]
    parts[2][-40] ^= 255
    (tmp_path / "b.warc.gz").write_bytes(b"".join(parts)[:-30])
    found = read_warc(warc_files(spark, str(tmp_path)), range_bytes).collect()
    assert sorted(r.record_id for r in found if not r.error) == [f"urn:r:{n}" for n in (0, 1, 3, 4)]
    assert sorted(r.offset for r in found if r.error) == [sum(map(len, parts[:2])), sum(map(len, parts[:5]))]


def test_several_records_in_a_member_and_other_headers(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(info + info.replace(b"urn:i", b"urn:j")) + record(1, b"x"))
    found = {r.record_id: (r.record_type, r.payload_bytes, r.payload_digest) for r in read_warc(warc_files(spark, str(tmp_path)), 50).collect()}
    assert found == {"urn:i": ("warcinfo", 5, sha(b"hello")), "urn:j": ("warcinfo", 5, sha(b"hello")), "urn:r:1": ("response", 1, sha(b"x"))}
