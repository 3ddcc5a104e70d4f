import gzip
import io
import zlib

import pytest
from pyspark.sql import functions as F

from colloquy.llm import warc

SCHEMA = "page_id long, url string, html string"


def got(df):
    return {r["page_id"]: r.asDict() for r in df.collect()}


def test_round_trip_against_plain_rule(spark):
    pages = [(1, "u1", "a"), (2, "u2", "é😀" * 3), (3, "u3", "a"), (4, None, None), (5, "u5", ""), (9, "u9", "a"), (7, "long", "x" * 3_000_000)]
    out = got(warc.round_trip(spark.createDataFrame(pages, SCHEMA)))
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", i), i)
    for i, _, h in pages:
        data = (h or "").encode()
        want = last[h or ""]
        r = out[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.base32_sha1(data))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == i else ("revisit", want))


def test_small_payloads_below_the_bound_are_all_responses(spark):
    out = got(warc.round_trip(spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], SCHEMA), min_bytes=3))
    assert [out[i]["record_type"] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]


def test_nulls_repeats_empty_and_clashing_columns(spark):
    pages = spark.createDataFrame([(None, None, "a"), (2, "u", "a"), (2, "u", "a")], SCHEMA).withColumn("revisit", F.lit("x")).withColumn("_sha", F.lit(1))
    rows = sorted((r["page_id"] is None, r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert rows == [(False, "response", None), (False, "response", None), (True, "revisit", 2)]
    alone = warc.round_trip(spark.createDataFrame([(None, None, "a")], SCHEMA)).collect()
    assert [(r["page_id"], r["record_type"]) for r in alone] == [(None, "response")]
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_gzip_members_and_roll(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "h" * 50 + str(i)) for i in range(20)], SCHEMA).coalesce(1)
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", roll_bytes=2000)
    rows = manifest.collect()
    assert len(rows) > 1 and sum(r["records"] for r in rows) == 20
    data = open(rows[0]["path"].removeprefix("file://"), "rb").read()
    text = gzip.decompress(data)
    assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Type: response") == rows[0]["records"]
    assert warc.read_warc(warc.archive_paths(spark, f"file://{tmp_path}/w")).count() == 20


def test_incremental_reader_in_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    data = warc.member(1, "u", b"payload", None, False) + warc.member(2, "u", b"payload", 1, True)
    found = list(warc.records(io.BytesIO(data), "a"))
    assert [(r["page_id"], r["record_type"], r["payload_bytes"], r["refers_to"], r["verified"]) for r in found] == [(1, "response", 7, None, True), (2, "revisit", 7, 1, True)]
    assert found[1]["offset"] == len(warc.member(1, "u", b"payload", None, False))


@pytest.mark.parametrize("broken", ["truncated", "digest", "length", "noise"])
def test_broken_archives(broken):
    good = warc.member(1, "u", b"payload", None, False)
    plain = zlib.decompress(good, 31)
    packed = {"truncated": good[:-12], "digest": gzip.compress(plain.replace(b"payload\r\n", b"paYload\r\n")), "length": gzip.compress(plain.replace(b"payload\r\n", b"pay\r\n")), "noise": gzip.compress(b"hello\r\n\r\n")}[broken]
    found = list(warc.records(io.BytesIO(packed), "a"))
    assert len(found) == 1 and found[0]["error"] and not found[0]["verified"]


def test_ids_keep_all_page_ids():
    for i in (0, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(i)) == i
    assert warc.page_of("<urn:uuid:00000000-0000-0000-0000-000000000001>") is None and warc.page_of(None) is None


@pytest.mark.parametrize("size", [5, 100, 1 << 18])
def test_records_behind_a_broken_one_are_read(monkeypatch, size):
    monkeypatch.setattr(warc, "READ_BYTES", size)
    good = [warc.member(i, f"u{i}", f"payload {i} ".encode() * 40, None, False) for i in range(5)]
    plain = zlib.decompress(good[1], 31)
    for broken in (good[1][:60], good[1][:-3] + b"xyz", b"noise without any member", good[1][:30] + b"\x00" * 200, gzip.compress(b"hello"), gzip.compress(plain.replace(b"Content-Length: ", b"Content-Length: x")), b"\x1f\x8b\x08" * 9):
        data = good[0] + broken + good[2] + good[3] + broken + good[4]
        found = list(warc.records(io.BytesIO(data), "a"))
        assert [r["page_id"] for r in found if r["verified"]] == [0, 2, 3, 4], broken[:20]
        assert [r["offset"] for r in found if r["verified"]] == [0, len(good[0] + broken), len(good[0] + broken + good[2]), len(data) - len(good[4])]
        assert sum(bool(r["error"]) for r in found) >= 2


def test_a_header_without_an_end_is_bounded(monkeypatch):
    monkeypatch.setattr(warc, "HEADER_BYTES", 1000)
    stream = warc.Members(io.BytesIO(gzip.compress(b"x" * 50_000_000) + warc.member(1, "u", b"p", None, False)))
    stream.start()
    with pytest.raises(ValueError, match="header"):
        stream.until(b"\r\n\r\n", 1000)
    assert len(stream.have) <= 2 * warc.READ_BYTES
    stream.recover()
    assert stream.start() and stream.until(b"\r\n", 1000) == b"WARC/1.1\r\n"


def test_digests_of_other_kinds():
    import hashlib

    assert warc.agrees("sha256:" + hashlib.sha256(b"x").hexdigest(), b"x") and not warc.agrees("sha256:" + hashlib.sha256(b"y").hexdigest(), b"x")
    assert warc.agrees("SHA1:" + warc.base32_sha1(b"x").lower(), b"x") and warc.agrees("crc9:anything", b"x") and warc.agrees("", b"x")


def test_a_revisit_with_a_bad_length_is_a_row_with_an_error():
    good = warc.member(1, "u", b"payload", None, False)
    plain = gzip.decompress(warc.member(2, "u", b"payload", 1, True))
    head, _, block = plain.partition(b"\r\n\r\n")
    for told in (b"abc", b"-7", b"7" * 30, "٣".encode()):
        http = block.removesuffix(b"\r\n\r\n")
        changed = b"\r\n".join(b"Content-Length: " + told if x.lower().startswith(b"content-length") else x for x in http.split(b"\r\n"))
        lines = [b"Content-Length: %d" % len(changed) if x.lower().startswith(b"content-length") else x for x in head.split(b"\r\n") if not x.lower().startswith(b"warc-block-digest")]
        data = gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + changed + b"\r\n\r\n")
        found = list(warc.records(io.BytesIO(good + data + good), "a"))
        assert [r["record_type"] for r in found] == ["response", "revisit", "response"]
        assert found[1]["payload_bytes"] is None and not found[1]["verified"] and "Content-Length" in found[1]["error"]


def test_revisits_are_held_against_their_responses(spark, tmp_path):
    data = warc.member(1, "u", b"payload", None, False) + warc.member(2, "u", b"payload", 1, True) + warc.member(3, "u", b"other..", 1, True) + warc.member(4, "u", b"payload", 9, True) + warc.member(5, "u", b"payload!", 1, True)
    (tmp_path / "a.warc.gz").write_bytes(data)
    read = warc.read_warc(warc.archive_paths(spark, f"file://{tmp_path}"))
    assert [r["verified"] for r in read.orderBy("page_id").collect()] == [True] * 5
    held = warc.against_responses(read)
    rows = held.orderBy("page_id").collect()
    assert held.columns == read.columns
    assert [(r["verified"], bool(r["error"])) for r in rows] == [(True, False), (True, False), (False, True), (False, True), (False, True)]
    assert rows[0]["payload"] == b"payload"
