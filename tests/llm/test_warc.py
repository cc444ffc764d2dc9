import base64
import hashlib

import pytest
import zstandard

from quillstrata.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, refers_to bigint"


def test_round_trip(spark, tmp_path):
    long = "<p>é漢</p>" * 30_000
    rows = [(5, "http://a/ b", "same", 1), (3, None, "same", 1), (9, "u", None, 1), (8, "u", "", 1), (-4, "u", long, 1), (7, "u", "same", 1), (3, None, "same", 1), (None, "u", "one\r\n\r\ntwo", 1)]
    pages = spark.createDataFrame(rows, SCHEMA)
    archives = W.write_archives(pages)
    got = W.read_records(archives).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    html = {i: (h or "").encode() for i, _, h, _ in rows}
    for i, rs in by.items():
        for r in rs:
            assert r.payload_bytes == len(html[i]) and r.payload_digest == base64.b32encode(hashlib.sha1(html[i]).digest()).decode()
            assert bytes(r.payload) == (html[i] if r.record_type == "response" else b"")
    assert [(r.record_type, r.refers_to) for r in (*by[3], *by[5], *by[7], *by[8], *by[9], *by[-4], *by[None])] == [("response", None)] * 2 + [("revisit", 3)] * 2 + [("response", None), ("revisit", 8), ("response", None), ("response", None)]
    folder = tmp_path / "out"
    folder.mkdir()
    W.export(archives, str(folder)).collect()
    files = spark.read.format("binaryFile").load(str(folder))
    assert W.read_records(files).count() == len(rows)
    assert W.report(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(records, dictionary=b""):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(dict_data=shared)
    return (W.dictionary_frame(dictionary) if dictionary else b"") + b"".join(c.compress(r) for r in records)


def test_reader_takes_any_frames():
    payloads = [bytes([i % 251]) * (1 << i) for i in range(18)] + [b"x" * 300_000, b""]
    records = [W.record(i, "u", p) for i, p in enumerate(payloads)]
    samples = [W.record(i, f"http://h/{i}", (f"<html>{i}" * 40).encode()) for i in range(400)]
    for dictionary in (b"", W.train_dictionary(samples)):
        got = list(W.read_archive(archive(records, dictionary)))
        assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == payloads
    packed = zstandard.ZstdCompressor().compress(W.train_dictionary(samples))
    shared = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(W.train_dictionary(samples)))
    assert len(list(W.read_archive(W.dictionary_frame(packed) + shared.compress(records[3])))) == 1
    stream = zstandard.ZstdCompressor(write_checksum=True, write_content_size=False).compressobj()
    assert len(list(W.read_archive(stream.compress(records[17]) + stream.flush()))) == 1
    assert list(W.read_archive(b"")) == []


def test_reader_refuses_what_is_wrong():
    good = W.record(1, "u", b"payload")
    bad = [
        good[:-2], good.replace(b"payload", b"paylaod"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), good.replace(b"WARC-Date: ", b"WARC-Dote: "), good.replace(b"WARC/1.1", b"WORC/1.1"), b"",
        good.replace(b"WARC-Type: response", b"WARC-Type response"),
    ]
    assert len(list(W.read_archive(archive([good, good])))) == 2
    for b in bad[:2] + bad[3:]:
        with pytest.raises(W.WarcError):
            list(W.read_archive(archive([b])))
    for broken in (archive([good])[:-1], archive([good]) + b"junk", b"\x5d\x2a\x4d\x18\xff\0\0\0x"):
        with pytest.raises(W.WarcError):
            list(W.read_archive(broken))


def test_ids():
    for i in (0, 1, -1, 2**63 - 1, -(2**63), None):
        assert W.page_of(W.record_id(i)) == i
