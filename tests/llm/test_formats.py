"""Archives with odd heads and many records, archive files, and chats with very long texts."""

import gzip
import hashlib
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from causeway.llm import arc_to_warc, chat_format


def record(body, url="http://x/1"):
    return arc_to_warc.ArcRecord({"URL": url, "IP-address": "1.2.3.4", "Archive-date": "19970102030405", "Content-type": "text/html", "Result-code": "200"}, body)


@pytest.mark.parametrize("version", [1, 2])
def test_heads_with_bare_line_feeds(version):
    body = b"HTTP/1.0 200 OK\nServer: old\nX-Page-Id: 12\n\n<html>\n\nbody"
    arc = arc_to_warc.write_arc(version, "a.arc", [record(body)])
    ((fields, block),) = arc_to_warc.read_warc(arc_to_warc.convert(arc))
    payload = b"<html>\n\nbody"
    assert block == body and arc_to_warc.split_http(block)[1] == payload
    assert fields["WARC-Payload-Digest"] == arc_to_warc.digest_name(hashlib.sha1(payload).digest())
    assert arc_to_warc.key_of(fields["WARC-Record-ID"]) == 12


@pytest.mark.parametrize("value", [b"home", b"", b"99999999999999999999", b"1.5", b"\xff\xfe", b"12 13"])
def test_foreign_page_ids_are_no_keys(value):
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: " + value + b"\r\n\r\nx"
    arc = arc_to_warc.write_arc(1, "a.arc", [record(body), record(body, "http://x/2")])
    ids = [f["WARC-Record-ID"] for f, _ in arc_to_warc.read_warc(arc_to_warc.convert(arc))]
    assert len(set(ids)) == 2


def test_a_head_without_an_end_is_all_head():
    assert arc_to_warc.split_http(b"HTTP/1.1 200 OK\r\nA: b") == (b"HTTP/1.1 200 OK\r\nA: b", b"")


def test_many_small_records_are_read_in_time_and_cut_into_archives(spark):
    arc = arc_to_warc.write_arc(1, "a.arc", [record(b"tiny%d" % i) for i in range(20_000)])
    warc = arc_to_warc.convert(arc)
    began = time.process_time()
    assert sum(1 for _ in arc_to_warc.read_warc(warc)) == 20_000
    assert time.process_time() - began < 6
    with pytest.raises((ValueError, Exception)):
        list(arc_to_warc.read_warc(warc[:-7]))
    pages = spark.range(30_000, numPartitions=1).selectExpr("id as page_id", "'u' as url", "cast(null as string) as html")
    archives = arc_to_warc.write_archives(pages)
    assert archives.count() > 1 and archives.agg({"records": "sum"}).first()[0] == 30_000


def test_archive_files_can_be_read_by_any_reader(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(50)], "page_id long, url string, html string")
    archives = arc_to_warc.write_archives(pages)
    files = arc_to_warc.export_archives(archives, f"file://{tmp_path}/warc").collect()
    assert sum(f["records"] for f in files) == 50
    records = 0
    for f in files:
        path = f["path"].removeprefix("file://")
        assert path.endswith(".warc.gz")
        raw = gzip.open(path).read()
        records += raw.count(b"WARC/1.1\r\n")
        assert b"WARC-Target-URI: http://x/" in raw
    assert records == 50
    again = arc_to_warc.export_archives(archives, f"file://{tmp_path}/warc").collect()
    assert {f["path"] for f in again} == {f["path"] for f in files} and len(list((tmp_path / "warc").iterdir())) == len(files)


def test_long_texts_are_assembled_without_an_index_for_each_byte():
    long = "x<|y" * 2_500_000
    conv, roles = pa.array([1, 1, 2], pa.int64()), pa.array(["user", "assistant", "assistant"])
    tracemalloc.start()
    out = chat_format.assemble(conv, roles, pa.array(["q", long, "z"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(long)
    first = out["formatted"][0].as_py()
    turns = chat_format.parse_chat(first.encode())
    assert turns == [("user", b"q"), ("assistant", long.encode())]
    assert chat_format.parse_chat(out["formatted"][1].as_py().encode()) == [("assistant", b"z")]


def test_segments_of_all_lengths_are_copied():
    rng = np.random.default_rng(5)
    length = np.concatenate([rng.integers(0, 50, 3000), rng.integers(4000, 9000, 5), [0, 0, 300_000]]).astype(np.int64)
    rng.shuffle(length)
    source = rng.integers(0, 255, int(length.sum()) + 10).astype(np.uint8)
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), dtype=np.uint8)
    chat_format._scatter(out, start, source, start, length)
    assert (out == source[: len(out)]).all()


def test_rows_without_a_conversation_are_one_each(spark):
    turns = spark.createDataFrame([(None, i, "assistant", f"t{i}") for i in range(40)] + [(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chat(turns).collect()
    assert len(out) == 41 and all(r["n_turns"] == 1 for r in out)
