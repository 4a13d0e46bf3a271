import hashlib
import io
import random
import struct

import zstandard

from lagscope.llm import warc_zstd as w

from .conftest import clashing

PAGES = "page_id bigint, url string, html string"


def brute(rows):
    groups = {}
    for p, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and p is not None:
            groups[data] = max(groups.get(data, p), p)
    count = {}
    for _, _, h in rows:
        count[h or ""] = count.get(h or "", 0) + 1
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        to = groups.get(data) if count[h or ""] > 1 else None
        to = None if p == to else to
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def sample_pages():
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "délta", "<p>", "</p>", "href"]
    rows = [(i, f"http://x.example/{i}", "<html>" + " ".join(rng.choices(words, k=rng.randrange(400))) + "</html>")
            for i in range(300)]
    big = "same payload " * 100
    return rows + [(900, "u", big), (901, "u\r\nWARC-Type: evil", big), (899, None, big), (902, "ü /a b", "é" * 500),
                   (903, "", "é" * 500), (904, "u", "x" * 999), (905, "u", "x" * 999), (906, "u", None), (907, None, ""),
                   (901, "u", big), (None, "u", big), (None, "u", "no id"), (908, "u", "q" * 3_000_000),
                   (909, "u", "a\r\n\r\nb\0\U0001f600 WARC/1.1\r\n" * 60)]


def test_round_trip_against_brute_force(spark):
    rows = sample_pages()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    assert sorted(map(tuple, w.archive_round_trip(clashing(df)).collect()), key=str) == brute(rows)


def test_archives_on_disk(spark, tmp_path):
    rows = sample_pages()
    df = spark.createDataFrame(rows, PAGES).repartition(2)
    folder = f"file://{tmp_path}/warc"
    listed = w.write_warc(w.page_records(df), folder, w.Layout(archive=8_000, sample=50, dictionary=4096)).collect()
    assert sum(r.records for r in listed) == len(rows) and len(listed) > 4
    payloads = {}
    dictionaries = set()
    for r in listed:
        data = open(r.archive.removeprefix("file://"), "rb").read()
        assert len(data) == r.bytes
        magic, size = struct.unpack("<II", data[:8])
        assert magic == w.SKIPPABLE
        dictionaries.add(data[8:8 + size])
        learned = zstandard.ZstdCompressionDict(data[8:8 + size])
        assert learned.dict_id() and struct.unpack("<I", data[8 + size:12 + size])[0] == w.FRAME
        records = list(w.read_archive(io.BytesIO(data), chunk=777))
        assert len(records) == r.records
        for record in records:
            head, _, payload = w.parse_record(record)
            if head["WARC-Type"] == "response":
                payloads[payload] = payloads.get(payload, 0) + 1
    assert len(dictionaries) == 1
    assert set(payloads) == {(h or "").encode() for _, _, h in rows}


def test_dictionary_pays():
    rng = random.Random(3)
    recs = [w.record_bytes(str(i), "http://a.example/", f"<html><head>shared head {rng.random()}</head></html>".encode(),
                           "00" * 20, None, "1970-01-01T00:00:00Z") for i in range(2000)]
    out = io.BytesIO()
    n, size = w.write_archive(out, iter(recs), w.Layout(), w.train(recs[::2], 65_536))
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in recs)
    assert n == 2000 and size == len(out.getvalue()) < plain / 2
    assert list(w.read_archive(io.BytesIO(out.getvalue()))) == recs


def archive_heads(listed):
    for r in listed:
        data = open(r.archive.removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == w.SKIPPABLE and size >= 8
        yield data[8:8 + size], data


def test_large_pages_in_front_leave_the_dictionary(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "u", "<p>" + rng.choice("abcd") * 2_100_000) for i in range(9)]
    rows += [(100 + i, f"http://x.example/{i}", f"<html><head>shared head {rng.random()}</head></html>") for i in range(2000)]
    df = spark.createDataFrame(rows, PAGES).coalesce(1)
    listed = w.write_warc(w.page_records(df), f"file://{tmp_path}/warc").collect()
    for learned, data in archive_heads(listed):
        assert zstandard.ZstdCompressionDict(learned).dict_id() and b"shared head" in learned
        assert len(list(w.read_archive(io.BytesIO(data)))) == 2009


def test_few_or_equal_records_have_a_dictionary_too(spark, tmp_path):
    for k, rows in enumerate(([(i, "u", f"page {i}") for i in range(8)], [(1, "u", "one")], [(1, "u", "one")] * 40)):
        df = spark.createDataFrame(rows, PAGES)
        listed = w.write_warc(w.page_records(df), f"file://{tmp_path}/warc{k}").collect()
        assert sum(r.records for r in listed) == len(rows)
        for learned, data in archive_heads(listed):
            # what is small compresses against the dictionary all the same
            assert all(len(z) < 250 for z in data[8 + len(learned):].split(struct.pack("<I", w.FRAME)))
        assert sorted(map(tuple, w.archive_round_trip(df).collect()), key=str) == brute(rows)


def test_ids_come_back_as_they_were(spark):
    ids = ["None", "c\r\nX: 1", "", "null", "a>b", "100%", "ü €", None]
    rows = [(i, None, f"text {k}") for k, i in enumerate(ids)] + [(i, "u", "z" * 1500) for i in ids]
    df = spark.createDataFrame(rows, PAGES.replace("bigint", "string"))
    got = w.archive_round_trip(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {max(i for i in ids if i is not None)}


def test_s3a_is_s3():
    assert w.filesystem("file:/tmp/x")[1] == "/tmp/x"
    files, path = w.filesystem("s3a://bucket/folder?region=eu-west-1")
    assert (files.type_name, path) == ("s3", "bucket/folder")


def test_damage_is_found():
    out = io.BytesIO()
    w.write_archive(out, iter([w.record_bytes("1", None, b"payload", "00" * 20, None, "d")]), w.Layout(), b"any content")
    for data in (out.getvalue()[:-3],):
        try:
            list(w.read_archive(io.BytesIO(data)))
        except (ValueError, zstandard.ZstdError):
            continue
        raise AssertionError("a cut archive was read without error")


def test_empty(spark):
    assert w.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0
