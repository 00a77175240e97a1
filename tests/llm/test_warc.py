import hashlib
import io

import pytest
import zstandard

from loadweave.llm import bundles, warc
from loadweave.llm.common import filesystem
from tests.llm import edges

LONG = "<p>é" + "x" * 200
PAGES = [
    (5, "http://a/1", LONG),
    (3, "http://a/2", LONG),
    (9, None, LONG),
    (None, "http://a/\r\nInjected: yes", LONG),
    (3, "http://a/2", LONG),
    (7, "http://b", "short"),
    (8, "http://b", "short"),
    (10, "http://c", None),
    (11, "http://c", ""),
    (None, "http://d", "no id " * 50),
    (None, "http://d", "no id " * 50),
    (12, "http://e", "\r\n\r\nWARC/1.1\r\n\r\n" * 20),
    (13, "http://f", "big " * 300_000),
    (14, "http://g", "y" * 99),
    (15, "http://g", "y" * 99),
    (16, "http://h", "z" * 100),
    (17, "http://h", "z" * 100),
]


def by_hand():
    first = {}
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        if page_id is not None and len(data) >= 100:
            first[data] = min(first.get(data, page_id), page_id)
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        again = len(data) >= 100 and page_id != first.get(data)
        yield (
            page_id,
            len(data),
            hashlib.sha256(data).hexdigest(),
            "revisit" if again else "response",
            first.get(data) if again else None,
        )


def test_pages(spark):
    pages = edges.clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    manifest = warc.write_bundles(pages)
    found = [tuple(r) for r in warc.read_bundles(manifest).collect()]
    assert sorted(found, key=repr) == sorted(by_hand(), key=repr)
    record = None
    for row in manifest.collect():
        source, path = filesystem(row.place)
        with source.open_input_file(path) as file:
            reader = bundles.Reader(file)
            if 13 in reader.map["id"]:
                record = reader.record(13)
            with pytest.raises(KeyError):
                reader.record(999)
        # any Zstandard reader sees one run of records
        with source.open_input_file(path) as file:
            whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read()), read_across_frames=True).read()
        assert whole.count(b"WARC-Record-ID") == row.records
    assert record["payload"] == ("big " * 300_000).encode() and record["url"] == "http://f"


def test_frames_are_independent():
    out = io.BytesIO()
    writer = bundles.Writer(out, frame_bytes=500)
    for i in range(50):
        payload = f"payload {i} ".encode() * 10
        digest = hashlib.sha256(payload).hexdigest()
        writer.add(i, bundles.record(i, f"http://x/{i}", warc.DATE, digest, len(payload), payload))
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    reader = bundles.Reader(Source(out.getvalue()))
    assert len(reader.sizes) > 10
    assert reader.record(33)["payload"] == b"payload 33 " * 10
    assert [r["page_id"] for r in reader.records()] == list(range(50))


def test_damage_is_found():
    record = bundles.record(1, "u", warc.DATE, hashlib.sha256(b"abc").hexdigest(), 3, b"abc")
    with pytest.raises(ValueError):
        bundles.parse(record.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_bundles(warc.write_bundles(pages)).count() == 0
