import hashlib
import io
import random
import zipfile

import pytest

warc = pytest.importorskip("confluo.llm.warc")


def brute(rows):
    best = {}
    for p, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and p is not None:
            best[raw] = max(best.get(raw, p), p)
    out = []
    for p, h in rows:
        raw = (h or "").encode()
        top = best.get(raw)
        again = top is not None and top != p
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_written_and_read(spark):
    rng = random.Random(1)
    big = ["<p>" + "é" * 600 + str(k) for k in range(5)]
    rows = [(k, rng.choice([*big, None, "", "short", "a\r\n\r\nb"])) for k in range(200)] + [(7, big[0]), (7, big[0]), (None, big[1]), (None, None)]
    df = spark.createDataFrame([(p, "http://h/ x", h, "clash") for p, h in rows], "page_id long, url string, html string, digest string")
    got = warc.written_and_read(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert warc.written_and_read(df.limit(0)).count() == 0


def test_archive_with_many_members_and_note(tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for k in range(66_000):
            z.writestr(f"m{k}", str(k))
        z.comment = b"note" * 100
    archive = warc.Archive(path)
    assert len(archive.members) == 66_000 and archive.whole("m65999") == b"65999"
    with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", "x" * 100)
    with pytest.raises(ValueError):
        warc.Archive(path).whole("packed")


def test_written_archive_is_a_plain_zip(tmp_path):
    path = str(tmp_path / "b.wacz")
    writer = warc.ArchiveWriter(path)
    writer.add("http://a/", "response", warc.record("response", "urn:page:1", "http://a/", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi", "d", {}))
    writer.close()
    with zipfile.ZipFile(io.BytesIO(open(path, "rb").read())) as z:
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.CDX, warc.PACKAGE]
    assert [r.payload for r in warc.records(warc.Archive(path))] == [b"hi"]
