import base64
import gzip
import hashlib
import os

from changelens.llm import warc
from changelens.session import work_path


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, sha1 string, response long")


def want(rows):
    out, last = [], {}
    for i, _, h in rows:
        d = hashlib.sha1((h or "").encode()).digest()
        last[d] = max((x for x in (last.get(d), i) if x is not None), default=None)
    for i, u, h in rows:
        data = (h or "").encode()
        top = last[hashlib.sha1(data).digest()]
        revisit = top is not None and top != i
        out.append((
            i, u, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
            "revisit" if revisit else "response", top if revisit else None, None if revisit else h or "",
        ))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/x", "<p>é</p>"), (3, "http://a/y", "<p>é</p>"), (9, None, None), (2, "http://b\r\nX: y", ""),
    (4, "http://c/\U0001f600", "x" * 300_000), (7, "u", "same"), (7, "u", "same"), (6, "v", "same"), (7, "w", "other"),
    (None, "n", "same"), (None, "n", "alone"), (1, "", "a\r\n\r\nWARC/1.1\r\n"),
]


def read(spark, folder):
    rows = warc.read_archive(spark, folder).collect()
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def test_round_trip(spark):
    folder = work_path(spark, "warc-test")
    manifest = warc.write_archive(table(spark, ROWS), folder, roll_bytes=2000).collect()
    expected = [(i, u and u.replace("\r", "%0D").replace("\n", "%0A"), *rest) for i, u, *rest in want(ROWS)]
    assert read(spark, folder) == sorted(expected, key=str)
    assert sum(r["records"] for r in manifest) == len(ROWS) and len(manifest) > 1
    local = folder.removeprefix("file:")
    for r in manifest:
        path = f"{local}/{r['file']}"
        assert os.path.getsize(path) == r["bytes"]
        with open(path, "rb") as file:
            data = file.read()
        assert hashlib.sha1(data).hexdigest() == r["sha1"]
        assert gzip.decompress(data).count(b"WARC-Record-ID: ") == r["records"] + 1
    assert not os.listdir(f"{local}/_temporary")


def test_same_table_gives_the_same_bytes(spark):
    folders = [work_path(spark, "warc-test") for _ in range(2)]
    manifests = [sorted(warc.write_archive(table(spark, ROWS), f, roll_bytes=2000).collect()) for f in folders]
    assert manifests[0] == manifests[1]


def test_small_payloads_may_all_be_responses(spark):
    folder = work_path(spark, "warc-test")
    warc.write_archive(table(spark, ROWS), folder, min_revisit=6)
    kinds = {(r["page_id"], r["record_type"]) for r in warc.read_archive(spark, folder).collect()}
    assert (6, "response") in kinds and (3, "revisit") in kinds


def test_empty_table(spark):
    folder = work_path(spark, "warc-test")
    warc.write_archive(table(spark, []), folder)
    assert warc.read_archive(spark, folder).collect() == []
