import gzip
import hashlib
import io

import pytest

from quillfold.llm import warc


def brute(rows):
    least = {}
    for i, html in rows:
        least[html or ""] = min(least.get(html or "", i), i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and least[html or ""] != i
        out.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(least[html or ""]) if again else None))
    return sorted(out, key=str)


def got(spark, folder, **options):
    return sorted((tuple(r) for r in warc.records(warc.read_chunks(spark, folder, **options)).collect()), key=str)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = warc.write_archive(pages.repartition(3))
    rows = [tuple(r) for r in pages.select("page_id", "html").collect()]
    assert got(spark, folder) == brute(rows)
    html = dict(rows)
    parts = {}
    for r in warc.read_chunks(spark, folder, chunk=1000).collect():
        assert len(r.payload) <= 1000
        parts.setdefault(r.record_id, []).append((r.chunk_no, bytes(r.payload), r.digest, r.bytes, r.record_type))
    for i, chunks in parts.items():
        so_far = b""
        for number, (no, data, digest, size, _) in enumerate(sorted(chunks)):
            so_far += data
            assert (no, digest, size) == (number, hashlib.sha256(so_far).hexdigest(), len(so_far))
        if chunks[0][4] == "response":
            assert so_far == (html[int(i)] or "").encode()


def test_edge_rows(spark, monkeypatch):
    long = "<p>é\r\n\r\nWARC/1.1</p>" * 200_000
    rows = [(5, None), (3, ""), (9, "x" * 100), (4, "x" * 100), (7, "x" * 99), (8, "x" * 99), (2, long), (6, long), (4, "x" * 100), (1, "\r\n\r\n")]
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", h, "d") for i, h in rows], "page_id long, url string, html string, digest string")
    want = brute(rows)
    folder = warc.write_archive(pages)
    assert got(spark, folder) == want == got(spark, folder, payloads=False, chunk=1 << 16)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert got(spark, warc.write_archive(pages)) == want
    assert got(spark, warc.write_archive(pages.limit(0))) == []


def test_files_are_plain_warc(spark):
    folder = warc.write_archive(spark.createDataFrame([(1, "http://a", "hello")], "page_id long, url string, html string"))
    fs, path = warc._filesystem(folder)
    from pyarrow.fs import FileSelector

    (name,) = [f.path for f in fs.get_file_info(FileSelector(path)) if f.path.endswith(".warc.gz")]
    data = gzip.decompress(fs.open_input_file(name).read())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"hello\r\n\r\n")


def test_short_segments_are_errors():
    data = gzip.compress(warc.record_head("1", "u", 5, "d", None) + b"hello\r\n\r\n")
    assert next(warc.chunks_of(warc.inflate(io.BytesIO(data), len(data))))[2] == b"hello"
    with pytest.raises(EOFError):
        list(warc.chunks_of(warc.inflate(io.BytesIO(data[:-12]), len(data) - 12)))
    wrong = gzip.compress(warc.record_head("1", "u", 6, "d", None) + b"hello\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.chunks_of(warc.inflate(io.BytesIO(wrong), len(wrong))))


def test_other_payloads_or_records_than_stated_are_refused(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "x" * 300), (2, None, "y" * 300), (3, "w", None)], "page_id long, url string, html string").coalesce(1)
    folder = warc.write_archive(pages, str(tmp_path / "a"))
    assert len(got(spark, folder)) == 3
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    wrong = spark.createDataFrame([(r.file, r.start, r.length, r.records + 1) for r in manifest], "file string, start long, length long, records long")
    wrong.write.mode("overwrite").parquet(f"{tmp_path}/b/manifest")
    for r in manifest:
        data = (tmp_path / "a" / r.file).read_bytes()
        (tmp_path / "b" / r.file).write_bytes(data)
    with pytest.raises(Exception, match="other records"):
        got(spark, str(tmp_path / "b"))
    (bad,) = manifest
    plain = gzip.decompress((tmp_path / "b" / bad.file).read_bytes()).replace(b"y" * 300, b"y" * 299 + b"z")
    data = b"".join(gzip.compress(b"WARC/1.1" + x) for x in plain.split(b"WARC/1.1")[1:])
    (tmp_path / "b" / bad.file).write_bytes(data)
    spark.createDataFrame([(bad.file, 0, len(data), bad.records)], "file string, start long, length long, records long").write.mode("overwrite").parquet(f"{tmp_path}/b/manifest")
    with pytest.raises(Exception, match="not what its record says"):
        got(spark, str(tmp_path / "b"))
