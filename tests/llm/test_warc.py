"""Archives and their index against plain rules, with several blocks, index files and archives."""

from __future__ import annotations

import hashlib

import pytest

from lexiform.llm import warc
from lexiform.llm.common import written

SCHEMA = "page_id long, url string, html string, digest string, first long, file string, key string"
LONG = "<p>" + "x" * 200


def _pages():
    rows = [(i, f"https://www{i % 7}.example{i % 13}.org/p/{i % 50}?q={i}", f"<p>{'é' * (i % 300)}{i % 40}") for i in range(400)]
    rows += [(1000 + i, None if i % 2 else "http://hot.example.com/", LONG) for i in range(300)]  # hot keys, equal payloads
    rows += [(2000, "http://www.Example.com/a?b=1#c", LONG), (2001, "https://example.org:8080//q", None), (2002, "http://www.example.com/a?b=1", "y"), (2003, "http://[broken/\tx\ny", "<p>" * 90), (2004, "", "")]
    rows += [(None, "http://nowhere.example/", LONG), (2005, "http://a/", "y" * 500_000), (7, "http://again.example/", "<p>again"), (1000, None, LONG)]
    return rows


def _expected(rows):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        at = first.get(body, i)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if at == i else "revisit", None if at == i else at))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,file,archive", [(3000, 30_000, 64 << 20), (5, 60, 20_000)])
def test_pages_come_back_through_the_index(spark, tmp_path, monkeypatch, block, file, archive):
    monkeypatch.setattr(warc, "FILE_LINES", file)
    monkeypatch.setattr(warc, "STRETCH_BYTES", archive // 2)
    pages = spark.createDataFrame([(*r, "x", 5, "y", "z") for r in _pages()], SCHEMA).repartition(3)
    where, index = str(tmp_path / "warc"), f"file://{tmp_path}/cdx"
    # Blocks and archives are cut in workers, which read these numbers there.
    monkeypatch.setattr(warc, "BLOCK_LINES", block)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive)
    captures = written(warc.write_archives(pages, where), "captures")
    directory = written(warc.write_index(captures, index), "directory")
    size = captures.agg({"length": "sum"}).first()[0]
    got = warc.read_back(pages, directory, index, where, size).drop("stored_crc32").collect()
    assert sorted((tuple(r) for r in got), key=repr) == _expected(_pages())
    if file == 60:
        assert directory.select("file").distinct().count() > 3
    blocks = sorted((r.first_key, r.last_key, r.file, r.offset, r.length) for r in directory.collect())
    assert sorted(p for _, p in warc.lookup(blocks, index, where, "http://www.example.com/a?b=1")) == [b"", b"y"]
    assert len(warc.lookup(blocks, index, where, "http://hot.example.com/")) == 150 and warc.lookup(blocks, index, where, "http://no.net/") == []
    some = spark.createDataFrame([("http://again.example/",), ("http://no.net/",), ("https://example.org:8080//q",)], "url string")
    assert sorted(r.page_id for r in warc.read_back(some, directory, index, where, size).collect()) == [7, 2001]


def test_the_query_and_empty_tables(spark, tmp_path):
    for rows in (_pages(), []):
        d = tmp_path / str(len(rows))
        spark.createDataFrame([(*r, "x", 5, "y", "z") for r in rows], SCHEMA).write.parquet(f"{d}/pages.parquet")
        got = sorted((tuple(r) for r in warc.op7_warc(spark, str(d)).collect()), key=repr)
        assert got == _expected(rows)
