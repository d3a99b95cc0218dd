import gzip
import hashlib
import io

from gaugeflow.llm.warc import WarcRule, archive, filesystem, fields, inflated, read_archive, records


def rows_of(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_round_trip_and_members(spark, prose, tmp_path):
    same = "<p>" + prose(1, 60)
    pages = [(5, "http://a/", same), (3, "http://b/", same), (9, None, same), (1, "http://c/\r\nX: y", "short"), (2, "http://d/", "short"), (4, "u", None), (6, "u", ""), (7, "u", "é" * 60), (8, "u", "WARC/1.1\r\n\r\n" * 40), (10, "u", prose(2, 60_000))]
    index = archive(rows_of(spark, pages).repartition(3), str(tmp_path / "out"))
    got = {r.page_id: r for r in read_archive(index).collect()}
    assert set(got) == {p for p, _, _ in pages}
    for page, _, html in pages:
        raw, r = (html or "").encode(), got[page]
        assert r.declared_bytes == len(raw) and r.declared_digest == hashlib.sha256(raw).hexdigest()
        if page in (5, 9):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 3, None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)
    # Every member is a gzip file by itself, and the sidecar says where it lies.
    seen = 0
    for path in {r.archive for r in index.collect()}:
        fs, name = filesystem(path)
        data = fs.open_input_file(name).read()
        at = 0
        for line in fs.open_input_file(name + ".idx").read().decode().splitlines():
            offset, length, record_id = line.split(" ", 2)
            assert int(offset) == at
            whole = gzip.decompress(data[at:at + int(length)])
            assert fields(whole[:whole.index(b"\r\n\r\n")])["warc-record-id"] == record_id
            at, seen = at + int(length), seen + 1
        assert at == len(data)
        assert sum(1 for _ in records(inflated(io.BytesIO(data)))) == len(data and {r.offset for r in index.where(index.archive == path).collect()})
    assert seen == len(pages)


def test_defined_cases(spark):
    body = "x" * 200
    rows = [(None, "u", body), (None, "u", body), (4, "u", body), (4, "u", body), (5, "u", body), (None, None, None)]
    got = sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in read_archive(archive(rows_of(spark, rows))).collect())
    assert got == [(-1, "response", -1), (-1, "revisit", 4), (-1, "revisit", 4), (4, "response", -1), (4, "response", -1), (5, "revisit", 4)]
    assert read_archive(archive(rows_of(spark, []))).count() == 0
    wide = spark.createDataFrame([(1, "u", body, "p", "d", 3)], "page_id long, url string, html string, payload string, payload_digest string, salt int")
    assert read_archive(archive(wide)).first().page_id == 1


def test_salting_changes_nothing(spark):
    pages = rows_of(spark, [(k, "u", "y" * (100 + k % 3)) for k in range(300)])
    one, many = (sorted((r.page_id, r.record_type, r.refers_to or -1) for r in read_archive(archive(pages, rule=WarcRule(hot=h))).collect()) for h in (1 << 14, 3))
    assert one == many and sum(kind == "response" for _, kind, _ in one) == 3


def test_query_against_its_definition(spark):
    from gaugeflow.llm.queries import QUERIES

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html or "", p.page_id)
    for r in QUERIES["op4_warc"](spark, "/root/testdata/sf0.001").collect():
        html = next(p.html or "" for p in pages if p.page_id == r.page_id)
        raw = html.encode()
        old = first[html] != r.page_id and len(raw) >= 100
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[html]) if old else ("response", None))
