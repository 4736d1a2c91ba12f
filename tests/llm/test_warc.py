import gzip
import io

from corpusloom.llm import warc


def test_round_trip(spark, tmp_path):
    big = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 10 + "é漢"
    rows = [(3, "http://a/\r\nX: y", big, "z"), (1, None, big, "z"), (1, "u", big, "z"), (None, "u", big, "z"), (4, "u", None, "z"), (5, "u", None, "z"), (6, "u", "x" * 99, "z"), (7, "u", "x" * 99, "z"), (None, "v", "y" * 200, ""), (None, "v", "y" * 200, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df, path=str(tmp_path / "w")).collect()), key=str)
    n = len(big.encode())
    want = [(3, "revisit", 1, n), (1, "response", None, n), (1, "response", None, n), (None, "revisit", 1, n), (4, "response", None, 0), (5, "response", None, 0), (6, "response", None, 99), (7, "response", None, 99), (None, "response", None, 200), (None, "response", None, 200)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0), path=str(tmp_path / "e")).count() == 0
    back = warc.read_archive(spark, str(tmp_path / "w"), with_payload=True).filter("page_id = 1").first()
    assert bytes(back.payload).decode() == big


def test_gzip_by_record():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = gzip.compress(one) + gzip.compress(one)
    assert [b for _, b in warc.parse_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))))] == [b"hello"] * 2
