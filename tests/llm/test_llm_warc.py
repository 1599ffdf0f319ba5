import gzip
import hashlib
import random

import pytest

from opinion_spark.llm.warc import Reader, Writer, chunk_rows, chunk_table, planned, read_warc, write_warc

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(2)
    big = "".join(rng.choice("ab\n\ré漢") for _ in range(5000))
    return [
        (1, "http://a/", "short"), (2, "http://b/", "short"), (3, None, None), (4, "http://c/\r\nX: 1", ""),
        (5, "u", big), (6, "u", big), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20), (8, "u", "\r\n\r\n" * 60),
        (9, "u", big + "\n"), (9, "u", big + "\n"), (None, "u", big), (None, "u", "q" * 100), (None, "u", "q" * 100),
        (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "x" * 100), (13, "u", "x" * 100), (14, "u", "\ny\r" * 50),
    ]


def brute(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same and len(data) >= 100 else None
        refers = first if first is not None and first != page else None
        kind = "response" if refers is None else "revisit"
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), kind, refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [64 * 1024, 97, 1])
def test_round_trip(spark, table, tmp_path, chunk):
    rows = pages() if chunk > 1 else [r for r in pages() if len(r[2] or "") < 1000]
    df = table([(*r, 5) for r in rows], SCHEMA + ", digest int")
    write_warc(chunk_table(planned(df), chunk), str(tmp_path / "w"))
    got = read_warc(spark, str(tmp_path / "w"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == brute(rows)


def test_chunk_rows_carry_the_digest_so_far(table):
    payload = "abc" * 100
    rows = chunk_table(planned(table([(1, "u", payload)], SCHEMA)), 128).collect()
    assert [r.chunk for r in rows] == [0, 1, 2]
    assert rows[1].digest_so_far == hashlib.sha256(payload.encode()[:256]).hexdigest()


def test_python_sees_chunks_only(table):
    """Spark cuts the payloads; a revisit brings none of its own."""
    long = "x" * 1000 + "y" * 555
    rows = chunk_rows(planned(table([(1, "u", long), (2, "u", long), (3, "u", None)], SCHEMA)), 100).collect()
    assert max(len(r.part or b"") for r in rows) == 100
    by = {p: [r for r in rows if r.page_id == p] for p in (1, 2, 3)}
    assert b"".join(bytes(r.part) for r in by[1]) == long.encode() and [r.chunk for r in by[1]] == list(range(16))
    assert len(by[2]) == 1 and by[2][0].part is None and by[2][0].refers_to == 1
    assert len(by[3]) == 1 and bytes(by[3][0].part) == b""


def test_no_pages(spark, table, tmp_path):
    write_warc(chunk_table(planned(table([], SCHEMA))), str(tmp_path / "w"))
    assert read_warc(spark, str(tmp_path / "w")).count() == 0


def lines(chunk=100):
    payload = b"line\nother\r\n" * 40
    digest = hashlib.sha256(payload).hexdigest()
    parts = [payload[i : i + chunk] for i in range(0, len(payload), chunk)]
    writer = Writer()
    records = [
        writer.record(1, "u", digest, None, len(payload), i, len(parts), p)[0] for i, p in enumerate(parts)
    ]
    whole = b"".join(r + b"\r\n\r\n" for r in records)
    return whole.split(b"\n")[:-1]


def test_reader_refuses_changed_and_missing_chunks():
    def read(raw):
        reader = Reader()
        return [row for line in raw for row in reader.line(line)]

    good = lines()
    assert read(good)[0][2] == 480
    changed = [x.replace(b"other", b"OTHER") for x in good]
    with pytest.raises(ValueError, match="fails at"):
        read(changed)
    starts = [i for i, x in enumerate(good) if x == b"WARC/1.1\r"]
    with pytest.raises(ValueError, match="continuation"):
        read(good[: starts[1]] + good[starts[2] :])


def test_files_are_plain_warc(table, tmp_path):
    write_warc(chunk_table(planned(table([(1, "http://a/", "hé")], SCHEMA))), str(tmp_path / "w"))
    data = b"".join(gzip.open(f).read() for f in (tmp_path / "w").glob("part-*"))
    head, _, rest = data.partition(b"\r\n\r\n")
    length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    assert head.startswith(b"WARC/1.1\r\n") and rest[:length].endswith("hé".encode())
    assert rest[length:] == b"\r\n\r\n"
