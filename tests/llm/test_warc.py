"""Archives against a plain walk over the pages; payloads that look like records; files cut by hand."""

import hashlib

import pytest

from allelio.llm import warc


def by_hand(rows):
    body = lambda h: (h or "").encode()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[body(h)] = min(first.get(body(h), i), i)
    out = []
    for i, _, h in rows:
        b = body(h)
        again = len(b) >= 100 and b in first and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return out


ROWS = (
    [(i, f"http://x/{i}", f"page {i % 7} " + "é<p>" * (i % 40)) for i in range(200)]
    + [(900 + i, None, "same " * 40) for i in range(50)]
    + [(5, "u", "same " * 40), (None, "bad\r\nurl: x", "same " * 40), (None, None, None), (1, None, ""), (1, None, "")]
    + [(2000 + i, "long", "WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n" * n) for i, n in enumerate([2000, 20_000, 20_000, 1])]
    + [(3000, "edge", "x" * warc.CHUNK), (3001, "edge", "y" * (warc.CHUNK + 1))]
)


def test_round_trip(spark, rows, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "'y' as record_type")
    out = warc.archive(pages.repartition(3), str(tmp_path / "a"))
    assert out.filter("not intact").count() == 0
    got = rows(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    assert got == sorted(by_hand(ROWS), key=repr)


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write(warc.roles(pages), str(tmp_path / "b"), "none")
    found = {}
    for r in warc.read_segments(spark, str(tmp_path / "b")).orderBy("record_id", "segment").collect():
        assert len(r["content"]) <= warc.CHUNK
        found.setdefault((r["record_id"]), [r["page_id"], r["record_type"], b""])[2] += r["content"]
    assert len(found) == len(ROWS)
    html = {}
    for i, _, h in ROWS:
        html.setdefault(i, set()).add((h or "").encode())
    assert all(b in html[i] if kind == "response" else b == b"" for i, kind, b in found.values())


def test_damage_is_seen():
    whole = b"".join(r + warc.END for r in warc.records_of("urn:a", 1, "u", b"z" * 100_000, hashlib.sha256(b"z" * 100_000).hexdigest(), None))
    assert [s[6] for s in warc.parse(whole)] == [1, 2]
    with pytest.raises(ValueError):
        list(warc.parse(whole[:-10]))
    with pytest.raises(ValueError):
        list(warc.parse(b"x" + whole))


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
