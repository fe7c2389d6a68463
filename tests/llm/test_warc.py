import base64
import hashlib
import io

import pytest

from siftmap.llm import warc

ROWS = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (7, "http://c/\r\nX: y", "<p>one</p>"), (3, None, None), (4, "u", ""),
    (5, "u", "é \r\n\r\nWARC/1.1\r\n" * 3), (6, "u", "x" * 300_000), (None, "n", "<p>one</p>"), (None, "n", "nobody"), (8, "r", "twice"), (8, "r", "twice"),
]


def brute(rows):
    last = {}
    for p, _, h in rows:
        if p is not None:
            last[h or ""] = max(p, last.get(h or "", p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        to = last.get(h or "")
        again = to is not None and p != to
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(p, u, h, "d") for p, u, h in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    got = warc.round_trip(frame(spark, ROWS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0


def archive():
    pages = [(k, f"http://{k}/", b"payload %d " % k * 50, None) for k in range(4)]
    return [warc.record(p, u, b, warc.sha1_base32(b), r) for p, u, b, r in pages]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_reader_in_blocks_of_any_size(block):
    assert [r["page_id"] for r in warc.read(io.BytesIO(b"".join(archive())), block)] == [0, 1, 2, 3]


def test_broken_archives_are_refused():
    import zlib

    whole = b"".join(archive())
    with pytest.raises((warc.BadRecord, zlib.error)):
        list(warc.read(io.BytesIO(whole[:-20])))
    body = b"payload"
    bad = warc.record(1, "u", body, warc.sha1_base32(b"other"), None)
    with pytest.raises(warc.BadRecord, match="payload digest"):
        list(warc.read(io.BytesIO(bad)))
    plain = zlib.decompress(archive()[0], 31)
    for old, new, what in ((b"payload 0", b"payload 9", "block digest"), (b"WARC/1.1", b"HTTP/1.1", "version"), (b"\r\n\r\n", b"\r\nLost", "Content-Length")):
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        at = plain.rfind(old) if new == b"\r\nLost" else plain.find(old)
        with pytest.raises(warc.BadRecord, match=what):
            list(warc.read(io.BytesIO(gz.compress(plain[:at] + new + plain[at + len(old):]) + gz.flush())))
