from __future__ import annotations

import base64
import hashlib

import pytest

from dossier.llm import warc as W

RECORDS = [W.record_bytes(str(i), f"http://x/{i}", f"<p>page {i}</p>".encode() * 20, None) for i in range(6)]


def ids(data):
    return [r["record_id"] for r in W.salvage(data) if r["kind"] == "record"]


def gaps(data):
    return [(r["offset"], r["length"]) for r in W.salvage(data) if r["kind"] == "gap"]


@pytest.mark.parametrize("pack", [bytes, W.gzip_member])
def test_salvage(pack):
    parts = [pack(r) for r in RECORDS]
    assert ids(b"".join(parts)) == list("012345") and gaps(b"".join(parts)) == []
    at = len(parts[0]) + len(parts[1])
    broken = bytearray(b"".join(parts))
    broken[at + len(parts[2]) // 2] ^= 0xFF
    assert ids(bytes(broken)) == list("01345") and gaps(bytes(broken)) == [(at, len(parts[2]))]
    cut = b"".join(parts[:2]) + parts[2][:-9] + b"".join(parts[3:])
    assert ids(cut) == list("01345") and gaps(cut) == [(at, len(parts[2]) - 9)]
    assert ids(b"junk" + b"".join(parts)) == list("012345") and gaps(b"junk" + b"".join(parts)) == [(0, 4)]
    assert ids(b"".join(parts)[:-3]) == list("01234")
    assert ids(b"") == [] and ids(b"nothing here") == []


def test_mixed_members_and_plain_records():
    assert ids(RECORDS[0] + W.gzip_member(RECORDS[1]) + RECORDS[2] + W.gzip_member(RECORDS[3] + RECORDS[4])) == list("01234")


def test_member_of_several_records():
    whole = bytearray(b"".join(RECORDS))
    at = len(RECORDS[0]) + len(RECORDS[1])
    for place, why in ((at + len(RECORDS[2]) - 9, "block digest doesn't match"), (at, "no version line")):
        bad = bytearray(whole)
        bad[place] ^= 0xFF
        member = W.gzip_member(bytes(bad))
        rows = list(W.salvage(member + W.gzip_member(RECORDS[0])))
        assert [r.get("record_id") for r in rows] == ["0", "1", None, "3", "4", "5", "0"]
        assert (rows[2]["offset"], rows[2]["length"]) == (0, len(member))
        assert rows[2]["reason"] == f"{why}: bytes {at} to {at + len(RECORDS[2])} of the member's content"
    assert ids(W.gzip_member(bytes(whole) + b"junk")) == list("012345") and len(gaps(W.gzip_member(bytes(whole) + b"junk"))) == 1


@pytest.mark.parametrize("level", [0, 6])
def test_failed_member_of_several_records(level):
    payloads = [hashlib.shake_256(bytes([i])).digest(30_000).hex().encode() for i in range(20)]
    records = [W.record_bytes(str(i), f"http://x/{i}", p, "0" if i == 3 else None) for i, p in enumerate(payloads)]
    records[3] = b"\r\n".join(x for x in records[3].split(b"\r\n") if not x.startswith(b"WARC-Block-Digest"))  # nothing vouches for it
    coder = W.zlib.compressobj(level, W.zlib.DEFLATED, 31)
    member = coder.compress(b"".join(records)) + coder.flush()
    every, after = [str(i) for i in range(20)], W.gzip_member(RECORDS[5]) + RECORDS[4]
    summed = bytearray(member)
    summed[-6] ^= 0xFF  # the checksum
    for bad in (bytes(summed), member[:-3]):
        rows = list(W.salvage(bad + after))
        assert [r["record_id"] for r in rows if r["kind"] == "record"] == [*every, "5", "4"]
        assert [r["record_id"] for r in rows if r["kind"] == "record" and r.get("reason")] == ["3"]
        assert [r["kind"] for r in rows].count("gap") == 1
    half = ids(member[: len(member) // 2] + after)
    assert sorted(half[-2:]) == ["4", "5"] and half[:-2] == every[: len(half) - 2] and len(half) >= 10
    broken = bytearray(member)
    broken[len(member) // 2] ^= 0xFF
    found = ids(bytes(broken) + after)
    assert found[:9] == every[:9] and found[-2:] == ["5", "4"] and len(found) == len(set(found[:-2])) + 2


@pytest.mark.parametrize("name", ["md5", "sha1", "sha256", "sha-256"])
def test_digests(name):
    payload = b"<p>page 0</p>" * 20
    raw = hashlib.new(name.replace("-", ""), payload).digest()
    own = f"sha1:{W.digest_of(payload)}".encode()
    block = next(x for x in RECORDS[0].split(b"\r\n") if x.startswith(b"WARC-Block-Digest"))
    assert ids(RECORDS[0].replace(block, b"WARC-Block-Digest: sha1:" + b"A" * 32)) == []
    RECORD = RECORDS[0].replace(block + b"\r\n", b"")  # noqa: N806
    assert ids(RECORD) == ["0"]
    for told in (raw.hex(), raw.hex().upper(), base64.b32encode(raw).decode(), base64.b64encode(raw).decode()):
        assert ids(RECORD.replace(own, f"{name}:{told}".encode())) == ["0"]
        assert ids(RECORD.replace(own, f"{name}:{told}".encode()).replace(b"page 0", b"page 7", 1)) == []
    assert ids(RECORD.replace(own, b"blake9:abc")) == ["0"]
    assert ids(RECORD.replace(own, hashlib.sha1(payload).hexdigest().encode())) == ["0"]


def test_long_headers_and_altered_revisit():
    long = W.record_bytes("9", "http://x/" + "y" * 200_000, b"<p>long</p>", None)
    assert ids(long + RECORDS[0]) == ["9", "0"] and ids(W.gzip_member(long)) == ["9"]
    revisit = W.record_bytes("7", "http://x/7", b"<p>page</p>" * 2, "0")
    assert ids(revisit) == ["7"]
    assert ids(revisit.replace(b"Content-Length: 22", b"Content-Length: 99") + RECORDS[1]) == ["1"]


def test_pages(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 50_000, "WARC/1.1\r\n\r\nfake", "<p>a</p>"]
    html += ["<p>a</p>", ""]
    rows = [(10 - i, None if i == 2 else f"http://h/{i} \r\n" + "z" * 70_000 * (i == 1), h, "x") for i, h in enumerate(html)]
    rows += [(None, "u", "<p>a</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    path, files = W.write_warc(pages)
    out = {r["record_id"]: r for r in W.read_warc(spark, path, files).collect()}
    assert len(out) == len(rows) and all(r["kind"] == "record" for r in out.values())
    for page, _, text, _ in rows:
        payload = (text or "").encode()
        r = out["null" if page is None else str(page)]
        first = min(x[0] for x in rows if x[0] is not None and (x[2] or "") == (text or ""))
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == first else ("revisit", str(first)))
        assert page != first or bytes(r["payload"]) == payload
    path, files = W.write_warc(pages, min_bytes=9)
    kinds = {r["record_id"]: r["record_type"] for r in W.read_warc(spark, path, files, payload=False).collect()}
    assert set(kinds.values()) == {"response"}


def test_repeated_and_null_ids(spark):
    rows = [(1, "u", "same"), (1, "v", "same"), (2, "w", "same"), (None, "x", "other"), (None, "y", "other")]
    path, files = W.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = W.read_warc(spark, path, files).collect()
    assert sorted((r["url"], r["record_type"], r["refers_to"]) for r in out) == [
        ("u", "response", None), ("v", "response", None), ("w", "revisit", "1"), ("x", "response", None), ("y", "response", None),
    ]


def test_empty(spark):
    path, files = W.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert files.count() == 0
