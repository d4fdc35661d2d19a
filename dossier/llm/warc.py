"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer makes one gzip member a record, as the format asks for. Of records with equal payloads one is
the response, the others point to it. The reader checks each record: the member's own checksum, the version
line, the headers, the length and the digests of block and payload. After a failed check it searches for the next member
or version line from which a record can be read, goes on from there, and logs the bytes between as a gap.
A member of several records is searched in the same way in its inflated bytes, as far as they can be inflated;
what follows a broken place in the compressed bytes of one member can't be inflated and is part of the gap.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import fresh_path, put_file, saved, short_batches

MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
FILE_BYTES = 8 << 20
#: Bytes that the reader feeds to the decompressor at a time.
FEED = 1 << 16
#: Payload bytes of the records that a reading task hands on at a time.
OUT_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = (
    "name string, offset bigint, length bigint, kind string, reason string, record_type string, record_id string, "
    "refers_to string, url string, payload_bytes bigint, payload_digest string, payload binary"
)


#: Digest algorithms that the reader checks; others it hands on unchecked.
ALGORITHMS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_fits(told: str, payload: bytes) -> bool | None:
    """Whether a labelled digest (hex, base32 or base64) is the payload's; null if its algorithm isn't known.

    A digest without a label is taken for SHA-1; what isn't a label and a value doesn't fit.
    """
    label, _, value = told.rpartition(":")
    label, value = label.strip().lower().replace("-", "") or "sha1", value.strip().rstrip("=")
    if not (label.isascii() and label.isalnum() and value.isascii()):
        return False
    if label not in ALGORITHMS or not value:
        return None
    raw = hashlib.new(label, payload).digest()
    base64s = (base64.b64encode(raw), base64.urlsafe_b64encode(raw))
    return value.lower() == raw.hex() or value.upper() == base64.b32encode(raw).decode().rstrip("=") or value in [x.decode().rstrip("=") for x in base64s]


def record_bytes(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit record (the response's headers without the payload) if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


class Damaged(ValueError):
    """A record that fails a check."""


def parse_record(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at a place of data and its length; checked says whether a digest vouches for its payload."""
    if not data.startswith(VERSION, start):
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", start)
    if head_end < 0:
        raise Damaged("no end of headers")
    lines = data[start:head_end].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no length")
    at, end = head_end + 4, head_end + 4 + int(length)
    if not data.startswith(b"\r\n\r\n", end):
        raise Damaged("length doesn't fit")
    block = data[at:end]
    told = head.get("warc-block-digest", "")
    whole = digest_fits(told, block) if told else None
    if whole is False:
        raise Damaged("block digest doesn't match")
    kind, payload, size = head.get("warc-type", ""), block, None
    if head.get("content-type", "").startswith("application/http"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise Damaged("no end of HTTP headers")
        for x in http.decode("latin-1").split("\r\n"):
            if x.lower().startswith("content-length:") and x.partition(":")[2].strip().isdigit():
                size = int(x.partition(":")[2])
    digest = head.get("warc-payload-digest", "")
    fits = digest_fits(digest, payload) if kind != "revisit" and digest else None
    if fits is False:
        raise Damaged("payload digest doesn't match")
    digest = digest.removeprefix("sha1:")
    bare = lambda k: head[k].removeprefix("<urn:page:").strip("<>") if k in head else None
    found = {"record_type": kind, "record_id": bare("warc-record-id"), "refers_to": bare("warc-refers-to"), "url": head.get("warc-target-uri"), "checked": bool(fits or whole)}
    return found | {"payload_bytes": size if kind == "revisit" else len(payload), "payload_digest": digest or digest_of(payload), "payload": None if kind == "revisit" else payload}, end + 4 - start


def inflate(data: memoryview) -> tuple[bytes, int, str | None]:
    """What can be inflated of the member at the start of data, the compressed bytes read, and why it fails, if it does."""
    coder, out, at = zlib.decompressobj(31), [], 0
    while not coder.eof:
        if at >= len(data):
            return b"".join(out), len(data), "member ends early"
        before = coder.copy()
        try:
            out.append(coder.decompress(data[at : at + FEED]))
        except zlib.error as e:
            try:  # byte by byte, for what comes before the fault
                for at in range(at, min(at + FEED, len(data))):
                    out.append(before.decompress(data[at : at + 1]))
            except zlib.error:
                pass
            return b"".join(out), at + 1, f"member: {e}"
        at += FEED
    return b"".join(out), min(at, len(data)) - len(coder.unused_data), None


def contents(plain: bytes) -> list[tuple[int, int, dict | str]]:
    """Start, end and record of all that can be read in the bytes of a member, or the reason instead for what lies between."""
    at, gap, why, found = 0, None, "", []
    while at < len(plain):
        try:
            record, size = parse_record(plain, at)
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            at = plain.find(VERSION, at + 1)
            at = len(plain) if at < 0 else at
            continue
        if gap is not None:
            found.append((gap, at, why))
            gap = None
        found.append((at, at + size, record))
        at += size
    if gap is not None:
        found.append((gap, len(plain), why))
    return found


def rows_at(data: bytes, start: int) -> tuple[list[dict], int, str | None]:
    """The records (and gaps between them) of the member at a place of data, or the plain record there.

    With them the bytes they take, and the failed check after which only a search can go on, if one failed. A record
    alone in a member that fails is not given: the member's checksum is its own. Of several, those are given that
    pass the checks of a plain record; one without a digest to vouch for it says so as its reason.
    """
    if not data.startswith(MEMBER, start):
        try:
            record, size = parse_record(data, start)
        except Damaged as e:
            return [], 0, str(e)
        return [{"kind": "record"} | record], size, None
    plain, size, fault = inflate(memoryview(data)[start:])
    parts = contents(plain)
    records = [x for x in parts if isinstance(x[2], dict)]
    if not records:
        return [], size, fault or (parts[0][2] if parts else None)
    if fault:
        if len(records) == 1 and records[0][0] == 0 and plain.find(VERSION, records[0][1]) < 0:
            return [], size, fault
        parts = parts[: parts.index(records[-1]) + 1]
    rows = []
    for start, end, x in parts:
        if isinstance(x, dict):
            rows.append({"kind": "record"} | x | ({"reason": f"{fault}; no digest to check"} if fault and not x["checked"] else {}))
        else:
            rows.append({"kind": "gap", "reason": f"{x}: bytes {start} to {end} of the member's content"})
    return rows, size, fault and f"{fault}: from byte {records[-1][1]} of the member's content"


def salvage(data: bytes) -> Iterator[dict]:
    """Every record that can be read, and every gap, in file order.

    Offset and length are those of the member (as far as it was read) for what is found in one.
    """
    at, gap, why = 0, None, None
    nexts = {MEMBER: 0, VERSION: 0}  # where each mark comes next, so that no bytes are searched twice for it
    known, until = set(), 0  # records given of a failed member: its bytes are searched again, and may hold them as they are
    key = lambda r: (r["record_type"], r["record_id"], r["url"], r["payload_digest"], r["payload_bytes"])
    while at < len(data):
        rows, size, fault = rows_at(data, at)
        if at < until:
            rows = [r for r in rows if r["kind"] == "gap" or key(r) not in known]
        if gap is not None and rows:
            yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": why}
            gap = None
        for r in rows:
            yield {"offset": at, "length": size} | r
        if not fault:
            at += size
            continue
        if gap is None:
            gap, why = at, fault
        if rows:
            known, until = {key(r) for r in rows if r["kind"] == "record"}, at + size
        for mark, place in nexts.items():
            if place <= at:
                place = data.find(mark, at + 1)
                nexts[mark] = len(data) if place < 0 else place
        at = min(nexts.values())
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": len(data) - gap, "reason": why}


def write_warc(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Writes a record for each row; returns the folder and the list of files that finished tasks wrote.

    Of rows whose payload (UTF-8 of the html; null: empty) is equal and has min_bytes or more, the one with the
    smallest id is the response (each, if an id is repeated), the others revisit it; a null id never is the smallest
    unless all are null, and then all are responses. Addresses and ids may be of any length; white space in an address
    is left out, as a header can't hold it.
    """
    spark = pages.sparkSession
    short_batches(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha1("html"))))
    # only payloads that several rows have, as a table of its own: the join then shuffles both sides for itself (or
    # broadcasts a small table), and Spark can split the rows of a payload that a third of them share
    firsts = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
    firsts = saved(firsts.where("times > 1").select("key", "first"), "warc-firsts")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(firsts, "key", "left").select(
        F.col("page_id").cast("string"), "url", "html", F.when(revisit, F.col("first")).cast("string").alias("refers_to")
    )
    path = fresh_path(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        held, size, turn, count = [], 0, 0, 0

        def file() -> pd.DataFrame:
            name = f"{task.partitionId():06d}-{turn:06d}-{task.taskAttemptId()}.warc.gz"
            put_file(f"{path}/{name}", b"".join(held))
            return pd.DataFrame({"name": [name], "records": [count]})

        for batch in batches:
            for page, url, html, first in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                member = gzip_member(record_bytes("null" if page is None else page, url, html.encode(), first))
                held.append(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    yield file()
                    held, size, turn, count = [], 0, turn + 1, 0
        if held:
            yield file()

    return path, saved(rows.mapInPandas(write, "name string, records bigint"), "warc-files")


def read_warc(spark: SparkSession, path: str, files: DataFrame | None = None, glob: str = "*.warc*", payload: bool = True) -> DataFrame:
    """The records and the gaps of all files in a folder (of those in files, a column name, if given).

    A row has kind record or gap, the file's name, and offset and length of the bytes it came from (the whole member
    for what is found in one); gaps have the reason of the first failed check. payload False leaves the payload out (it is checked all the same).
    Empty files have no rows.
    """
    short_batches(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        held, size = [], 0
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                for r in salvage(content):
                    size += len(r.get("payload") or b"")
                    held.append(r | {"name": name} | ({} if payload else {"payload": None}))
                    if size >= OUT_BYTES or len(held) >= 10_000:
                        yield _frame(held, columns)
                        held, size = [], 0
        if held:
            yield _frame(held, columns)

    content = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    content = content.select(F.substring_index("path", "/", -1).alias("name"), "content")
    if files is not None:
        content = content.join(files.select("name"), "name", "left_semi")
    return content.mapInPandas(read, READ_SCHEMA)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["payload_bytes"] = out["payload_bytes"].astype("Int64")
    return out.astype({c: object for c in columns if out[c].isna().all() and c not in ("payload_bytes", "offset", "length")})
