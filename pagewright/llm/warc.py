"""WARC archives: a writer with revisit records and a salvage reader (operator 9).

Writer: one gzip member for each record (or plain records), dealt to part files
by Spark's text sink, so that any Hadoop file system and Spark's commit
protocol serve. The sink ends each row with a separator; a gzip member ends
with the high byte of its length, zero below 16 MB, so this zero byte is the
separator (longer members are followed by an empty member, which ends so too).

Reader: after a failed check (not inflatable, no version line, bad length, no
record end, wrong payload digest) it searches for the next member or version
line from which a valid record can be read, goes on there, and logs the bytes
in between as a quarantined gap. A damaged member gives what was inflated before
the damage: if it was cut off, each whole record; if its data are wrong, each
record that its own payload digest confirms. Its gap begins behind the input
that those records came from. Inside a sound member, records and gaps have
places in the inflated bytes too.

An archive is read as a whole by one task; the writer bounds archives by
``records_per_file``, and others must stay below Spark's limit of 2 GB for a
binary file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join

#: Fixed values of the format.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
MARK = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")
#: Longest inflated member that counts as valid, and bytes that are inflated at once.
MAX_MEMBER, PIECE = 1 << 30, 512
#: Fixed values of the format: types whose block is no HTTP message, and digest algorithms.
WHOLE_TYPES, ALGORITHMS = ("warcinfo", "resource", "metadata", "conversion", "continuation"), ("sha1", "sha256", "sha512", "md5")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four characters for every five hex digits."""
    digits = F.sha1(payload)
    part = lambda g: F.conv(F.substring(digits, g * 5 + 1, 5), 16, 10).cast("int")
    letter = lambda g, s: F.substring(F.lit(ALPHABET), F.shiftright(part(g), s).bitwiseAND(31) + 1, 1)
    return F.concat(*[letter(g, s) for g in range(8) for s in (15, 10, 5, 0)])


def typed(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, payload (binary), payload_digest, record_type, refers_to.

    Of records with equal payloads of at least min_payload bytes the one with
    the largest page_id is the response and the others revisit it. The largest
    page_id is found with a combinable maximum; the join back meets one row for
    each digest, so Spark can split a payload that very many pages share.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    least = F.octet_length("payload") >= min_payload
    kept = rows.filter(least).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "first")
    joined = salted_join(rows, kept, ["payload_digest"], "page_id", "left")
    again = least & F.coalesce(~F.col("first").eqNullSafe(F.col("page_id")), F.lit(False)) & F.col("first").isNotNull()
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def records(rows: DataFrame) -> DataFrame:
    """One column, record: header, HTTP header, payload of responses, record end; as a string of raw bytes."""
    eol = "\r\n"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(eol))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(eol + eol))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    head = F.concat(
        F.lit(f"WARC/1.1{eol}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("refers_to")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(block)).cast("string")),
        F.lit(eol),
    )
    return rows.select(F.concat(head, http, block, F.lit(eol + eol)).cast("binary").alias("record"))


def _member(record: bytes) -> bytes:
    out = gzip.compress(record, 6, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", mtime=0)


def _members(it):
    for batch in it:
        out, size = [], 0
        for record in batch.column(0).to_pylist():
            out.append(_member(record)[:-1])
            size += len(out[-1])
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(pages: DataFrame, path: str, min_payload: int = 0, compress: bool = True, records_per_file: int = 5000) -> None:
    """Write pages (page_id, url, html; other columns are ignored) as WARC part files under path.

    Null html: empty payload. Null url: no target header. Null page_id: record
    id "none"; such a record never is referred to, and is a response where no
    equal payload has an id. Rows that repeat the largest page_id of a payload
    are all responses. Empty table: no records.
    """
    made = records(typed(pages, min_payload))
    if compress:
        made, end = made.mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value")), "\0"
    else:  # the last byte of the record end is the sink's separator
        made, end = made.select(F.expr("substring(record, 1, octet_length(record) - 1)").cast("string").alias("value")), "\n"
    made.write.option("lineSep", end).option("maxRecordsPerFile", records_per_file).text(path)


def _parse(data: bytes, at: int):
    """The record at data[at:]: (headers, block, end), or the reason why there is none."""
    m = VERSION.match(data, at)
    if not m:
        return "no version line"
    stop = data.find(END, m.end() - 2)
    if stop < 0:
        return "no header end"
    headers = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        elif line:
            return "bad header line"
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "no content length"
    begin = stop + 4
    end = begin + int(length)
    if end > len(data):
        return "truncated block"
    if data[end : end + 4] != END:
        return "no record end"
    return headers, data[begin:end], end + 4


def _inflate(data: bytes, at: int):
    """(inflated bytes, end, None) of the gzip member at data[at:]; of a damaged one what came before the damage, [(input, inflated) so far], and the reason."""
    d = zlib.decompressobj(31)
    out, size, pos, steps, piece = [], 0, at, [], PIECE
    try:
        while not d.eof:
            got = data[pos : pos + piece]
            if not got:
                return b"".join(out), steps, "truncated member"
            pos += len(got)
            out.append(d.decompress(got))
            size += len(out[-1])
            steps.append((pos, size))
            if size > MAX_MEMBER:
                return b"", [], "member too long"
    except zlib.error as e:  # what the last bytes gave before the damage is lost with them: once more, byte by byte
        why, pos = f"bad member: {str(e)[:60]}", steps[-1][0] if steps else at
        d = zlib.decompressobj(31)
        out = [d.decompress(data[at:pos])]
        try:
            for pos in range(pos, pos + PIECE):
                out.append(d.decompress(data[pos : pos + 1]))
                steps.append((pos + 1, steps[-1][1] + len(out[-1]) if steps else len(out[-1])))
        except zlib.error:
            pass
        return b"".join(out), steps, why
    return b"".join(out), pos - len(d.unused_data), None


def _reached(data: bytes, at: int, steps: list, size: int) -> int:
    """The end of the input of the member at data[at:] that gives so many inflated bytes."""
    first = next(i for i, (_, n) in enumerate(steps) if n >= size)
    pos = steps[first - 1][0] if first else at
    d = zlib.decompressobj(31)
    n = len(d.decompress(data[at:pos]))
    while n < size:
        n += len(d.decompress(data[pos : pos + 1]))
        pos += 1
    return pos


def _confirmed(given: str, payload: bytes):
    """Whether a digest header's value is the payload's; None where there is none, or of no known algorithm."""
    name, colon, value = given.partition(":")
    if not colon:
        name, value = "sha1", given
    name = name.strip().lower().replace("-", "")
    if not value or name not in ALGORITHMS:
        return None
    raw = hashlib.new(name, payload).digest()
    return value.strip().lower() == raw.hex() or value.strip().upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def _judge(headers: dict, block: bytes, damaged: bool):
    """(payload or None, digest, why not valid). damaged: only a digest can vouch for the block."""
    given, kind = headers.get("warc-payload-digest", ""), headers.get("warc-type")
    digest = given.removeprefix("sha1:")
    if kind == "revisit":
        if m := re.search(rb"(?i)\r\ncontent-length: *(\d+)\r\n", block):
            headers["http-length"] = int(m[1])  # the HTTP header of a revisit keeps the payload's length
        own = _confirmed(headers.get("warc-block-digest", ""), block)
        return None, digest, "block digest differs" if own is False else "in damaged member" if damaged and own is None else None
    payload = block.partition(END)[2] if kind not in WHOLE_TYPES and block.startswith((b"HTTP/", b"GET ", b"POST ", b"HEAD ")) else block
    own = _confirmed(given, payload)
    if not given and own is None:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    whole = _confirmed(headers.get("warc-block-digest", ""), block)
    if own is False or whole is False:
        return payload, digest, ("payload" if own is False else "block") + " digest differs"
    return payload, digest, "in damaged member" if damaged and own is None and whole is None else None


def _inside(inner: bytes, damaged: bool, cut: bool):
    """Records and gaps of a member's inflated bytes: ("record", begin, end, headers, payload, digest), ("gap", begin, end, reason)."""
    found, pos, n = [], 0, len(inner)
    while pos < n:
        r = _parse(inner, pos)
        if not isinstance(r, str):
            payload, digest, bad = _judge(r[0], r[1], damaged)
            found.append(("gap", pos, r[2], bad) if bad else ("record", pos, r[2], r[0], payload, digest))
            pos = r[2]
            continue
        nxt = next((m.start() for m in VERSION.finditer(inner, pos + 1) if not isinstance(_parse(inner, m.start()), str)), n)
        if nxt < n or not cut:  # what follows the last record of a cut member belongs to the gap of the member
            found.append(("gap", pos, nxt, r))
        pos = nxt
    return found


def _unit(data: bytes, at: int):
    """What stands at data[at:]: (rows as salvage() yields them, end of the bytes accounted for, reason of a gap that begins there), or (None, at, reason)."""
    if data[at : at + 2] != b"\x1f\x8b":
        r = _parse(data, at)
        if isinstance(r, str):
            return None, at, r
        payload, digest, bad = _judge(r[0], r[1], False)
        return [("gap", at, r[2] - at, bad, None, None) if bad else ("record", at, r[2] - at, r[0], payload, digest, None, None)], r[2], None
    inner, end, why = _inflate(data, at)
    found = _inside(inner, why is not None and why != "truncated member", why is not None)
    if why is None:
        alone = len(found) == 1 and found[0][1] == 0 and found[0][2] == len(inner)
        place = lambda b, e: (None, None) if alone else (b, e - b)
        return [(kind, at, end - at, *rest, *place(b, e)) for kind, b, e, *rest in found], end, None
    good = [f for f in found if f[0] == "record"]
    if not good:
        return None, at, why
    last = good[-1][2]
    found = found[: found.index(good[-1]) + 1]
    reached = _reached(data, at, end, last)
    return [(kind, at, reached - at, *rest, b, e - b) for kind, b, e, *rest in found], reached, why


def salvage(data: bytes):
    """Over a whole archive, in order: ("record", offset, length, headers, payload, digest, inner offset, inner length) and ("gap", offset, length, reason, inner offset, inner length).

    Offset and length are bytes of the archive; of something inside a gzip
    member they are the member's (of a damaged one: of its good part), and the
    inner ones are places in its inflated bytes, else null. No two of them
    overlap. Line ends and zero bytes between records are no gap.
    """
    at, n = 0, len(data)
    while at < n:
        rows, end, why = _unit(data, at)
        yield from rows or ()
        if why is None:
            at = end
            continue
        nxt = n
        for m in MARK.finditer(data, end + (rows is None)):
            if _unit(data, m.start())[0]:
                nxt = m.start()
                break
        if data[end:nxt].strip(b"\r\n\0"):
            yield "gap", end, nxt - end, why, None, None
        at = nxt


SCHEMA = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner_offset", pa.int64()), ("inner_length", pa.int64()), ("reason", pa.string()), ("record_id", pa.string()), ("record_type", pa.string())]
    + [("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def _row(path, found, payloads):
    kind, at, length = found[:3]
    if kind == "gap":
        return (path, kind, at, length, found[4], found[5], found[3], *[None] * 7)
    _, _, _, headers, payload, digest, begin, size = found
    amount = len(payload) if payload is not None else headers.get("http-length")
    return (path, kind, at, length, begin, size, None, headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), amount, digest or None, payload if payloads else None)


def _read(payloads: bool):
    def run(it):
        out, size = [], 0
        for batch in it:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for found in salvage(content.as_py()):
                    out.append(_row(path, found, payloads))
                    size += 300 + (len(out[-1][-1]) if out[-1][-1] else 0)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives under path, with byte offset and length.

    kind is record or gap; gaps have a reason and nothing else. Places are as
    salvage() has them. payloads=False leaves the payload column null; lengths
    and digests are still those of the full payload. The payload of a response
    or request is the body of its HTTP message, that of a revisit null, that of
    any other record its block. payload_digest is the header's without "sha1:",
    or where there is none the payload's SHA-1. Empty archives have no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return files.mapInArrow(_read(payloads), ", ".join(f"{f.name} {kinds[f.type]}" for f in SCHEMA))
