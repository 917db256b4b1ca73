"""Legacy ARC archives: written, parsed by version, and converted to WARC.

Archives are gzip files that Spark's own text writer commits, so any store
that Spark can write to holds them and a lost task leaves no half file. A row
is one record; the ARC record separator (line feed) and the WARC one (two
CRLF) are the writer's line separators.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.store import stash

#: Fields of the URL record line of either ARC version.
ARC_FIELDS = {
    "1": ["url", "ip", "date", "mime", "length"],
    "2": ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"],
}
_NAMES = {"1": "URL IP-address Archive-date Content-type Archive-length", "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}

RECORD = "file string, at long, kind string, url string, ip string, date string, mime string, key string, digest string, payload_bytes long, problem string, head binary, payload binary"


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "19700101000000", file_bytes: int = 64 << 20) -> int:
    """Write a record per row into gzipped ARC files of about ``file_bytes``
    before compression, version 1 and 2 in turn by partition.

    The key column travels as an ``X-Page-Id`` header of the stored response,
    percent-encoded, so that line ends in a key add no header; a null key has
    no such header. Null html is an empty payload. Blanks in an
    address are percent-encoded; a null or empty one becomes ``urn:unknown``.
    Returns the number of rows.
    """
    p = pages.select(F.url_encode(F.col(id_col).cast("string")).alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    total, rows = p.agg(F.coalesce(F.sum(F.octet_length("html") + 400), F.lit(0)), F.count("*")).first()
    files = -(-total // file_bytes) or 1
    if files > p.rdd.getNumPartitions():
        p = p.repartition(files)
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    url = F.when(url == "", "urn:unknown").otherwise(url)
    n = F.octet_length("html").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), n, F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), "key"), F.lit("")), F.lit("\r\n\r\n"))
    p = p.select(url.alias("url"), head.alias("head"), "html", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"))
    length = (F.octet_length("head") + F.octet_length("html")).cast("string")
    two = F.col("part") % 2 == 1
    line = F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), F.when(two, F.concat(F.lit("200 - - "), F.col("row").cast("string"), F.lit(" part-"), F.col("part").cast("string"), F.lit(".arc"))), length)
    record = F.concat(line, F.lit("\n"), "head", "html")

    def opening(version: str) -> Column:
        body = f"{version} 0 strandgraph\n{_NAMES[version]}\n"
        name = F.concat(F.lit("filedesc://part-"), F.col("part").cast("string"), F.lit(".arc"))
        extra = " 200 - - 0 -" if version == "2" else ""
        return F.concat(name, F.lit(f" 0.0.0.0 {date} text/plain{extra} {len(body)}\n{body}\n"))

    start = F.when(F.col("row") == 0, F.when(two, opening("2")).otherwise(opening("1"))).otherwise("")
    p.select(F.concat(start, record).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)
    return rows


def _bytes(content: bytes) -> bytes:
    """Content, unzipped if it is one or more gzip members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, rest = [], content
    while rest:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(rest))
        except zlib.error:  # what follows the last member is no gzip: it stays as it is
            out.append(rest)
            break
        rest = member.unused_data
    return b"".join(out)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, and what follows; no header if it isn't HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def _header(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return unquote_plus(found[1].decode("utf-8", "replace")) if found else None


_URL, _IP, _DATE = r"([A-Za-z][A-Za-z0-9+.-]*:.*?)", r"([0-9A-Fa-f.:]+)", r"([0-9]{4,14})"
#: Record lines with blanks in the address or the type still fit: the address
#: ends before the first thing that can be an IP address and a date.
_LINES = {
    "1": re.compile(f"{_URL} {_IP} {_DATE} (.*) ([0-9]+)"),
    "2": re.compile(f"{_URL} {_IP} {_DATE} (.*) ([0-9]+|-) ([^ ]+) ([^ ]+) ([0-9]+|-) ([^ ]+) ([0-9]+)"),
}
#: No record line is longer; bytes without a line feed are not searched further.
LINE_BYTES = 1 << 16


def record_line(line: bytes, version: str) -> dict[str, str] | None:
    """The fields of a record line, or None if it isn't one."""
    text = line.decode("utf-8", "replace").strip("\r\n \t")
    names = ARC_FIELDS[version]
    parts = text.split(" ")
    if len(parts) == len(names) and parts[-1].isdecimal() and parts[2].isdecimal():
        return dict(zip(names, parts, strict=True))
    found = _LINES[version].fullmatch(text)
    return dict(zip(names, found.groups(), strict=True)) if found else None


def _next_record(data: bytes, at: int, version: str) -> int:
    """The start of the first line after the one at ``at`` that fits, or the end of the data."""
    while (at := data.find(b"\n", at) + 1) > 0:
        end = data.find(b"\n", at, at + LINE_BYTES)
        line = data[at:end] if end >= 0 else b""
        if (fields := record_line(line, version)) and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", fields["url"]):
            return at
    return len(data)


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """(offset, fields, block, problem) of each record, by declared lengths.

    The first record names the version, whose fields the other record lines
    have. Where a line does not fit, the bytes up to the next line that does
    are a record of their own: no bytes are lost, its fields are empty, and
    its problem is ``no record line``. A block cut short by the end of the
    file is what is there, with the problem ``cut short``.
    """
    at, version = 0, "1"
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at, at + LINE_BYTES)
        line = data[at:end] if end >= 0 else data[at : at + LINE_BYTES]
        if line.startswith(b"filedesc:"):
            version = "2" if len(line.split(b" ")) == len(ARC_FIELDS["2"]) else "1"
        fields = record_line(line, version) if end >= 0 else None
        if fields is None:
            to = _next_record(data, at, version)
            yield at, {}, data[at:to], "no record line"
            at = to
            continue
        length = int(fields["length"])
        block = data[end + 1 : end + 1 + length]
        if line.startswith(b"filedesc:") and block[:1] in (b"1", b"2"):
            version = block[:1].decode("ascii")
        yield at, fields, block, None if len(block) == length else "cut short"
        at = end + 1 + length


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the ARC files at ``path``, RECORD's columns.

    Bytes between records that are none are rows of kind ``malformed`` with
    null fields, so ``groupBy("kind", "problem").count()`` tells how much of
    an archive could not be read as it should.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                rows, held = [], 0
                for at, f, block, problem in parse_arc(_bytes(content.as_py())):
                    head, payload = _split_http(block) if f else (b"", block)
                    kind = "malformed" if not f else "warcinfo" if f["url"].startswith("filedesc:") else "response" if head else "resource"
                    rows.append((file, at, kind, *(f.get(x) for x in ("url", "ip", "date", "mime")), _header(head, b"X-Page-Id"), base32_sha1(payload), len(payload), problem, head if payloads else None, payload if payloads else None))
                    held += len(block) * payloads + 200
                    if held > 4 << 20:
                        yield _record_batch(rows)
                        rows, held = [], 0
                yield _record_batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 7, pa.int64(), pa.string(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _iso(date: Column) -> Column:
    """WARC time of an ARC date of 14 digits or fewer (year, month, day first)."""
    full = F.rpad(F.regexp_replace(date, r"\D", ""), 14, "0")
    part = lambda a, n: F.substring(full, a, n)
    day = lambda a: F.when(part(a, 2) == "00", "01").otherwise(part(a, 2))
    return F.concat(part(1, 4), F.lit("-"), day(5), F.lit("-"), day(7), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2), F.lit("Z"))


def _urn(*cols: str) -> Column:
    h = F.md5(F.concat_ws("\n", *cols))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """Convert ARC files to gzipped WARC files.

    Record ids are name-based over (file, offset), times are ISO, types come
    from address and content, digests are base-32 SHA-1. Of records whose
    payloads of ``min_bytes`` or more are equal, the one with the smallest
    key (numbers by value, then others, null last; then file and offset) is
    stored; the others become revisits that name it and keep their HTTP header
    alone. The smallest key of each digest is found by an aggregation that
    combines before its shuffle; it comes back to the light rows first and
    meets the payloads by file and offset, so a frequent payload is no hot key.

    Malformed bytes become ``metadata`` records with their offset in the
    address; a record that was cut short is marked ``WARC-Truncated``.
    """
    plain = F.col("kind").isin("response", "resource") & (F.col("payload_bytes") >= min_bytes)
    light = stash(read_arc(spark, arc_path, payloads=False).where(plain).drop("head", "payload", "mime", "ip", "kind"), "arc-records")
    number = F.expr("try_cast(key as decimal(38,0))")
    order = F.struct(F.col("key").isNull().alias("k0"), number.isNull().alias("k1"), number.alias("k2"), "key", "file", "at", "url", "date")
    firsts = light.groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("copies")).where("copies > 1")
    firsts = firsts.select("digest", *[F.col(f"f.{c}").alias(f"first_{c}") for c in ("file", "at", "url", "date")])
    copies = light.select("file", "at", "digest").join(firsts, "digest").drop("digest").where("file <> first_file or at <> first_at")
    r = read_arc(spark, arc_path).join(copies, ["file", "at"], "left")
    revisit = F.col("first_at").isNotNull()
    crlf = "\r\n"
    broken = F.col("kind") == "malformed"
    kind = F.when(revisit, "revisit").when(broken, "metadata").otherwise(F.col("kind"))
    mime = F.when(F.col("kind") == "response", "application/http; msgtype=response").when(F.col("kind") == "warcinfo", "application/warc-fields").when(broken, "application/octet-stream").otherwise(F.col("mime"))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    since = F.concat(
        F.lit(crlf + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + crlf + "WARC-Refers-To: <"), _urn("first_file", "first_at"),
        F.lit(">" + crlf + "WARC-Refers-To-Target-URI: "), "first_url", F.lit(crlf + "WARC-Refers-To-Date: "), _iso(F.col("first_date")),
    )
    uri = F.concat(F.lit("WARC-Target-URI: "), F.when(broken, F.concat(F.lit("urn:arc:malformed:"), F.col("at").cast("string"))).otherwise(F.col("url")), F.coalesce(F.concat(F.lit(crlf + "WARC-IP-Address: "), "ip"), F.lit("")))
    header = F.concat(
        F.lit("WARC/1.1" + crlf + "WARC-Type: "), kind, F.lit(crlf + "WARC-Record-ID: <"), _urn("file", "at"), F.lit(">" + crlf + "WARC-Date: "), _iso(F.coalesce("date", F.lit("1970"))),
        F.lit(crlf), F.when(F.col("kind") == "warcinfo", F.concat(F.lit("WARC-Filename: "), F.regexp_replace("url", "^filedesc:/*", ""))).otherwise(uri),
        F.lit(crlf + "WARC-Payload-Digest: sha1:"), "digest", F.when(revisit, since).otherwise(""), F.when(F.col("problem") == "cut short", crlf + "WARC-Truncated: unspecified").otherwise(""),
        F.lit(crlf + "Content-Type: "), mime, F.lit(crlf + "Content-Length: "), F.octet_length(block).cast("string"), F.lit(crlf + crlf),
    )
    r.select(F.concat(header.cast("binary"), block).cast("string").alias("value")).write.option("lineSep", crlf + crlf).option("compression", "gzip").text(warc_path)


_WARC_LINE = re.compile(rb"(?:\A|(?<=\n))WARC/[0-9]")
#: No record header is longer.
HEADER_BYTES = 1 << 20


def _warc_header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Headers of the record at ``at`` by lower-case name, and where its block
    begins; None if lines up to a blank one are no header with a length."""
    headers, name, end = {}, None, data.find(b"\n", at, at + HEADER_BYTES)
    while end >= 0:
        begin, end = end + 1, data.find(b"\n", end + 1, at + HEADER_BYTES)
        line = data[begin:end].rstrip(b"\r").decode("utf-8", "replace")
        if end >= 0 and not line:
            return (headers, end + 1) if headers.get("content-length", "").isdecimal() else None
        if line[:1] in (" ", "\t") and name:  # a folded line goes on
            headers[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            return None
        headers[name] = value.strip()
    return None


def parse_warc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """(offset, headers by lower-case name, block, problem) of each record, by declared lengths.

    Lines may end in CRLF or LF. No bytes are lost: where no header with a
    length stands, the bytes up to the next ``WARC/`` line are a record
    without headers, and its problem is ``no record header``. A declared
    length is right if blank lines and a record, or nothing, follow the block.
    Else the block ends at the next ``WARC/`` line, with the problem ``wrong
    length``, if that line comes before the declared end; a block that the end
    of the file cuts is what is there, with the problem ``cut short``.
    """
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        found = _warc_header(data, at) if _WARC_LINE.match(data, at) else None
        if found is None:
            after = _WARC_LINE.search(data, at + 1)
            to = after.start() if after else len(data)
            yield at, {}, data[at:to], "no record header"
            at = to
            continue
        headers, begin = found
        end, problem = begin + int(headers["content-length"]), None
        follows = data[end : end + 16].lstrip(b"\r\n")
        if end > len(data) or (follows and not follows.startswith(b"WARC/")):
            after = _WARC_LINE.search(data, begin, min(end, len(data)))
            problem = "wrong length" if after else "cut short" if end > len(data) else None
            end = after.start() if after else min(end, len(data))
        yield at, headers, data[begin:end], problem
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, url, date, key, digest, payload_bytes, refers, intact, problem) per record.

    Digest and size of a stored payload are those of the bytes read back;
    intact tells whether the header names the same digest. A revisit stores no
    payload: its digest is the one its header names, payload_bytes what its
    HTTP header declares, and intact is null. Bytes that are no record are
    rows of kind ``malformed``; ``problem`` is that of ``parse_warc``. A file
    of 2 GB or more is refused by Spark's reader of whole files.
    """
    names = ["record_id", "kind", "url", "date", "key", "digest", "payload_bytes", "refers", "intact", "problem"]
    kinds = [*[pa.string()] * 6, pa.int64(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                rows = []
                for _, h, block, problem in parse_warc(_bytes(content.as_py())):
                    head, payload = _split_http(block) if h else (b"", block)
                    kind = h.get("warc-type") if h else "malformed"
                    stored = kind != "revisit"
                    declared = _header(head, b"Content-Length")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = len(payload) if stored else int(declared) if declared and declared.isdecimal() else None
                    there = base32_sha1(payload) if stored else digest
                    rows.append((h.get("warc-record-id", "").strip("<>"), kind, h.get("warc-target-uri"), h.get("warc-date"), _header(head, b"X-Page-Id"), there, size, h.get("warc-refers-to", "").strip("<>") or None, there == digest if stored else None, problem))
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = "record_id string, kind string, url string, date string, key string, digest string, payload_bytes long, refers string, intact boolean, problem string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, arc_path: str, warc_path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) read
    back from the WARC files made of the ARC files made of ``pages``.

    refers_to is the key of the response that a revisit names; size and digest
    are recomputed from that response's payload, and intact tells whether all
    that is written about a payload agrees with it. Null html is an
    empty payload; a null id stays null and yields to others in being stored;
    repeated rows are records of their own. An empty table gives no rows.
    Other columns are not read. Records read back are counted against those
    written: a difference, or a record with a problem, is an error.
    """
    spark = pages.sparkSession
    written = write_arc(pages, arc_path, id_col, url_col, html_col)
    arc_to_warc(spark, arc_path, warc_path, min_bytes)
    kind = pages.schema[id_col].dataType.simpleString()
    records = stash(read_warc(spark, warc_path).where("kind <> 'warcinfo'"), "warc-records")
    back = records.agg(F.count("*").alias("n"), F.count("problem").alias("problems")).first()
    if (back.n, back.problems) != (written, 0):
        raise ValueError(f"{written} records were written; {back.n} came back, {back.problems} of them with a problem")
    named = records.where("refers is not null").select(F.col("refers").alias("record_id")).distinct()
    ids = records.where("kind = 'response'").join(named, "record_id", "left_semi")
    ids = ids.select(F.col("record_id").alias("r_"), F.col("key").alias("k_"), F.col("digest").alias("d_"), F.col("payload_bytes").alias("b_"))
    out = records.join(ids, F.col("refers") == F.col("r_"), "left")
    intact = F.coalesce("intact", (F.col("digest") == F.col("d_")) & (F.col("payload_bytes") == F.col("b_")), F.lit(False))
    return out.select(
        F.col("key").cast(kind).alias("page_id"), F.coalesce("b_", "payload_bytes").alias("payload_bytes"), F.coalesce("d_", "digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("k_").cast(kind).alias("refers_to"), "url", intact.alias("intact"),
    )
