"""Legacy web archives (ARC, versions 1 and 2) to WARC 1.1.

An ARC file is a version block and then records: a header line, whose fields depend on the
version, and as many bytes as its last field declares. The converter parses these, and
synthesises what WARC asks for: a record id derived from the record's own identity, an
ISO 8601 date, a type, and SHA-1 digests of block and payload. Records whose payload
another record has too become revisits of it.

WARC files are written by Spark's text sink: a record is one value and the two line ends
that close a record are the separator, so bytes pass unchanged; each part is one gzip file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, salted_lookup, shared_dir, small_batches

#: Bytes after which the query's ARC writer begins a new archive.
ARC_BYTES = 1 << 17
#: Records of a WARC file at most, and the bytes that a file has about, going by the mean record.
RECORDS_A_FILE, FILE_BYTES = 5_000, 64 << 20

#: Fields of a record's header line by ARC version, and the name of the version block.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
ARC_BLOCK = b"filedesc://"

RECORDS = (
    "archive string, number int, record_id string, url string, ip string, date string, mime string, type string, "
    "head binary, payload binary, payload_bytes long, payload_digest string, block_digest string, head_digest string"
)


def sha1(*parts: bytes) -> str:
    """Bare upper-case base32, as in WARC digests."""
    digest = hashlib.sha1()
    for part in parts:
        digest.update(part)
    return base64.b32encode(digest.digest()).decode()


def iso_date(stamp: str) -> str:
    """An ARC date of 4 to 14 digits as an ISO date in UTC; what is missing counts as the beginning."""
    digits = "".join(c for c in stamp if c.isdigit())[:14]
    full = digits + "00000101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of every record after the version block.

    A header line that lacks fields, or a length beyond the end of the archive, is an error
    that names the place.
    """
    version, at = 1, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # records are parted by a line end
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "surrogateescape")
        first = line.startswith(ARC_BLOCK.decode())
        names = ARC_FIELDS[1] if first and len(line.split(" ")) <= 5 else ARC_FIELDS[version]
        fields = line.rsplit(" ", len(names) - 1)
        if end < 0 or len(fields) != len(names) or not fields[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {line[:80]!r}")
        start, length = end + 1, int(fields[-1])
        if start + length > len(data):
            raise ValueError(f"the record at byte {at} declares {length} bytes and has {len(data) - start}")
        content = data[start : start + length]
        at = start + length
        if first:
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
        else:
            yield dict(zip(names, fields, strict=True)), content


def split_http(url: str, content: bytes) -> tuple[bytes, bytes]:
    """An HTTP response's head, empty line included, and its payload; other content is all payload."""
    if url.startswith("http") and content.startswith(b"HTTP/"):
        for gap in (b"\r\n\r\n", b"\n\n"):
            if (end := content.find(gap)) >= 0:
                return content[: end + len(gap)], content[end + len(gap) :]
    return b"", content


def convert(archives: DataFrame, name: str = "archive", content: str = "content") -> DataFrame:
    """The records of ARC archives, given as rows of name and bytes, with the columns of RECORDS.

    Empty and null archives have none. HTTP responses are of type response, all others resources. A record's id follows from
    its url, date, head and payload, so it is the same wherever its archive stands or is cut; repeated records share one.
    """
    small_batches(archives.sparkSession)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["archive"], batch["content"], strict=True):
                rows = []
                for number, (fields, body) in enumerate(parse_arc(bytes(data)) if data is not None else []):
                    url = fields["URL"]
                    head, payload = split_http(url, body)
                    date, digest, block, own = iso_date(fields["Archive-date"]), sha1(payload), sha1(body), sha1(head)
                    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {block} {own}")
                    rows.append((archive, number, f"<urn:uuid:{rid}>", url, fields["IP-address"], date, fields["Content-type"], "response" if head else "resource", head, payload, len(payload), digest, block, own))
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RECORDS.split(", ")])

    return archives.select(F.col(name).cast("string").alias("archive"), F.col(content).alias("content")).mapInPandas(parse, RECORDS)


def mark_revisits(records: DataFrame, order: Column, min_bytes: int = 0) -> DataFrame:
    """Adds `order`, and for records whose payload of at least `min_bytes` another has too, `original`:
    the id of the record with the largest order among them, null for that one itself (and its equals) and for unique ones.

    Null orders come before all others. The most common payload may be any share of the rows:
    digests are counted map-side first and the join with their counts is salted.
    """
    records = records.withColumn("order", order).withColumn("_digest", F.concat_ws(":", "payload_digest", "payload_bytes"))
    stats = materialise(records.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("order", "record_id")).alias("_last")), "digests")
    joined = salted_lookup(records, stats, "_digest", "_n", ["order", "record_id"])
    repeats = (F.col("_n") > 1) & (F.col("payload_bytes") >= min_bytes) & ~F.col("order").eqNullSafe(F.col("_last.order"))
    return joined.withColumn("original", F.when(repeats, F.col("_last.record_id"))).withColumn("repeats", repeats).drop("_digest", "_n", "_last")


def warc_text(records: DataFrame) -> DataFrame:
    """One WARC record per row in `value`, without the two line ends that close it."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    revisit = F.col("repeats")
    length = F.octet_length("head") + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("type"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.when(F.col("ip") != "0.0.0.0", F.col("ip"))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.when(revisit, F.col("original"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("head_digest")).otherwise(F.col("block_digest")))),
        line("Content-Type", F.when(F.octet_length("head") > 0, "application/http; msgtype=response").otherwise(F.col("mime"))),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    body = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    return records.select(F.concat(header.cast("binary"), body).cast("string").alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """One record after the other, in files of at most RECORDS_A_FILE and about FILE_BYTES, each one gzip member."""
    mean = records.agg(F.avg(F.octet_length("head") + F.col("payload_bytes"))).first()[0] or 1.0
    most = max(1, min(RECORDS_A_FILE, int(FILE_BYTES / max(mean, 1.0))))
    warc_text(records).write.option("maxRecordsPerFile", most).option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_warc(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with names in lower case, and block of every record, by declared lengths."""
    while True:
        line = file.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        fields = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        block = file.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError(f"the record {fields.get('warc-record-id')} is cut short")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip-compressed or plain WARC files: headers as a map, head of an HTTP message, payload length and
    digest, and whether the block has the digest that its header says. Files are decompressed in a stream."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                stream = io.BytesIO(data)
                file = gzip.GzipFile(fileobj=stream) if data[:2] == b"\x1f\x8b" else stream
                rows = []
                for fields, block in parse_warc(file):
                    head, payload = split_http(fields.get("warc-target-uri", ""), block)
                    rows.append((fields, head.decode("utf-8", "replace"), len(payload), sha1(payload), fields.get("warc-block-digest") == f"sha1:{sha1(block)}"))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=["headers", "head", "payload_bytes", "payload_digest", "intact"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["headers", "head", "payload_bytes", "payload_digest", "intact"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, "headers map<string,string>, head string, payload_bytes long, payload_digest string, intact boolean")


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """Pages as ARC archives of both versions in turn: rows of `archive` and `content`.

    A null html is an empty payload; a null url becomes http://invalid/; blanks and controls
    in urls are escaped; the page's id travels as an HTTP header, left out where it is null.
    """
    small_batches(pages.sparkSession)

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count, size, held, version = f"pages-{TaskContext.get().partitionId():06d}", 0, 0, [], 1

        def close() -> pd.DataFrame:
            name = f"{part}-{count:05d}.arc"
            body = f"{version} 0 lotwise\n{' '.join(ARC_FIELDS[version])}\n".encode()
            head = f"filedesc://{name} 0.0.0.0 20240101000000 text/plain {len(body)}\n".encode()
            return pd.DataFrame({"archive": [name], "content": [head + body + b"\n".join([b"", *held])]})

        for batch in batches:
            for page, url, html in zip(batch["page"], batch["url"], batch["html"], strict=True):
                payload = html or b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                head += "" if page is None else f"X-Page-Id: {page}\r\n"
                block = head.encode() + b"\r\n" + payload
                safe = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else ""
                safe = safe if safe.startswith("http") else "http://invalid/" + safe
                extra = "" if version == 1 else f"200 - - {size} {part}-{count:05d}.arc "
                held.append(f"{safe} 0.0.0.0 20240101000000 text/html {extra}{len(block)}\n".encode() + block)
                size += len(block)
                if size >= ARC_BYTES:
                    yield close()
                    count, size, held, version = count + 1, 0, [], 3 - version
        if held:
            yield close()

    shape = pages.select(F.col("page_id").cast("string").alias("page"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    return shape.mapInPandas(render, "archive string, content binary")


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an ARC archive into a WARC file in the shared folder and back.

    Of equal payloads the largest page_id is the response; rows that repeat it are responses too.
    """
    # stored once: what is marked below is what was counted, however often and in whatever pieces pages would be read again
    records = materialise(convert(pages_to_arc(read_table(spark, sf_dir, "pages"))), "converted")
    page = F.regexp_extract(F.col("head").cast("string"), r"X-Page-Id: (-?\d+)\r\n", 1)
    marked = mark_revisits(records, F.when(page != "", page.cast("long")))
    path = f"{shared_dir(spark)}/warc"
    write_warc(marked, path)
    back = read_warc(spark, path)
    found = F.regexp_extract("head", r"X-Page-Id: (-?\d+)\r\n", 1)
    length = F.regexp_extract("head", r"Content-Length: (\d+)\r\n", 1)
    rows = back.select(
        F.when(found != "", found.cast("long")).alias("page_id"),
        length.cast("long").alias("payload_bytes"),
        F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha1:", "").alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        "intact",
        F.col("headers")["warc-record-id"].alias("record_id"),
        F.col("headers")["warc-refers-to"].alias("refers"),
    )
    rows = materialise(rows, "records")
    # very many revisits may refer to one record: their number is counted map-side first and the join is salted
    revisits = rows.where(F.col("refers").isNotNull())
    targets = rows.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to")).distinct()
    targets = targets.join(revisits.groupBy("refers").agg(F.count(F.lit(1)).alias("n")), "refers")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    named = salted_lookup(revisits, targets, "refers", "n", ["record_id"], how="left").select(*columns)
    return rows.where(F.col("refers").isNull()).withColumn("refers_to", F.lit(None).cast("long")).select(*columns).union(named)
