"""Legacy archive converter: ARC files of either version become equivalent WARC files.

Archives are gzip files with one member per record. Readers stream them: memory holds one record,
never a whole archive. All files are written in the shared folder under a temporary name and
renamed, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicFile, drop_path, filesystem, saved, scratch

RECORDS_PER_ARCHIVE = 2000

# Field names of the URL record lines of the two ARC versions.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "archive string, ordinal long, url string, location string, payload_bytes long, payload_digest string"


def base32_sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def field(value) -> str:
    """A header field: only spaces and control characters are escaped, so what was escaped before stays as it is; `-` stands for none."""
    if value is None or value == "":
        return "-"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def member(data: bytes) -> bytes:
    """One gzip member, the same bytes each time."""
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def arc_head(version: str, name: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 rostrum\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    own = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20240101000000", "Content-type": "text/plain", "Result-code": "200", "Filename": name, "Archive-length": len(body)}
    return " ".join(str(own.get(f, "-")) for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_record(version: str, url, date: str, mime: str, body: bytes, location=None, name: str = "-") -> bytes:
    """One ARC record: its header line, the declared number of bytes, and a newline."""
    own = {"URL": field(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": field(mime), "Result-code": "200", "Location": field(location), "Filename": field(name), "Archive-length": len(body)}
    return " ".join(str(own.get(f, "-")) for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def read_arc(stream) -> Iterator[dict]:
    """Records of an ARC stream, parsed by the field list that its version block declares.

    Fields are counted from the right where a line has more words than fields (old URLs hold
    spaces). Blank lines between records are skipped. A length that is no number, or that goes
    past the end, raises ValueError.
    """
    fields, ordinal = ARC_FIELDS["1"], 0
    while line := stream.readline():
        if not line.strip():
            continue
        words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        own = fields
        if words[0].startswith("filedesc:"):
            own = ARC_FIELDS["1" if len(words) <= len(ARC_FIELDS["1"]) else "2"]
        extra = len(words) - len(own)
        if extra < 0 or not words[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:120]!r}")
        found = dict(zip(own, [" ".join(words[: extra + 1]), *words[extra + 1 :]], strict=True))
        body = stream.read(int(words[-1]))
        if len(body) != int(words[-1]):
            raise ValueError(f"the archive ends within {found['URL']}")
        if found["URL"].startswith("filedesc:"):
            declared = body.decode("utf-8", "replace").split("\n")
            version = declared[0].split(" ")[0]
            fields = declared[1].split() if len(declared) > 1 and declared[1].strip() else ARC_FIELDS[version]
            continue
        yield {"ordinal": ordinal, "fields": found, "body": body}
        ordinal += 1


def payload_of(body: bytes) -> bytes:
    """What follows the HTTP head, or all where there is none."""
    if body.startswith(b"HTTP/"):
        head, gap, rest = body.partition(b"\r\n\r\n")
        return rest if gap else body
    return body


def warc_date(arc_date: str) -> str:
    """YYYYMMDD[hhmmss] as an ISO instant; missing digits count as the start of the period."""
    digits = (re.sub(r"\D", "", arc_date) or "19700101")[:14]
    digits += "00000101000000"[len(digits) :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(archive: str, ordinal: int) -> str:
    """A WARC identifier that depends only on the record's place, so reruns give the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive.rsplit("/", 1)[-1]}#{ordinal}')}>"


def warc_record(kind: str, headers: dict, block: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers in lower case, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("the archive ends within a record")
        yield headers, block


def opened(uri: str):
    fs, path = filesystem(uri)
    return gzip.GzipFile(fileobj=fs.open_input_file(path), mode="rb")


def write_arc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", version: str = "2") -> DataFrame:
    """ARC archives of all rows of `pages`, some RECORDS_PER_ARCHIVE records each; returns (archive).

    Null html is an empty payload, a null url becomes `-`; repeated rows are kept as records.
    """
    def write(batches):
        from pyspark import TaskContext

        part, number, out, closing, count = TaskContext.get().partitionId(), 0, None, None, 0
        for frame in batches:
            for page, address, text in zip(frame["page"], frame["url"], frame["html"], strict=True):
                if out is None:
                    name = f"part-{part:05d}-{number:05d}.arc.gz"
                    closing = AtomicFile(f"{folder}/{name}")
                    out = closing.__enter__()
                    out.write(member(arc_head(version, name)))
                    number, count = number + 1, 0
                body = HTTP_HEAD + (text or "").encode("utf-8", "surrogatepass")
                out.write(member(arc_record(version, address, "20240101000000", "text/html", body, page, name)))
                count += 1
                if count >= RECORDS_PER_ARCHIVE:
                    closing.__exit__(None)
                    out = None
                    yield pd.DataFrame({"archive": [f"{folder}/{name}"]})
        if out is not None:
            closing.__exit__(None)
            yield pd.DataFrame({"archive": [f"{folder}/{name}"]})

    rows = pages.select(F.col(key).cast("string").alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    return saved(rows.mapInPandas(write, "archive string"), "arc-list")


def spread(archives: DataFrame) -> DataFrame:
    """One task for a few archives: the list itself is small."""
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(parts, "archive")


def convert_arc(archives: DataFrame, folder: str, revisit_min_bytes: int = 0) -> DataFrame:
    """Convert the ARC files listed in `archives` into WARC files in `folder`; returns (archive).

    Of records with equal payloads of at least `revisit_min_bytes`, the one with the smallest
    location (a number where it is one; without it last, then archive and place) becomes a
    response; the others become revisits that name it. Headers: WARC-Record-ID from the
    record's place, WARC-Date from the ARC date, Content-Type and target URI from its line, SHA-1
    block and payload digests.
    """
    def index(batches):
        for frame in batches:
            for archive in frame["archive"]:
                with opened(archive) as stream:
                    rows = [(archive, r["ordinal"], r["fields"]["URL"], r["fields"].get("Location"), len(p), base32_sha1(p)) for r in read_arc(stream) for p in [payload_of(r["body"])]]
                yield pd.DataFrame(rows, columns=["archive", "ordinal", "url", "location", "payload_bytes", "payload_digest"])

    found = saved(spread(archives).mapInPandas(index, INDEX), "arc-index")
    number = F.expr("try_cast(location as long)")
    place = F.struct(number.isNull().alias("none"), number.alias("number"), "location", "archive", "ordinal")
    first = found.filter(F.col("payload_bytes") >= revisit_min_bytes).groupBy("payload_digest").agg(F.min(place).alias("first"))
    plan = found.join(first, "payload_digest", "left").select(
        "archive", "ordinal",
        F.when((F.col("first.archive") != F.col("archive")) | (F.col("first.ordinal") != F.col("ordinal")), F.col("first")).alias("first"),
    )
    plan = plan.select("archive", "ordinal", F.col("first.archive").alias("first_archive"), F.col("first.ordinal").alias("first_ordinal"), F.col("first.location").alias("first_location"))

    def convert(frame):
        """One ARC file; its plan has a row for each record."""
        archive = frame["archive"].iloc[0]
        refers = {o: (a, int(n), p) for o, a, n, p in zip(frame["ordinal"], frame["first_archive"], frame["first_ordinal"].fillna(-1), frame["first_location"], strict=True) if isinstance(a, str)}
        name = re.sub(r"\.arc(\.gz)?$", "", archive.rsplit("/", 1)[1]) + ".warc.gz"
        with opened(archive) as stream, AtomicFile(f"{folder}/{name}") as out:
            block = f"software: rostrum\r\nformat: WARC File Format 1.0\r\nconverted-from: {archive.rsplit('/', 1)[1]}\r\n".encode()
            out.write(member(warc_record("warcinfo", {"WARC-Record-ID": record_id(archive, -1), "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Filename": name, "Content-Type": "application/warc-fields"}, block)))
            for record in read_arc(stream):
                own, body, ordinal = record["fields"], record["body"], record["ordinal"]
                payload = payload_of(body)
                is_http = payload is not body
                headers = {
                    "WARC-Record-ID": record_id(archive, ordinal),
                    "WARC-Date": warc_date(own["Archive-date"]),
                    "WARC-Target-URI": own["URL"],
                    "WARC-IP-Address": own["IP-address"],
                    "WARC-Payload-Digest": "sha1:" + base32_sha1(payload),
                    "X-Payload-Length": len(payload),
                    "X-Location": own.get("Location"),
                    "Content-Type": "application/http; msgtype=response" if is_http else own["Content-type"],
                }
                kind = "response" if is_http else "resource"
                if ordinal in refers:
                    a, n, location = refers[ordinal]
                    kind, body = "revisit", body[: len(body) - len(payload)]
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": record_id(a, n), "X-Refers-To-Location": location}
                out.write(member(warc_record(kind, headers | {"WARC-Block-Digest": "sha1:" + base32_sha1(body)}, body)))
        return pd.DataFrame({"archive": [f"{folder}/{name}"]})

    # an explicit count of partitions: archives are large although their plan rows are few
    return saved(spread(plan).groupBy("archive").applyInPandas(convert, "archive string"), "warc-list")


RECORDS = "archive string, record_id string, record_type string, url string, date string, location string, payload_bytes long, payload_digest string, refers_to string, refers_location string"


def warc_index(archives: DataFrame) -> DataFrame:
    """One row for each converted record, read from the WARC files; digests of blocks and payloads are checked."""
    def read(batches):
        for frame in batches:
            for archive in frame["archive"]:
                rows = []
                with opened(archive) as stream:
                    for h, block in read_warc(stream):
                        kind = h["warc-type"]
                        if kind == "warcinfo":
                            continue
                        if h["warc-block-digest"] != "sha1:" + base32_sha1(block):
                            raise ValueError(f"block digest of {h['warc-record-id']}")
                        length, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                        if kind != "revisit":
                            payload = payload_of(block)
                            if (len(payload), base32_sha1(payload)) != (length, digest):
                                raise ValueError(f"payload digest of {h['warc-record-id']}")
                        rows.append((archive, h["warc-record-id"], kind, h["warc-target-uri"], h["warc-date"], h.get("x-location"), length, digest, h.get("warc-refers-to"), h.get("x-refers-to-location")))
                yield pd.DataFrame(rows, columns=["archive", "record_id", "record_type", "url", "date", "location", "payload_bytes", "payload_digest", "refers_to", "refers_location"])

    return spread(archives).mapInPandas(read, RECORDS)


def convert_pages(spark: SparkSession, pages: DataFrame, revisit_min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of `pages`.

    Pages become ARC archives, those are converted, and the rows come from the WARC files. Of
    repeated page_ids with the same payload one is the response; a null page_id comes last.
    """
    folder = scratch(spark, "archives")
    arcs = write_arc(pages, folder + "/arc")
    warcs = convert_arc(arcs, folder + "/warc", revisit_min_bytes)
    drop_path(spark, folder + "/arc")
    page = lambda c: F.expr(f"try_cast({c} as long)")
    return warc_index(warcs).select(page("location").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_location").alias("refers_to"))
