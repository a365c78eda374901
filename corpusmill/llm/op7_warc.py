"""Legacy archive converter: ARC in, WARC out, and WARC read back.

An ARC file begins with a version block (`filedesc://` record) that names version 1 or 2; the
version says which fields a record's header line has.  Each record declares its length.  The
converter parses both versions and synthesises what WARC wants beyond that: a record identifier
(from a digest of the whole record, so reruns agree), a timestamp, a record type, and block and
payload digests.

Records of equal payloads of at least 100 bytes are written once: that with the smallest page
number is a response, others are revisits of it that keep only their HTTP header.

Archives are written once, to the folder that the cluster shares, and everything after reads these
files: rows that came in another order would make other identifiers.  Which record is a revisit is
decided on narrow rows (digest, page number) with partial aggregation, so a payload that a third of
all pages share is no hot spot, and payloads are never shuffled.  Files are listed in manifests,
tables that are complete when the tasks are done: files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

ARCHIVE_BYTES = 4 << 20
WARC_FILE_BYTES = 16 << 20
MIN_REVISIT_BYTES = 100
CAPTURED = "20000101000000"

# The fields of a record's header line by ARC version, as the version block spells them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


# ---------------------------------------------------------------- ARC


def version_block(name: str, version: int, date: str = CAPTURED) -> bytes:
    body = f"{version} 0 origin\n{FIELDS[version]}\n".encode()
    fields = ["filedesc://" + name, "0.0.0.0", date, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, block: bytes, name: str, offset: int, date: str = CAPTURED, ip: str = "0.0.0.0", mime: str = "text/html") -> bytes:
    url = re.sub(r"[\s]", "%20", url) or "-"
    fields = [url, ip, date, mime]
    if version == 2:
        fields += ["200", hashlib.md5(block).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(block))]).encode("utf-8", "surrogatepass") + b"\n" + block + b"\n"


def http_block(payload: bytes, page_id: int | None) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def as_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write `pages` (page_id, url, html) as ARC files of about 4 MB, gzipped by record, to `folder` (a URI).

    Pages with an even number go to files of version 1, the others to version 2.  Returns the
    manifest (file), which is stored: files of lost or repeated attempts aren't in it.
    """

    def run(batches):
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        open_ones: dict[int, list] = {}  # by version: name, parts, bytes

        def done(version):
            name, parts, _ = open_ones.pop(version)
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(b"".join(parts))
            return pa.RecordBatch.from_pydict({"file": [name]})

        for batch in batches:
            for page, url, html in zip(*batch.columns):
                page, url = page.as_py(), url.as_py() or ""
                version = 1 + (page or 0) % 2
                if version not in open_ones:
                    name = f"{uuid.uuid4().hex}.arc.gz"
                    head = gzipped(version_block(name, version), 1)
                    open_ones[version] = [name, [head], len(head)]
                own = open_ones[version]
                block = http_block((html.as_py() or "").encode("utf-8", "surrogatepass"), page)
                record = gzipped(arc_record(version, url, block, own[0], own[2]), 1)
                own[1].append(record)
                own[2] += len(record)
                if own[2] >= ARCHIVE_BYTES:
                    yield done(version)
        for version in sorted(open_ones):
            yield done(version)

    files, base = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    return cut(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "file string"))


def contents(folder: str, names) -> bytes:
    """Contents of some of a folder's files, one after the other."""
    files, base = pyarrow.fs.FileSystem.from_uri(folder)
    for name in names:
        with files.open_input_stream(f"{base}/{name}", compression=None) as f:
            yield f.read()


def dealt(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest over as many tasks as a shuffle has: each reads whole files, so a few bytes here are much work."""
    # not by file: a join by file before it would make this shuffle superfluous, and leave the rows in one task
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def members(data) -> bytes:
    """Pieces of a file in order: of gzip members their content, else the whole."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(view):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            chunk = view[at : at + (1 << 16)]
            if not len(chunk):
                raise ValueError("a gzip member ends early")
            out.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
        yield b"".join(out)


def arc_records(data: bytes):
    """(url, ip, date, mime, header line, block) of each record of an ARC file, plain or gzipped by record.

    A file that doesn't begin with a version block of version 1 or 2, or that ends inside a record, is an error.
    """
    data = b"".join(members(data))
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)]
        # the version block's own fields are those of its version; its length is last in either
        count = 10 if version == 2 else 5
        fields = line.decode("utf-8", "surrogateescape").rsplit(" ", count - 1 if version else -1)
        length = int(fields[-1])
        block = data[end + 1 : end + 1 + length]
        if end < 0 or len(block) < length:
            raise ValueError(f"the archive ends inside a record at byte {at}")
        at = end + 1 + length
        if version is None:
            if not line.startswith(b"filedesc:"):
                raise ValueError("the archive has no version block")
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        if len(fields) != count:
            raise ValueError(f"a version {version} record has {len(fields)} fields")
        yield fields[0], fields[1], fields[2], fields[3], line, block


# ---------------------------------------------------------------- WARC


def split_http(url: str, block: bytes) -> tuple[bytes, bytes, str]:
    """(HTTP header, payload, record type): a response only if it came over HTTP and has a status line."""
    if re.match("https?:", url, re.I) and block.startswith(b"HTTP/"):
        head, blank, payload = block.partition(b"\r\n\r\n")
        return head + blank, payload, "response"
    return b"", block, "resource"


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^%s:[ \t]*([^\r\n]*)" % re.escape(name.encode()), head)
    return found[1].decode("latin-1").strip() if found else None


def warc_date(date: str) -> str:
    """14 digits (or fewer: the rest is the start of the year, day and so on) as WARC's form of ISO 8601."""
    d = re.sub(r"\D", "", date)[:14]
    d += "00000101000000"[len(d) :] if len(d) >= 4 else CAPTURED[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(line: bytes, block: bytes) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(line + bytes(1) + block).digest()[:16], version=4)}"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def gzipped(record: bytes, level: int = 6) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def warc_fields(url: str, ip: str, date: str, kind: str, identifier: str, digest: str, block: bytes) -> list[tuple[str, str]]:
    mime = {"resource": "application/octet-stream"}.get(kind, "application/http; msgtype=response")
    return [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{identifier}>"), ("WARC-Date", warc_date(date)), ("WARC-Target-URI", url),
        ("WARC-IP-Address", ip), ("WARC-Payload-Digest", "sha256:" + digest), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("Content-Type", mime),
    ]


def converted(content: bytes):
    """(page number or None, digest, payload bytes, record identifier, kind, url, ip, date, header, block) of each record of an ARC file."""
    for url, ip, date, _, line, block in arc_records(content):
        head, payload, kind = split_http(url, block)
        page = http_field(head, "X-Page-Id")
        yield int(page) if page else None, hashlib.sha256(payload).hexdigest(), len(payload), record_id(line, block), kind, url, ip, date, head, block


def parsed(folder: str, manifest: DataFrame) -> DataFrame:
    """(file, number, page_id, digest, n, record_id, kind): a narrow row for each record of the ARC files that a manifest lists."""
    names = ["file", "number", "page_id", "digest", "n", "record_id", "kind"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            for name, content in zip(own, contents(folder, own)):
                rows = [(name, i, *r[:5]) for i, r in enumerate(converted(content))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return dealt(manifest.select("file")).mapInArrow(run, "file string, number int, page_id long, digest string, n long, record_id string, kind string")


def write_warc(archives: str, manifest: DataFrame, folder: str) -> DataFrame:
    """Convert the ARC files of a manifest to gzipped WARC files in `folder` (a URI); returns the manifest of these.

    Which records are revisits is decided on narrow rows, and told to the task that converts their
    file as a list that is no longer than the file's records; no payload is shuffled.
    """
    narrow = cut(parsed(archives, manifest))
    first = (
        narrow.where((F.col("n") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull() & (F.col("kind") == "response"))
        .groupBy("digest").agg(F.min(F.struct("page_id", "record_id")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    )
    revisits = narrow.join(first, "digest").where("page_id > first.page_id")
    told = revisits.groupBy("file").agg(F.collect_list(F.struct("number", F.col("first.record_id").alias("to"))).alias("revisits"))
    rows = dealt(manifest.join(told, "file", "left").select("file", "revisits"))

    def run(batches):
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        out = name = None
        size = 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name]})

        for batch in batches:
            own = batch.column(0).to_pylist()
            for content, revisits in zip(contents(archives, own), batch.column(1).to_pylist()):
                refers = {r["number"]: r["to"] for r in revisits or ()}
                for i, (_, digest, _, identifier, kind, url, ip, date, head, block) in enumerate(converted(content)):
                    more = []
                    if i in refers:
                        # another identifier than the response it would have been
                        identifier = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, identifier + ' ' + refers[i])}"
                        kind, block = "revisit", head
                        more = [("WARC-Refers-To", f"<{refers[i]}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
                    record = gzipped(warc_record(warc_fields(url, ip, date, kind, identifier, digest, block) + more, block))
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(record)
                    size += len(record)
                    if size >= WARC_FILE_BYTES:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    files, base = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    return cut(rows.mapInArrow(run, "file string"))


def warc_records(data):
    """(header as a dict with lower-case names, block) of each record of a WARC file, plain or gzipped by record."""
    for piece in members(data):
        at = 0
        while at < len(piece):
            end = piece.index(b"\r\n\r\n", at)
            lines = piece[at:end].decode("utf-8", "surrogateescape").split("\r\n")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(head["content-length"])
            block = piece[end + 4 : end + 4 + n]
            if not lines[0].startswith("WARC/") or len(block) < n:
                raise ValueError("a WARC record is broken")
            yield head, block
            at = end + 4 + n + 4


def read_warc(folder: str, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, record_id, refers_to (a record id) of the records in the WARC files that a manifest lists.

    Digests of blocks and of full payloads are checked against the declared ones; a difference is an
    error.  A revisit's payload size is what its HTTP header declares.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to string"

    def run(batches):
        for batch in batches:
            for content in contents(folder, batch.column(0).to_pylist()):
                rows = []
                for head, block in warc_records(content):
                    if head["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                        raise ValueError(f"{head['warc-record-id']}: the block is not what its digest says")
                    http, payload, _ = split_http(head["warc-target-uri"], block)
                    digest, n = head["warc-payload-digest"].partition(":")[2], len(payload)
                    if head["warc-type"] == "revisit":
                        n = int(http_field(block, "Content-Length"))
                    elif digest != hashlib.sha256(payload).hexdigest():
                        raise ValueError(f"{head['warc-record-id']}: the payload is not what its digest says")
                    page = http_field(http, "X-Page-Id")
                    rows.append((int(page) if page else None, n, digest, head["warc-type"], head["warc-record-id"].strip("<>"), head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None))
                columns = list(zip(*rows)) if rows else [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to"])

    return dealt(manifest.select("file")).mapInArrow(run, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write `pages` (page_id, url, html) to WARC by way of ARC, and return what the WARC files hold.

    page_id, payload_bytes, payload_digest, record_type (response or revisit) and refers_to (the
    response's page_id, for revisits).  Null html is an empty payload; a null url, or one
    that isn't of the web, is replaced by one made from the page number; null page numbers are kept,
    are never revisits and are never referred to.  Rows that repeat page number and payload are of one type.
    Very long payloads are written whole.  Extra columns are ignored; an empty table gives an empty
    result.
    """
    spark = pages.sparkSession
    # the converter takes http records: pages without a usable address get one of their own
    own = F.concat(F.lit("http://page.invalid/"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")))
    url = F.when(F.lower("url").rlike("^https?:"), F.col("url")).otherwise(own)
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = as_archives(pages.select("page_id", url.alias("url"), "html"), f"{base}/arc")
    found = read_warc(f"{base}/warc", write_warc(f"{base}/arc", archives, f"{base}/warc"))
    target = found.where("record_type <> 'revisit'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page")).distinct()
    whole = found.join(target, found.refers_to == target["_id"], "left")
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("_page").alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f"""

QUERIES = {"op7_warc": query}
ORACLES = {"op7_warc": SQL}
