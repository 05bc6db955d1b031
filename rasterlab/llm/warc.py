"""WARC archives compressed record by record with a Zstandard dictionary that each archive carries.

An archive (``.warc.zst``) starts with a skippable frame that holds the dictionary (itself compressed), then
one frame per record: a ``warcinfo``, then the pages. The dictionary is trained on a bounded sample of the
pages to be archived: about ``SAMPLE_RECORDS`` picked by hash, ``SAMPLE_BYTES`` of each at most, as WARC
records. Fewer than ``LEAST_PIECES`` pieces train none, and archives then have no leading frame, which
readers accept; nothing but sizes depends on it.

Every task writes archives of its own in the shared folder and returns their names; the stored list of names
is the commit, so what a lost task left is never read. Readers stream an archive a frame at a time.

Of pages with equal payloads of ``REVISIT_BYTES`` or more the one with the largest page_id is a response and
the others are revisits of it, which keep the HTTP headers only. Rows that share the largest page_id are
responses each. A null html is an empty payload; a null page_id is smaller than any other, and pages with
equal payloads and no page_id at all are responses. Repeated rows are repeated records. Null urls get the
record's own name as target. No pages give no archives.
"""

import hashlib
import struct
import urllib.parse
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlab.llm.common import keep_until_dropped, pick, stash
from rasterlab.session import broadcast_if_small, checkpoint_root

REVISIT_BYTES = 1000
DICTIONARY_BYTES = 1 << 16
SAMPLE_RECORDS = 512
SAMPLE_BYTES = 8192
PIECE = 1024              # bytes of a training sample
LEAST_PIECES = 16
ARCHIVE_BYTES = 1 << 30   # a task begins another archive beyond this
CHUNK = 1 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# fixed values of the formats
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

READ_DDL = ("page_id long, record_type string, target_uri string, payload binary, payload_bytes long, "
            "payload_digest string, refers_to long")


def record_name(page_id: int | None, sha1: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{sha1}>"


def _page_of(name: str) -> int | None:
    number = name.strip("<>").split(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A WARC record; ``response``: the page that a revisit refers to."""
    sha1 = hashlib.sha1(payload).hexdigest()
    name = record_name(page_id, sha1)
    target = urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else name.strip("<>")
    http = HTTP.format(len(payload)).encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(response, sha1)}"]
    return _framed(head + ["Content-Type: application/http;msgtype=response"], block)


def _framed(head: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; raises if it is cut or followed by more."""
    end = raw.index(b"\r\n\r\n")
    version, *lines = raw[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    size = int(head["content-length"])
    block = raw[end + 4:end + 4 + size]
    if len(block) != size or raw[end + 4 + size:] != b"\r\n\r\n":
        raise ValueError(f"record {head.get('warc-record-id')} is cut")
    return head, block


def _page(raw: bytes) -> tuple | None:
    """The row of a response or revisit, None for other records; raises if a payload is not what its digest says."""
    head, block = parse(raw)
    kind = head["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in block[:cut - 4].decode().split("\r\n")[1:])
    size, digest = int(http["Content-Length"]), head["warc-payload-digest"].removeprefix("sha1:")
    payload, refers = None, None
    if kind == "response":
        payload = block[cut:]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {head['warc-record-id']} does not hold its payload")
    else:
        refers = _page_of(head["warc-refers-to"])
    return _page_of(head["warc-record-id"]), kind, head["warc-target-uri"], payload, size, digest, refers


def trained(samples: list[bytes]) -> bytes | None:
    """A dictionary from records, None if they are too few."""
    pieces = [s[at:at + PIECE] for s in samples for at in range(0, len(s), PIECE)]
    if len(pieces) < LEAST_PIECES:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 4)), pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # nothing repeats
        return None


def leading_frame(dictionary: bytes | None) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def records(stream):
    """The raw records of an open archive, one frame at a time."""
    rest, dictionary = stream.read(8), None
    if len(rest) == 8 and struct.unpack("<II", rest)[0] == SKIPPABLE:
        size = struct.unpack("<II", rest)[1]
        held = b""
        while len(held) < size:
            if not (got := stream.read(size - len(held))):
                raise ValueError("the archive ends inside its dictionary")
            held += got
        if held[:4] == struct.pack("<I", FRAME):
            held = zstandard.ZstdDecompressor().decompress(held)
        dictionary, rest = zstandard.ZstdCompressionDict(held), b""
    reader, parts, now = zstandard.ZstdDecompressor(dict_data=dictionary), [], None
    while True:
        if not rest and not (rest := stream.read(CHUNK)):
            if now is not None:
                raise ValueError("the archive ends inside a record")
            return
        now = now or reader.decompressobj()
        parts.append(now.decompress(rest))
        rest = b""
        if now.eof:
            rest = now.unused_data
            yield b"".join(parts)
            parts, now = [], None


def _opened(folder: str):
    """File system and path of a folder named by a path or URI."""
    uri = urllib.parse.urlparse(folder)
    if uri.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), uri.path
    return pyarrow.fs.FileSystem.from_uri(folder)


def pages_with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, response (the page referred to), revisit of every row."""
    p = pick(pages, page_id="long", url="string", html="string").select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    keyed = p.withColumn("same", F.when(large, F.sha2("payload", 256)))
    groups = stash(keyed.where("same is not null").groupBy("same").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
                   .where("n > 1 and response is not null").drop("n"))
    # a hot payload is on the streamed side of the join, which Spark can split
    return keyed.join(broadcast_if_small(groups), "same", "left").select(
        "page_id", "url", "payload", "response", (F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("revisit"))


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) in the shared folder: file, records, bytes of every archive."""
    spark = pages.sparkSession
    rows = pages_with_roles(pages)
    chance = F.pmod(F.xxhash64("page_id", "url", "payload"), F.lit(max(1, pages.count()))) < SAMPLE_RECORDS
    sample = rows.where(chance & ~F.col("revisit")).limit(2 * SAMPLE_RECORDS).select(
        "page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")).collect()
    dictionary = trained([record(r.page_id, r.url, bytes(r.payload), None, False, date) for r in sample])
    lead = leading_frame(dictionary)
    folder = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"

    def archive(batches):
        fs, path = _opened(folder)
        fs.create_dir(path, recursive=True)  # where the file system has folders
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        out, done = None, []
        for b in batches:
            for page_id, url, payload, response, revisit in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(_opened(name)[1], compression=None)  # the name would have it compressed again
                    done.append([name, 0, 0])
                    first = packer.compress(_framed(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}",
                                                     "Content-Type: application/warc-fields"], b"software: rasterlab\r\n"))
                    out.write(lead + first)
                    done[-1][2] += len(lead) + len(first)
                frame = packer.compress(record(page_id, url, payload, response, revisit, date))
                out.write(frame)
                done[-1][1] += 1
                done[-1][2] += len(frame)
                if done[-1][2] >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"file": [d[0] for d in done], "records": pa.array([d[1] for d in done], pa.int64()),
                                          "bytes": pa.array([d[2] for d in done], pa.int64())},
                                         schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
    keep_until_dropped(spark, folder)
    return stash(rows.mapInArrow(archive, "file string, records long, bytes long"))


def read(archives: DataFrame) -> DataFrame:
    """The pages in archives (a table with their ``file``): page_id, record_type, target_uri, payload (null for a
    revisit), payload_bytes, payload_digest, refers_to. Every payload is held against its digest."""
    names = archives.select(F.col("file").cast("string").alias("file"))
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload", pa.binary()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def stream(batches):
        held, size = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = _opened(name)
                with fs.open_input_stream(path, compression=None) as f:
                    for raw in records(f):
                        if row := _page(raw):
                            held.append(row)
                            size += len(raw)
                        if size > 8 * CHUNK or len(held) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
    n = max(1, archives.count())
    return names.repartitionByRange(n, "file").mapInArrow(stream, READ_DDL)


def roundtrip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the written archives."""
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
r AS (SELECT page_id, body, octet_length(encode(body)) AS size, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN size >= {REVISIT_BYTES} AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= {REVISIT_BYTES} AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM r
"""
