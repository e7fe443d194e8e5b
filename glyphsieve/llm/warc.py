"""WARC archives: a writer that stores equal payloads once, and a sequential verifying reader.

Each record is a gzip member of its own.  The reader decompresses members incrementally, frames each record by
its Content-Length and holds the block and payload digests against what it has read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import pieces
from .storage import Scratch

#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: An archive file is closed once it has grown to this many bytes.
ARCHIVE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 18
_URN = "urn:x-page:"
#: A header longer than this is taken for a damaged one; addresses may be long.
MOST_HEADER = 1 << 26


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def record(page_id: str | None, uri: str | None, payload: bytes, refers_to: str | None, date: str, level: int = 6) -> bytes:
    """One gzip member: a response, or a revisit (headers only) of the page refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    about = hashlib.sha1(payload).hexdigest()[:16]  # so that pages which share an id have records of their own
    name = lambda x: f"<{_URN}{'' if x is None else quote(x, safe='')}:{about}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(uri, safe=":/?#[]@!$&'()*+,;=%-._~") if uri else f"{_URN}none"),
        ("WARC-Payload-Digest", sha1_32(payload)),
        ("WARC-Block-Digest", sha1_32(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    return _member(fields, block, level)


@dataclass
class Record:
    offset: int
    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    error: str | None = None

    @property
    def http_head(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[0]

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.fields.get("content-type", "").startswith("application/http") else self.block


def _parse_head(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("a record doesn't begin with its version")
    out, last = {}, ""
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def read_records(stream) -> Iterator[Record]:
    """The records of a .warc.gz stream in order.

    A record that breaks its framing has an error and whatever was read; so has a member that is cut short or
    damaged, after which nothing more can be framed and the reading ends.  What a member holds beyond its record is
    unpacked in small pieces and thrown away, so memory is bounded by the record's own length.
    """
    data, offset = stream.read(_CHUNK), 0
    while data:
        z, used, got = zlib.decompressobj(31), 0, bytearray()
        out, body, length = Record(offset), 0, None
        try:
            while not z.eof:
                if not data:
                    raise ValueError("a gzip member is cut short")
                seen = max(0, len(got) - 3)
                got += z.decompress(data, _CHUNK)
                left = z.unused_data if z.eof else z.unconsumed_tail
                used, data = used + len(data) - len(left), left
                if length is None and (end := got.find(b"\r\n\r\n", seen)) >= 0:
                    out.fields, body = _parse_head(bytes(got[:end])), end + 4
                    length = int(out.fields.get("content-length", "-1"))
                    if length < 0:
                        raise ValueError("no content length")
                if len(got) > (MOST_HEADER if length is None else body + length + 4):
                    if length is None:
                        raise ValueError("no end of the record's header")
                    out.error = "the member goes on after its record"
                    del got[body + length :]
                if not z.eof and not data:
                    data = stream.read(_CHUNK)
        except (ValueError, zlib.error) as why:
            out.error, out.block = str(why), bytes(got[body : body + length] if length else b"")
            yield out
            return
        if length is None:
            out.error = "no end of the record's header"
        else:
            out.block = bytes(got[body : body + length])
            if len(out.block) < length:
                out.error = "the record is shorter than its content length"
            elif out.error is None and got[body + length :] != b"\r\n\r\n":
                out.error = "no blank lines after the record"
        out.error = out.error or _verify(out)
        yield out
        offset += used
        data = data or stream.read(_CHUNK)


def _told(digest: str | None) -> bool:
    return bool(digest) and digest.startswith("sha1:")


def verified(r: Record) -> bool:
    """Were all its bytes held against a digest?  Digests of other kinds than SHA-1 tell nothing here."""
    return _told(r.fields.get("warc-block-digest"))


def _verify(r: Record) -> str | None:
    if (want := r.fields.get("warc-block-digest")) and want.startswith("sha1:") and sha1_32(r.block) != want:
        return "the block differs from its digest"
    if r.fields.get("warc-type") != "revisit" and (want := r.fields.get("warc-payload-digest")) and want.startswith("sha1:") and sha1_32(r.payload) != want:
        return "the payload differs from its digest"
    return None


#: Names that Hadoop has for stores, and those that Arrow has for them.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gs": "gs"}


def _open(path: str):
    """(file system, path in it) of a location as Spark writes it."""
    scheme, colon, rest = path.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{colon}{rest}")


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write one record per row into archives under folder -> the manifest (path, records, bytes).

    Of equal payloads of REVISIT_BYTES or more the row with the largest id is the response, and the others are
    revisits of it; null html is an empty payload.  A row with a null id is never the largest (if all are null,
    all are responses); rows that share the largest id are responses each; a null url gets a urn.  An archive's
    name holds a fresh uuid for each attempt, and only archives in the manifest count, so a repeated or lost
    task leaves no record twice.  Repeated rows are records of their own; rows of equal id below the largest each are
    revisits; an empty table gives an empty manifest; other columns are not read, whatever their names.  A page is
    written whole, as one record of one task, in some four times its bytes of memory.

    folder is any location that pyarrow.fs and all executors can reach: local paths, file, s3 (s3a too), gs, abfs, and
    hdfs where libhdfs is installed.  Credentials of such a store are Arrow's, from the environment, not Spark's.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    slim = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = slim.withColumns({"digest": F.sha2("html", 256), "n": F.octet_length("html")})
    tops = keyed.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest", "n").agg(F.max("id").alias("top"), F.count("*").alias("copies"))
    tops = scratch.write(tops.filter("copies > 1 and top is not null").select(F.col("digest").alias("d"), F.col("n").alias("m"), "top"), "tops")
    joined = keyed.join(tops, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")), "left")
    refers = F.when(F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("id")), F.col("top"))
    rows = joined.select(F.col("id").cast("string").alias("id"), "uri", refers.cast("string").alias("refers"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(folder)
        fs.create_dir(top, recursive=True)
        done, out, path, n = [], None, "", 0

        def close() -> None:
            nonlocal out
            if out is not None:
                size = out.tell()
                out.close()
                done.append((path, n, size))
                out = None

        for part, data, off in pieces(batches, "html"):
            raw = data.tobytes()
            columns = [part.column(i).to_pylist() for i in range(3)]
            for a, b, page, uri, refers_to in zip(off[:-1].tolist(), off[1:].tolist(), *columns):
                if out is None:
                    path, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{top}/{path}", compression=None)
                out.write(record(page, uri, raw[a:b], refers_to, date, level))
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x[0]}" for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["path", "records", "bytes"])

    return scratch.write(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


_OUT = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.string()), ("target_uri", pa.string())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("error", pa.string()), ("verified", pa.bool_()), ("payload", pa.binary())]
)


def _page(name: str | None) -> str | None:
    inner = (name or "").strip("<>")
    return unquote(inner.removeprefix(_URN).partition(":")[0]) or None if inner.startswith(_URN) else None


def _row(path: str, r: Record, payloads: bool) -> tuple:
    f, kind = r.fields, r.fields.get("warc-type")
    size, digest = len(r.payload), f.get("warc-payload-digest", "")
    if kind == "revisit":
        size = next((int(x[15:]) for x in r.http_head.decode("latin-1").lower().split("\r\n") if x.startswith("content-length:") and x[15:].strip().isdigit()), None)
    try:
        digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    except ValueError:
        digest = None
    return path, r.offset, kind, f.get("warc-record-id"), _page(f.get("warc-record-id")), f.get("warc-target-uri"), size, digest, _page(f.get("warc-refers-to")), r.error, verified(r), r.payload if payloads and kind != "revisit" else None


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """paths (path string) -> a row for each record, read in sequence, one task or less for each archive.

    payload_bytes and payload_digest (lower-case hex) speak of the full payload, for revisits too; error is null
    for records whose framing and digests hold, and verified says whether there was a digest to hold.  An empty table
    of paths, or an empty archive, gives no rows, nor does a null path; a path given twice gives its records twice.
    A record is held whole, with its header of up to MOST_HEADER bytes.  Columns other than path are not read.
    """
    paths = paths.filter("path is not null")
    files = paths.select("path").repartition(max(1, min(paths.count(), 100_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _open(path)
                with fs.open_input_stream(at, compression=None, buffer_size=_CHUNK) as stream:
                    for r in read_records(stream):
                        held.append(_row(path, r, payloads))
                        size += 200 + len(r.block) * payloads
                        if size > 4 << 20:
                            yield _batch(held)
                            held, size = [], 0
        if held:
            yield _batch(held)

    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean"}
    return files.mapInArrow(run, ", ".join(f"{x.name} {kinds[x.type]}" for x in _OUT))


def check_revisits(records: DataFrame) -> DataFrame:
    """records, with an error where a revisit's digest or length is not that of a response that it names.

    The archives are read once, into a table; each kind of revisit is looked up once, however often it occurs.
    """
    scratch = Scratch(records.sparkSession, "revisits")
    records = scratch.write(records, "records")
    about = ("payload_digest", "payload_bytes")
    there = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *about).distinct().withColumn("known", F.lit(True))
    asked = records.filter("record_type = 'revisit'").select("refers_to", *about).distinct()
    unknown = asked.join(there, ["refers_to", *about], "left_anti").select(*[F.col(c).alias(f"u_{c}") for c in ("refers_to", *about)])
    unknown = scratch.write(unknown, "unknown")
    wrong = (F.col("record_type") == "revisit") & F.col("refers_to").eqNullSafe(F.col("u_refers_to")) & F.col("payload_digest").eqNullSafe(F.col("u_payload_digest")) & F.col("payload_bytes").eqNullSafe(F.col("u_payload_bytes"))
    if not unknown.head(1):
        return records
    told = F.when(F.col("u_payload_digest").isNotNull() | F.col("u_refers_to").isNotNull(), "the revisit differs from the response that it names")
    return records.join(unknown, wrong, "left").select(*[F.coalesce("error", told).alias(c) if c == "error" else c for c in records.columns])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _OUT)], schema=_OUT)


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder for archives in the shared folder."""
    return Scratch(spark, "archives").root
