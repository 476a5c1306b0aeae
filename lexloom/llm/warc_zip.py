"""WARC records in ZIP-packaged archives: a writer, and a reader by ranges without extraction.

An archive is a ZIP file with two stored members, as web archive collections have them:
``archive/data.warc.gz``, one gzip member a record, and ``indexes/index.cdxj``, one line a record
(sort key, time stamp, JSON with offset and length in the former). The reader reads the end of the
file for the central directory (ZIP64 records where the 32-bit fields are full), finds a member's
bytes behind its local header, reads the indexes and then the ranges of records they tell. It takes
archives of others too: any number of ``archive/*.warc[.gz]`` members, indexes with or without JSON
lines' keys, deflated indexes; a deflated data member, which ranges can't reach, is an error. Files
are opened by ``pyarrow.fs``, so the shared folder may be on any file system it knows.

Of records with equal payloads (SHA-256 and length) the smallest identifier is a response, the
others are revisits that refer to its page and record. Null payloads are empty ones; null identifiers
never become the response unless all are null; repeated rows of the smallest identifier are responses
each, with record identifiers of their own, and revisits then name the page alone. An empty table
writes no archive and reads as an empty result; extra columns don't matter. Very long payloads are
whole, one record at a time.

A file's name holds the task's attempt, and the manifest, which only successful attempts commit,
names the files that count: a task that runs again or twice, and gets its rows in another order,
loses and doubles nothing. Files of other attempts are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, filesystem, run_dir, utf8

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 24 << 20
BROADCAST_ROWS = 100_000
_DATE, _STAMP = "2020-01-01T00:00:00Z", "20200101000000"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, names)))}>"


def sort_key(url: str) -> str:
    """The address with its host turned round, as indexes are sorted by."""
    scheme, found, rest = url.partition("://")
    host, slash, path = (rest if found else scheme).partition("/")
    name, colon, port = host.lower().partition(":")
    return f"{','.join(reversed(name.removeprefix('www.').split('.')))}{colon}{port}){slash or '/'}{path.lower()}".replace(" ", "%20")


def record(name: str, ident: str, url: str, payload: bytes, refers_to: tuple[str, str, str | None] | None, length: int, digest: str) -> bytes:
    """One WARC/1.1 record called ``name``; a revisit has no payload of its own, its headers tell the whole one's.

    ``refers_to``: the response's page identifier, address and, where it is one record, name.
    """
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {ident}", f"X-Payload-Length: {length}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        page, address, other = refers_to
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {page}", f"WARC-Refers-To-Target-URI: {address}", f"WARC-Refers-To-Date: {_DATE}"]
        head += [f"WARC-Refers-To: {other}"] if other else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Writer:
    """Collects records of one archive in memory, at most about ``ARCHIVE_BYTES`` and one record."""

    def __init__(self):
        self.data, self.index = io.BytesIO(), []

    def add(self, ident: str, url: str, raw: bytes, kind: str, digest: str) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        facts = {"url": url, "mime": "text/html" if kind == "response" else "warc/revisit", "status": "200", "digest": f"sha1:{digest}", "length": str(len(packed)), "offset": str(self.data.tell()), "filename": DATA.rpartition("/")[2], "id": ident}
        self.index.append(f"{sort_key(url)} {_STAMP} {json.dumps(facts)}")
        self.data.write(packed)

    def finish(self, path: str, zip64: bool = False) -> None:
        """Writes beside ``path`` and moves the file there."""
        files, at = filesystem(path)
        part = f"{at}.{uuid.uuid4().hex}.part"
        with files.open_output_stream(part) as raw, zipfile.ZipFile(_Sink(raw), "w", zipfile.ZIP_STORED) as z:
            for name, body in ((DATA, self.data.getbuffer()), (INDEX, "\n".join(sorted(self.index)).encode())):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as out:
                    out.write(body)
        files.move(part, at)


class _Sink(io.RawIOBase):
    """A stream that only appends, as object stores give."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self):
        return True

    def seekable(self):
        return False

    def write(self, data):
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self):
        return self.at


class Reader:
    """Members of a ZIP file by ranges: no member is read before it is asked for.

    ``members`` has a name's local header, packed size and method.
    """

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.members = self._directory()

    def range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(n)
        if len(got) != n:
            raise ValueError("the archive ends early")
        return got

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        tail_at = max(0, self.size - 65_557)
        tail = self.range(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end of central directory")
        entries, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
            (z64,) = struct.unpack("<Q", tail[end - 12 : end - 4])
            entries, size, start = struct.unpack("<QQQ", self.range(z64, 56)[32:56])
        directory, at, found = self.range(start, size), 0, {}
        for _ in range(entries):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, packed, plain, n, extra, comment, local = struct.unpack("<10xH8xII HHH8xI", directory[at : at + 46])
            name = directory[at + 46 : at + 46 + n].decode()
            fields, wide = directory[at + 46 + n : at + 46 + n + extra], []
            while len(fields) >= 4:
                kind, length = struct.unpack("<HH", fields[:4])
                if kind == 1:
                    wide = list(struct.unpack(f"<{length // 8}Q", fields[4 : 4 + length // 8 * 8]))
                fields = fields[4 + length :]
            plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
            packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
            local = wide.pop(0) if local == 0xFFFFFFFF else local
            found[name] = (local, packed, method)
            at += 46 + n + extra + comment
        return found

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes start, and how many they are."""
        local, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is packed by method {method}, not stored")
        return self._behind(local), size

    def _behind(self, local: int) -> int:
        n, extra = struct.unpack("<HH", self.range(local, 30)[26:30])
        return local + 30 + n + extra

    def member(self, name: str) -> bytes:
        """The whole member, stored or deflated."""
        local, size, method = self.members[name]
        if method not in (0, 8):
            raise ValueError(f"{name} is packed by method {method}")
        raw = self.range(self._behind(local), size)
        return zlib.decompress(raw, -15) if method else raw

    def index(self):
        """(member, offset, length) of each record that the indexes tell, in their order."""
        data = [n for n in self.members if re.fullmatch(r"(.*/)?archive/[^/]+\.warc(\.gz)?", n)]
        for name in self.members:
            if not re.fullmatch(r"(.*/)?indexes/[^/]+\.cdxj?(\.gz)?", name):
                continue
            raw = self.member(name)
            for line in (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace").split("\n"):
                if (at := line.find("{")) >= 0:
                    facts = json.loads(line[at:])
                    own = [n for n in data if n.rpartition("/")[2] == str(facts.get("filename", "")).rpartition("/")[2]] or (data if len(data) == 1 else [])
                    if not own:
                        raise ValueError(f"no member for {facts.get('filename')}")
                    yield own[0], int(facts["offset"]), int(facts["length"])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, by lower-case name, and its payload: what follows the HTTP headers, or the whole block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    body = rest[: int(fields["content-length"])]
    http = fields.get("content-type", "").startswith("application/http") and fields["warc-type"] in ("response", "revisit")
    return fields, body.partition(b"\r\n\r\n")[2] if http else body


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes the archives and returns their manifest (path, n_records), written as Parquet beside them.

    Payloads smaller than ``least`` bytes are never revisits. The first pass keeps a digest a page;
    the join that gives each page its response is on digests alone and hot digests are pre-aggregated.
    """
    spark = pages.sparkSession
    facts = F.sha2(utf8(html), 256)
    address = F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_u")
    firsts = pages.select(F.col(key).cast("long").alias("_k"), address, facts.alias("_sha"), F.octet_length(utf8(html)).alias("_n")).where(F.col("_n") >= least)
    firsts = firsts.groupBy("_sha", "_k").agg(F.min("_u").alias("_u"), F.count("*").alias("_same"))
    firsts = firsts.groupBy("_sha").agg(F.min(F.when(F.col("_k").isNotNull(), F.struct("_k", "_u", "_same"))).alias("_first"), F.sum("_same").alias("_rows")).where("_rows > 1").select(F.col("_sha").alias("_f"), "_first")
    rows = pages.select(F.col(key).cast("long").alias("_k"), address, utf8(html).alias("_p"), facts.alias("_sha"))
    firsts = cut(firsts)
    if firsts.count() <= BROADCAST_ROWS:  # a checked size; beyond it the digests are shuffled
        firsts = F.broadcast(firsts)
    rows = rows.join(firsts, F.col("_sha") == F.col("_f"), "left").select("_k", "_u", "_p", F.when(~F.col("_first._k").eqNullSafe(F.col("_k")), F.col("_first._k")).alias("_r"), F.col("_first._u").alias("_ru"), (F.coalesce("_first._same", F.lit(1)) == 1).alias("_once"))

    def run(batches):
        from pyspark import TaskContext

        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        attempt, n, seen = f"{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}", 0, 0
        out, held = Writer(), 0

        def finish():
            path = f"{folder}/part-{attempt}-{n:04d}.wacz"
            out.finish(path, zip64)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(out.index)], pa.int64())], names=["path", "n_records"])

        for b in batches:
            for at in range(0, b.num_rows, 128):
                for k, u, p, r, ru, once in zip(*(c.to_pylist() for c in b.slice(at, 128).columns)):
                    ident, u, digest = "" if k is None else str(k), " ".join(u.split()), sha1_base32(p)
                    seen += 1
                    known = r is None and once  # the one response with this payload
                    name = record_id(ident, digest) if known else record_id(folder, attempt, seen)
                    to = None if r is None else (str(r), " ".join(ru.split()), record_id(r, digest) if once else None)
                    out.add(ident, u, record(name, ident, u, p, to, len(p), digest), "response" if r is None else "revisit", digest)
                    held = out.data.tell()
                    if held >= archive_bytes:
                        yield finish()
                        out, held, n = Writer(), 0, n + 1
        if out.index:
            yield finish()

    rows.mapInArrow(run, "path string, n_records long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


_OUT = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, record_id string, refers_to_record string"


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Per record: page_id, url, record_type, payload_bytes and payload_digest (of the full payload), refers_to, payload, record_id, refers_to_record.

    ``manifest`` has a ``path`` a row, each once. Archives of others tell no page identifiers, and
    their revisits no length: these are null then. Their records of other types have their block as
    payload.
    """
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(_OUT))

    def rows_of(path):
        files, at = filesystem(path)
        with files.open_input_file(at) as f:
            zipped = Reader(f)
            places: dict[str, tuple[int, int]] = {}
            for name, offset, length in zipped.index():
                start, size = places[name] if name in places else places.setdefault(name, zipped.place(name))
                if offset + length > size:
                    raise ValueError("the index points beyond the archive")
                raw = zipped.range(start + offset, length)
                fields, body = parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                revisit, told = fields["warc-type"] == "revisit", fields.get("warc-payload-digest", "")
                n, digest = (int(fields["x-payload-length"]) if "x-payload-length" in fields else None, told.removeprefix("sha1:")) if revisit else (len(body), sha1_base32(body))
                if not revisit and told.startswith("sha1:") and told[5:] != digest:
                    raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't have its digest")
                number = lambda x: int(x) if x else None
                yield (
                    number(fields.get("x-page-id")), fields.get("warc-target-uri"), fields["warc-type"], n, digest,
                    number(fields.get("x-refers-to-page-id")), body if payload and not revisit else None, fields.get("warc-record-id"), fields.get("warc-refers-to"),
                )

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                part, held = [], 0
                for r in rows_of(path):
                    part.append(r)
                    held += len(r[6] or b"") + 100
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)
                        part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n).mapInArrow(run, _OUT)  # by number alone: no plan merges the few small rows into one task


def new_folder(df: DataFrame) -> str:
    return f"{run_dir(df.sparkSession)}/warc-{uuid.uuid4().hex}"
