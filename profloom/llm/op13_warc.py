"""WARC archives: written one gzip member a record, read back by byte ranges.

``write_warc`` turns rows into records and appends them to archives, each task to files of its
own; a file counts only if the manifest, which the tasks return, names it, so what a lost or
repeated task wrote is never read. Of records with equal payloads the one of the largest id is
a response, the others are revisits that refer to it.

``read_warc`` is splittable: an archive is cut into byte ranges, a task looks for the gzip magic
in its range, takes a candidate for a member only if its head inflates to a WARC header, and
owns the records that start inside, reading past the end of the range for the last one. Inside
a range the end of one member is the start of the next. The bytes of a payload may look like a
member themselves, so that the first candidate of a range may be false: ``record_starts``
follows each range's chain, and where the chain of the ranges before ends beyond a range's first
candidate, that range starts anew from there. So the ranges give what one pass over the file gives.

Defined cases: a null payload is empty; a null id is written as an empty one and comes last
among equals; of rows of equal id and payload one is the response; a null target has no
``WARC-Target-URI``, and control characters in one are percent-encoded. A damaged or cut member
gives a row with ``error``, and reading goes on at the next member. Extra columns are ignored;
an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profloom.llm.common import cut, discard, scratch, table

MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes after which a task begins another archive, and bytes of archive that one range takes.
ARCHIVE_BYTES, RANGE_BYTES = 1 << 30, 32 << 20
#: Bytes taken from the store and fed to the inflater at once; longest header taken for one; bytes of output sent on at once.
BLOCK_BYTES, READ_BYTES, HEAD_BYTES, SEND_BYTES = 1 << 20, 1 << 14, 1 << 16, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_head(kind: str, record_id: str, uri: str | None, date: str, digest: str, payload_bytes: int, refers_to: str | None = None) -> bytes:
    """WARC and HTTP headers of a record; a response's payload follows them."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub("[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", uri))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    size = len(http) + (payload_bytes if kind == "response" else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}", "", ""]
    return "\r\n".join(lines).encode() + http


def member(head: bytes, payload: bytes = b"") -> bytes:
    z = zlib.compressobj(6, wbits=31)
    return z.compress(head) + z.compress(payload) + z.compress(b"\r\n\r\n") + z.flush()


def name_of(mark: Column, copy: Column | int, key: Column) -> Column:
    """A record's name: what its row holds, which of several equal rows it is, and its id."""
    return F.concat(F.lit("urn:record:"), mark, F.lit("."), F.lit(copy).cast("string") if isinstance(copy, int) else copy.cast("string"), F.lit(":"), F.coalesce(F.url_encode(key), F.lit("")))


RECORD = pa.schema([("mark", pa.string()), ("member", pa.binary())])


def _responses(date: str):
    """The member of each row (mark, name, uri, payload) as a response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, members, held = [], [], 0
            for mark, name, uri, payload in zip(*(batch.column(i) for i in range(4)), strict=True):
                payload = payload.as_py()
                head = record_head("response", name.as_py(), uri.as_py(), date, base32_sha1(hashlib.sha1(payload).digest()), len(payload))
                marks.append(mark.as_py())
                members.append(member(head, payload))
                held += len(members[-1])
                if held >= SEND_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(members, pa.binary())], schema=RECORD)
                    marks, members, held = [], [], 0
            if marks:
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(members, pa.binary())], schema=RECORD)

    return run


def _revisits(date: str):
    """The member of each row (name, uri, payload_bytes, sha1, refers_to) as a revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [member(record_head("revisit", r["name"], r["uri"], date, base32_sha1(bytes.fromhex(r["sha1"])), r["payload_bytes"], r["refers_to"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    return run


def _append(folder: str, archive_bytes: int):
    """Write the members of a task into archives; a manifest row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out, path, size, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "length": [size], "records": [n]}, schema=pa.schema([("path", pa.string()), ("length", pa.int64()), ("records", pa.int64())]))

        for batch in batches:
            for data in batch.column(0):
                if out is None:
                    store.create_dir(root, recursive=True)
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                out.write(data.as_buffer())
                size, n = size + len(data.as_buffer()), n + 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_warc(df: DataFrame, id_col: str, uri_col: str, payload_col: str, folder: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row below ``folder``, a path or URI that all executors reach; the manifest (path, length, records) is a written table.

    Payloads are text in UTF-8 or bytes; equal ones of at least ``least_bytes`` are stored once. Who is
    response is settled on rows without payloads; payloads are read again, and compressed before
    they are shuffled to meet the verdict.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("mark", F.md5(F.to_json(F.struct("key", "uri", "sha1")).cast("binary")))
    equal = rows.groupBy("mark", "id", "key", "uri", "sha1", F.octet_length("payload").cast("long").alias("payload_bytes")).agg(F.count("*").alias("copies"))
    equal = cut(equal.where(F.col("payload_bytes") >= least_bytes))
    best = cut(equal.groupBy("sha1").agg(F.max(F.struct("id", "uri", "mark", "key")).alias("best")).select("sha1", F.col("best.mark").alias("best"), name_of(F.col("best.mark"), 0, F.col("best.key")).alias("refers_to")))
    copies = F.explode(F.sequence(F.when(F.col("mark") == F.col("best"), F.lit(1)).otherwise(0).cast("long"), F.col("copies") - 1))
    later = equal.join(best, "sha1").where("mark <> best OR copies > 1").withColumn("copy", copies)
    later = later.select(name_of(F.col("mark"), F.col("copy"), F.col("key")).alias("name"), "uri", "payload_bytes", "sha1", "refers_to").mapInArrow(_revisits(date), "member binary")

    as_response = lambda r, name: r.select("mark", name.alias("name"), "uri", "payload").mapInArrow(_responses(date), "mark string, member binary")
    grouped = as_response(rows.where(F.octet_length("payload") >= least_bytes), name_of(F.col("mark"), 0, F.col("key")))
    grouped = grouped.join(best.select(F.col("best").alias("mark")), "mark", "left_semi").dropDuplicates(["mark"]).select("member")
    both = grouped.unionByName(later)
    if least_bytes > 0:  # nothing refers to these, so any name of their own will do
        small = rows.where(F.octet_length("payload") < least_bytes)
        both = both.unionByName(as_response(small, name_of(F.col("mark"), F.uuid(), F.col("key"))).select("member"))
    manifest = cut(both.mapInArrow(_append(folder, archive_bytes), "path string, length long, records long"))
    discard(equal)
    discard(best)
    return manifest


class _Blocks:
    """A file whose neighbouring small reads are served from one block."""

    def __init__(self, file) -> None:
        self.file, self.at, self.data = file, 0, b""

    def read_at(self, n: int, pos: int) -> bytes:
        if pos < self.at or pos + n > self.at + len(self.data):
            self.at, self.data = pos, self.file.read_at(max(n, BLOCK_BYTES), pos)
        return self.data[pos - self.at : pos - self.at + n]


class _Member:
    """The inflated bytes of the gzip member at ``at``, read forward; ``end`` is known once ``done``."""

    def __init__(self, file, at: int, size: int) -> None:
        self.file, self.pos, self.size = file, at, size
        self.z = zlib.decompressobj(31)
        self.held = bytearray()
        self.end: int | None = None

    def more(self, n: int = READ_BYTES) -> bool:
        """Inflate a little more; False once the member has ended."""
        if self.z.eof:
            return False
        raw = self.z.unconsumed_tail
        if not raw and self.pos < self.size:
            raw = self.file.read_at(min(READ_BYTES, self.size - self.pos), self.pos)
            self.pos += len(raw)
        out = self.z.decompress(raw, n)  # also with nothing left to read, output may be pending
        if not raw and not out and not self.z.eof:
            raise ValueError("cut short")
        self.held += out
        if self.z.eof:
            self.end = self.pos - len(self.z.unused_data)
        return True

    def until(self, mark: bytes, limit: int) -> bytes:
        """The bytes up to and with ``mark``."""
        seen = 0
        while (k := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > limit or not self.more(4096):
                raise ValueError("no header")
        out = bytes(self.held[: k + len(mark)])
        del self.held[: k + len(mark)]
        return out

    def parts(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, piece by piece."""
        while n:
            if not self.held and not self.more():
                raise ValueError("record longer than its member")
            piece = bytes(self.held[:n])
            del self.held[: len(piece)]
            n -= len(piece)
            yield piece

    def skip(self) -> int:
        """Where the member ends."""
        while not self.z.eof:
            self.held.clear()
            self.more()
        return self.end


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def is_record(file, at: int, size: int) -> bool:
    """Does the candidate member at ``at`` inflate to a WARC header? Fed in small pieces, so that damage further on does not hide one."""
    z, head = zlib.decompressobj(31), b""
    try:
        while b"\r\n\r\n" not in head:
            raw = file.read_at(min(64, size - at), at)
            if not raw or z.eof or len(head) > HEAD_BYTES or head and not head.startswith(b"WARC/"[: len(head)]):
                return False
            head += z.decompress(raw)
            at += len(raw)
    except zlib.error:
        return False
    return head.startswith(b"WARC/")


def find_record(file, at: int, stop: int, size: int) -> int | None:
    """The first true member that starts in [at, stop)."""
    while at < stop:
        data = file.read_at(min(BLOCK_BYTES, stop - at + 2, size - at), at)
        k = data.find(MAGIC)
        while 0 <= k < stop - at:
            if is_record(file, at + k, size):
                return at + k
            k = data.find(MAGIC, k + 1)
        if at + len(data) >= min(size, stop + 2):
            return None
        at += max(1, len(data) - 2)
    return None


def walk(file, at: int, stop: int, size: int, visit=None) -> tuple[int | None, int]:
    """(first member, where the chain goes on) of the members that start in [at, stop); ``visit`` gets each and its file position."""
    first, where = None, find_record(file, at, stop, size)
    while where is not None and where < stop:
        first = where if first is None else first
        m = _Member(file, where, size)
        try:
            if visit is not None:
                visit(m, where)
            after = m.skip()
        except (ValueError, zlib.error) as fault:
            if visit is not None:
                visit(None, where, str(fault))
            after = None
        where = after if after is not None and (after >= stop or is_record(file, after, size)) else find_record(file, where + 1 if after is None else after, stop, size)
    return first, stop if where is None else where


def warc_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length) of archives, for ``read_warc``; contents are not read."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length")


def _over_ranges(step):
    """A task over (path, length, lo, hi) rows: ``step(file, row)`` yields output batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for r in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(r["path"])
                with store.open_input_file(path) as file:
                    yield from step(_Blocks(file), r)

    return run


def record_starts(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, length, lo, hi): byte ranges, ``lo`` moved to where one pass over the file would look on for the range's first record."""

    def follow(file, r) -> Iterator[pa.RecordBatch]:
        first, after = walk(file, r["lo"], r["hi"], r["length"])
        yield pa.RecordBatch.from_pylist([r | {"first": first, "after": after}], schema=schema)

    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("first", pa.int64()), ("after", pa.int64())])
    ddl = "path string, length long, lo long, hi long, first long, after long"
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("length > 0").select("path", "length", begin.alias("lo")).withColumn("hi", F.least(F.col("lo") + range_bytes, "length"))
    now = cut(ranges.repartition("path", "lo").mapInArrow(_over_ranges(follow), ddl))
    while True:
        so_far = Window.partitionBy("path").orderBy("hi").rowsBetween(Window.unboundedPreceding, -1)
        seen = now.withColumn("arrived", F.coalesce(F.max("after").over(so_far), F.lit(0)))
        wrong = F.coalesce(F.col("first") < F.col("arrived"), F.lit(False))
        if seen.where(wrong).isEmpty():
            return seen.select("path", "length", F.greatest("lo", "arrived").alias("lo"), "hi").where("lo < hi")
        again = seen.where(wrong).select("path", "length", F.col("arrived").alias("lo"), "hi").repartition("path", "hi")
        fixed = again.mapInArrow(_over_ranges(follow), ddl)
        now = cut(seen.where(~wrong).select(*now.columns).unionByName(fixed))


def _record(m: _Member, where: int, keep: bool) -> dict:
    head = m.until(b"\r\n\r\n", HEAD_BYTES)
    if not head.startswith(b"WARC/"):
        raise ValueError("no record")
    fields = _fields(head)
    rest = int(fields["content-length"])
    http = b""
    if fields.get("content-type", "").startswith("application/http") and rest:
        http = m.until(b"\r\n\r\n", rest)
        rest -= len(http)
    sha, size, kept = hashlib.sha1(), 0, []
    for piece in m.parts(rest):
        sha.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    kind, told = fields.get("warc-type"), fields.get("warc-payload-digest", "").rpartition(":")[2]
    own = base32_sha1(sha.digest())
    bare = lambda name: fields.get(name, "").strip("<>") or None
    revisit = kind == "revisit"
    return {
        "offset": where, "record_type": kind, "record_id": bare("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": bare("warc-refers-to"),
        "payload_bytes": int(_fields(http).get("content-length", 0)) if revisit else size, "payload_digest": told if revisit else own, "payload": None if revisit or not keep else b"".join(kept),
        "error": None if revisit or not told or told == own else "digest differs",
    }


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES, payload: bool = True) -> DataFrame:
    """A row per record of ``files(path, length)``: see ``warc_files`` and the manifest of ``write_warc``.

    Columns path, offset, record_type, record_id, target_uri, date, refers_to, payload_bytes,
    payload_digest, payload, error. Sizes and digests of a revisit are what its headers say, of
    all others those of the bytes read. Without ``payload``, payloads are only summed up.
    """
    schema = pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
    ])

    def read(file, r) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []

        def visit(m, where: int, fault: str | None = None) -> None:
            if m is None:
                ready.append({"path": r["path"], "offset": where, "error": fault})
                return
            while m.held or m.more():  # several records in a member have its position
                del m.held[: len(m.held) - len(m.held.lstrip(b"\r\n"))]  # the line ends after a record may come apart
                if m.held:
                    ready.append({"path": r["path"]} | _record(m, where, payload))

        at = r["lo"]
        while at < r["hi"]:
            first = find_record(file, at, r["hi"], r["length"])
            if first is None:
                break
            _, at = walk(file, first, first + 1, r["length"], visit)
            if at == first + 1:  # the member is damaged: look on behind its start
                at = find_record(file, at, r["hi"], r["length"]) or r["hi"]
            if len(ready) >= 512 or sum(x.get("payload_bytes") or 0 for x in ready) >= SEND_BYTES:
                yield pa.RecordBatch.from_pylist(ready, schema=schema)
                ready.clear()
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)

    starts = record_starts(files, range_bytes).repartition("path", "lo")
    ddl = "path string, offset long, record_type string, record_id string, target_uri string, date string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"
    return starts.mapInArrow(_over_ranges(read), ddl)


def key_of(record_id: Column) -> Column:
    """The id that ``write_warc`` put into a record's name; null for a null or empty one."""
    text = F.url_decode(F.regexp_extract(record_id, r"^urn:record:[^:]*:(.*)$", 1))
    return F.when(text != "", text)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    found = read_warc(write_warc(table(spark, sf_dir, "pages"), "page_id", "url", "html", folder), payload=False)
    page = lambda c: key_of(F.col(c)).cast("long")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE = """
WITH coded AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), bits AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(40), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][('0x' || x[i + 1])::INT + 1]), 'string_agg', '') AS b
  FROM coded
), digests AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_reduce(list_prepend(0::BIGINT, list_transform(range(5), lambda j: b[5 * i + j + 1]::BIGINT)), lambda s, v: 2 * s + v) + 1]), 'string_agg', '') AS payload_digest
  FROM bits
), last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM last
"""
