"""WARC archives by way of a chunked record table: payloads travel as rows of record identifier and chunk number, with digests carried from chunk to chunk."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wavelet import filesystem

CHUNK_BYTES = 1 << 18
MAX_ARCHIVE_BYTES = 1 << 30
LEAST_REVISIT_BYTES = 0
#: Rows alike in page_id and payload that one task writes.
MAX_ALIKE = 1_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, record_type string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, chunk int, data binary, bytes_so_far bigint, digest_so_far string, last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str, copy: int, part: int = 0) -> str:
    return f"<urn:x-record:{'null' if page_id is None else page_id}:{digest}:{copy}{f'.{part}' if part else ''}>"


def page_key():
    """One column for page_id (null too) and payload: what the chunks are dealt and joined by, in one exchange."""
    return F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("sha1")).alias("key")


def payload() -> Column:
    """A page's payload: its html in UTF-8, null as empty."""
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def chunk_rows(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """key, page_id, url, sha1 (hex, of the whole payload), payload_bytes, uid (one a row of pages), chunk, data: at least one row for each page, at most chunk_bytes of payload each. A chunk is cut from the payload when its row is made, so no array of all chunks is held."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload().alias("payload"))
    rows = rows.select("page_id", "url", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("uid"), "payload")
    last = F.greatest(F.expr(f"(payload_bytes - 1) div {chunk_bytes}").cast("int"), F.lit(0))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return each.select(page_key(), "page_id", "url", "sha1", "payload_bytes", "uid", "chunk", F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))


def decided(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """d_key, winner (the largest page_id of the records with this payload; null if the record stands alone or is smaller than least_bytes), shared, n_parts: one row for each page_id and payload. A page_id and payload that more than MAX_ALIKE rows share are dealt to n_parts parts."""
    digests = common.written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload()).alias("sha1"), F.octet_length(payload()).alias("b")), "digests")
    groups = digests.where(F.col("b") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    shared = groups.where(F.col("n") > 1).select(F.col("sha1").alias("s"), "winner")
    own = digests.groupBy(page_key().alias("d_key"), "sha1").agg(F.ceil(F.count(F.lit(1)) / MAX_ALIKE).cast("int").alias("n_parts"))
    return common.written(own.join(shared, F.col("sha1") == F.col("s"), "left").select("d_key", "winner", F.col("s").isNotNull().alias("shared"), "n_parts"), "verdict")


def dealt(rows: DataFrame, verdict: DataFrame) -> DataFrame:
    """The chunks joined with their verdict in one exchange, by key and, where a key has several parts, by a hash of the row that they belong to. Keys of several parts are broadcast: fewer than one for MAX_ALIKE pages. part is never a literal: the optimizer would take it out of the join's keys, and the join would shuffle all payloads again."""
    many = F.broadcast(verdict.where("n_parts > 1").select(F.col("d_key").alias("m_key"), F.col("n_parts").alias("m")))
    rows = rows.join(many, F.col("key") == F.col("m_key"), "left").withColumn("part", F.pmod(F.xxhash64("uid"), F.coalesce("m", F.lit(1))).cast("int")).drop("m_key", "m")
    each = verdict.select("d_key", "winner", "shared", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("d_part"))
    return rows.repartition("key", "part").join(each, (F.col("key") == F.col("d_key")) & (F.col("part") == F.col("d_part"))).drop("d_key", "d_part")


def _record(kind: str, name: str, page: int | None, url: str | None, digest: str, size: int, refers: str | None) -> tuple[bytes, int]:
    """The WARC header and the HTTP header of a record, and the length of its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    length = len(http) + (size if kind == "response" else 0)
    target = "".join(c for c in url or "" if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {target}"] if target else []), f"WARC-Payload-Digest: sha1:{digest}"]
    if refers:
        lines += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http, length


def write_archives(pages: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, max_bytes: int = MAX_ARCHIVE_BYTES, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Writes every page as a WARC record (a gzip member each) to archives in folder; returns the manifest (path, records, bytes).

    Of records with equal payloads of at least least_bytes, that with the largest page_id is a response and the others revisit it; of rows repeated whole, one is the response and the rest revisit it. A writer holds one chunk: the record's header comes from the table, the payload's digest is carried over its chunks and has to agree with the header at its end.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        made: list[tuple] = []
        out = part_path = None
        records = size = 0
        before, copy = None, -1
        gz = sha = name = expected = None
        keep = False

        def finish() -> None:
            nonlocal gz, size
            if gz is None:
                return
            if base32(sha.digest()) != expected:
                raise ValueError(f"digest of {name} differs from its header's")
            data = gz.compress(b"\r\n\r\n") + gz.flush()
            out.write(data)
            size += len(data)
            gz = None

        def close() -> None:
            nonlocal out, records, size
            if out is None:
                return
            out.close()
            path = f"part-{part:06d}-{len(made):06d}.warc.gz"
            store.move(part_path, f"{root}/{path}")
            made.append((f"{folder}/{path}", records, size))
            out, records, size = None, 0, 0

        for batch in it:
            for r in batch.to_pylist():
                if r["chunk"] == 0:
                    finish()
                    if size >= max_bytes:
                        close()
                    if out is None:
                        part_path = f"{root}/.{uuid.uuid4().hex}"
                        out = store.open_output_stream(part_path, compression=None)
                    key = (r["page_id"], r["sha1"], r["part"])
                    copy = copy + 1 if key == before else 0
                    before = key
                    expected = base32(bytes.fromhex(r["sha1"]))
                    name = record_id(r["page_id"], expected, copy, r["part"])
                    revisit = r["shared"] and (r["page_id"] != r["winner"] or copy > 0 or r["part"] > 0)
                    keep = not revisit
                    head, _ = _record("revisit" if revisit else "response", name, r["page_id"], r["url"], expected, r["payload_bytes"], record_id(r["winner"], expected, 0) if revisit else None)
                    gz, sha = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
                    records += 1
                    data = gz.compress(head)
                    out.write(data)
                    size += len(data)
                sha.update(r["data"])
                if keep:
                    data = gz.compress(r["data"])
                    out.write(data)
                    size += len(data)
        finish()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    rows, verdict = chunk_rows(pages, chunk_bytes), decided(pages, least_bytes)
    ordered = dealt(rows, verdict).sortWithinPartitions("key", "part", "uid", "chunk").drop("key", "uid")
    return common.written(ordered.mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


class Inflater:
    """Reads gzip members one after the other, holding about a buffer of plain bytes."""

    def __init__(self, stream, size: int = 1 << 18):
        self.stream, self.size, self.buffer, self.raw, self.z = stream, size, bytearray(), b"", zlib.decompressobj(31)

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(self.size)
            if not self.raw:
                return False
        self.buffer += self.z.decompress(self.raw, self.size)
        self.raw = self.z.unconsumed_tail
        if self.z.eof:
            self.raw = self.z.unused_data
            self.z = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """The next line without its CRLF; None at the end."""
        start = 0
        while (at := self.buffer.find(b"\r\n", start)) < 0:
            start = max(0, len(self.buffer) - 1)
            if not self.more():
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return out

    def block(self, most: int) -> bytes:
        """The next bytes, at most `most`, at least one."""
        while not self.buffer:
            if not self.more():
                raise EOFError("archive ends within a record")
        out = bytes(self.buffer[:most])
        del self.buffer[: len(out)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise EOFError("archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _headers(z: Inflater) -> dict[str, str]:
    out = {}
    while line := z.line():
        k, _, v = line.decode().partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def records(stream, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> Iterator[dict]:
    """The chunk rows of an archive: each carries the bytes and the digest of its record's payload so far, and the last one is marked."""
    z = Inflater(stream)
    while (first := z.line()) is not None:
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should be: {first[:40]!r}")
        h = _headers(z)
        left = int(h["content-length"])
        z.line()  # the HTTP status line
        http: dict[str, str] = {}
        while line := z.line():
            k, _, v = line.decode().partition(":")
            http[k.strip().lower()] = v.strip()
        kind, name = h["warc-type"], h["warc-record-id"]
        page = name[1:-1].split(":")[2]
        refers = h.get("warc-refers-to", "").strip("<>").split(":")
        size, sha, chunk, done = int(http["content-length"]), hashlib.sha1(), 0, 0
        row = {"record_id": name, "record_type": kind, "page_id": None if page == "null" else int(page), "url": h.get("warc-target-uri"), "refers_to": int(refers[2]) if len(refers) > 2 and refers[2] != "null" else None, "payload_bytes": size}
        here = size if kind == "response" else 0
        if left < here:
            raise ValueError(f"{name}: block shorter than its payload")
        while True:
            piece = z.exactly(min(chunk_bytes, here - done)) if done < here else b""
            sha.update(piece)
            done += len(piece)
            last = done >= here
            so_far = base32(sha.digest()) if kind == "response" else h["warc-payload-digest"].removeprefix("sha1:")
            if last and so_far != h["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"{name}: payload differs from its digest")
            yield row | {"chunk": chunk, "data": piece if data else b"", "bytes_so_far": done, "digest_so_far": so_far, "last": last}
            chunk += 1
            if last:
                break
        z.exactly(4)


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """The chunked record table of the archives in a manifest; rows without payload bytes if data is False (digests are still taken over all bytes)."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column(0).to_pylist():
                store, at = filesystem(path)
                with store.open_input_stream(at, compression=None) as f:
                    rows, size = [], 0
                    for r in records(f, chunk_bytes, data):
                        rows.append(r)
                        size += len(r["data"]) + 300
                        if size >= 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = max(1, min(manifest.count(), 20_000))  # a task for each file: a count that adaptive execution doesn't coalesce
    return manifest.select("path").repartition(files, "path").mapInArrow(run, CHUNKS)


def op2_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages to WARC archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty payload; rows with null or repeated ids are records as any other (a null id is less than any)."""
    manifest = write_archives(common.table(spark, sf_dir, "pages"), common.new_path(spark, "warc"))
    rows = read_archives(manifest, data=False).where("last")
    return rows.select("page_id", "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
