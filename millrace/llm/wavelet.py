"""Token-id output as wavelet matrices: compressed shard files with token access, counting and occurrence lookup.

A file holds matrices one after the other, then their index (offset, size, documents, tokens), its length and a magic. A matrix: an 8-byte magic, a JSON header with its length, then sections. A plane holds one bit of every id in the order that the planes above leave; its packed bits are cut into blocks of BLOCK bits, each compressed by itself, with the ones before each block as a directory, so a query reads and inflates only the blocks that it touches.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import batches, tokenizer

MAGIC, END_MAGIC = b"WVMATRX1", b"WVMATEND"
BLOCK = 1 << 17
#: Bits between the counts that a block in memory keeps for rank.
STEP = 512
#: Ids of a matrix, which bound the writer's memory, and bytes at which a file is closed.
MAX_TOKENS = 2_000_000
FILE_BYTES = 1 << 28
END_ID = 0


def _shrunk(block: bytes, ones: int) -> bytes:
    """A block compressed, or as it is where its bits are about even and compression would find nothing (or gains nothing)."""
    share = ones / (8 * len(block))
    if 0.4 < share < 0.6:
        return block
    out = zlib.compress(block, 1)
    return out if len(out) < len(block) else block


def build(ids: np.ndarray, bits: int, doc_ids: list, lengths: list[int]) -> bytes:
    """The file of one shard: ids (unsigned), the documents' ids and their numbers of tokens."""
    x, sections, planes = ids, [], []
    for level in range(bits):
        one = (x & x.dtype.type(1 << (bits - 1 - level))) != 0
        packed = np.packbits(one)
        ones = [int(np.bitwise_count(packed[i : i + BLOCK // 8]).sum(dtype=np.int64)) for i in range(0, len(packed), BLOCK // 8)]
        blocks = [_shrunk(packed[i : i + BLOCK // 8].tobytes(), n) for i, n in zip(range(0, len(packed), BLOCK // 8), ones)]
        planes.append({"zeros": len(one) - sum(ones), "ones": [0, *np.cumsum(ones).tolist()], "sizes": [len(b) for b in blocks]})
        sections += blocks
        if level < bits - 1:
            z, y = len(one) - sum(ones), np.empty_like(x)
            np.compress(~one, x, out=y[:z])
            np.compress(one, x, out=y[z:])
            x = y
    docs = zlib.compress(json.dumps([doc_ids, lengths], separators=(",", ":")).encode(), 1)
    head = zlib.compress(json.dumps({"n": len(ids), "bits": bits, "dtype": ids.dtype.str, "planes": planes, "docs": len(docs)}, separators=(",", ":")).encode(), 1)
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, docs, *sections])


class WaveletMatrix:
    """Reads a matrix of build(): bytes, or `read(at, n)`, which gives n bytes from place `at` of it. access, rank and select read and inflate at most a block a plane and step; a few blocks are kept."""

    def __init__(self, data: bytes | Callable[[int, int], bytes]):
        self.read = data if callable(data) else lambda at, n: data[at : at + n]
        start = self.read(0, 16)
        if start[:8] != MAGIC:
            raise ValueError("not a wavelet matrix")
        size = int.from_bytes(start[8:16], "little")
        h = json.loads(zlib.decompress(self.read(16, size)))
        self.n, self.bits, self.dtype = h["n"], h["bits"], np.dtype(h["dtype"])
        at = 16 + size
        self.doc_ids, self.lengths = json.loads(zlib.decompress(self.read(at, h["docs"])))
        at += h["docs"]
        self.zeros, self.ones, self.at = [], [], []
        for p in h["planes"]:
            self.zeros.append(p["zeros"])
            self.ones.append(p["ones"])
            places = [at, *(at + np.cumsum(p["sizes"])).tolist()] if p["sizes"] else [at]
            self.at.append(places)
            at = places[-1]
        self._block = functools.lru_cache(64)(self._counted)

    def _inflate(self, level: int, block: int) -> np.ndarray:
        """The packed bits of a block."""
        a, b = self.at[level][block], self.at[level][block + 1]
        raw, want = self.read(a, b - a), (min(BLOCK, self.n - block * BLOCK) + 7) // 8
        return np.frombuffer(raw if len(raw) == want else zlib.decompress(raw), np.uint8)

    def _counted(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's packed bits and the ones before every STEP of them."""
        packed = self._inflate(level, block)
        each = np.add.reduceat(np.bitwise_count(packed).astype(np.int64), np.arange(0, len(packed), STEP // 8))
        return packed, np.concatenate([[0], np.cumsum(each)])

    def _unpacked(self, level: int, block: int) -> np.ndarray:
        return np.unpackbits(self._inflate(level, block))[: min(BLOCK, self.n - block * BLOCK)].astype(bool)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before place i: of the blocks before, of the steps before, and of at most a step's bytes."""
        block, rest = divmod(i, BLOCK)
        if not rest:
            return self.ones[level][block]
        packed, before = self._block(level, block)
        step, byte = rest // STEP, rest // 8
        out = self.ones[level][block] + int(before[step]) + int(np.bitwise_count(packed[step * (STEP // 8) : byte]).sum())
        return out + (int(packed[byte]) >> (8 - rest % 8)).bit_count() if rest % 8 else out

    def _bit(self, level: int, i: int) -> bool:
        packed, _ = self._block(level, i // BLOCK)
        at = i % BLOCK
        return bool(packed[at // 8] >> (7 - at % 8) & 1)

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            one = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if one else i - ones
            out = out << 1 | one
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        a, b = 0, i
        for level in range(self.bits):
            oa, ob = self._ones(level, a), self._ones(level, b)
            if token >> (self.bits - 1 - level) & 1:
                a, b = self.zeros[level] + oa, self.zeros[level] + ob
            else:
                a, b = a - oa, b - ob
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before place end (all of them if none is given)."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of a token."""
        if token >> self.bits:
            raise IndexError(k)
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            at = self._find(level, at - self.zeros[level] if one else at, bool(one))
        return at

    def _find(self, level: int, k: int, one: bool) -> int:
        """The place of the k-th one or zero of a plane."""
        prefix = np.array(self.ones[level])
        if not one:
            prefix = np.minimum(np.arange(len(prefix)) * BLOCK, self.n) - prefix
        block = int(np.searchsorted(prefix, k, "right")) - 1
        k -= int(prefix[block])
        packed, before = self._block(level, block)
        if not one:
            before = np.minimum(np.arange(len(before)) * STEP, 8 * len(packed)) - before
        step = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(packed[step * (STEP // 8) : (step + 1) * (STEP // 8)]).astype(bool)
        return block * BLOCK + step * STEP + int(np.flatnonzero(bits if one else ~bits)[k - int(before[step])])

    def all(self) -> np.ndarray:
        """Every token, by undoing the planes from the last to the first."""
        out = np.zeros(self.n, self.dtype)
        for level in range(self.bits - 1, -1, -1):
            z, up, bit = self.zeros[level], np.empty_like(out), self.dtype.type(1 << (self.bits - 1 - level))
            for b in range(len(self.at[level]) - 1):
                one, ones, piece = self._unpacked(level, b), self.ones[level][b], up[b * BLOCK : (b + 1) * BLOCK]
                none, here, there = b * BLOCK - ones, np.flatnonzero(one), np.flatnonzero(~one)
                piece[there] = out[none : none + len(there)]
                piece[here] = out[z + ones : z + ones + len(here)] | bit
            out = up
        return out


def filesystem(uri: str):
    """The file system of a folder's URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class ShardWriter:
    """Writes a file beside its name and moves it there when whole, so that a task that runs twice leaves one whole file. It holds a matrix at a time."""

    def __init__(self, uri: str, name: str):
        self.store, self.root = filesystem(uri)
        self.store.create_dir(self.root, recursive=True)
        self.name, self.path = name, f"{uri}/{name}"
        self.part = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.part, compression=None)
        self.size, self.index = 0, []

    def add(self, matrix: bytes, docs: int, tokens: int) -> int:
        """The place of the matrix in the file."""
        at = self.size
        self.out.write(matrix)
        self.size += len(matrix)
        self.index.append((at, len(matrix), docs, tokens))
        return at

    def close(self) -> None:
        index = zlib.compress(json.dumps(self.index, separators=(",", ":")).encode(), 1)
        self.out.write(index + len(index).to_bytes(8, "little") + END_MAGIC)
        self.out.close()
        self.store.move(self.part, f"{self.root}/{self.name}")


class ShardFile:
    """A file's matrices, by random access."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(16, end - 16)
        if tail[8:] != END_MAGIC:
            raise ValueError(f"{uri} is not a file of wavelet matrices")
        size = int.from_bytes(tail[:8], "little")
        self.index = json.loads(zlib.decompress(self.file.read_at(size, end - 16 - size)))

    def matrix(self, at: int) -> WaveletMatrix:
        return WaveletMatrix(lambda a, n: self.file.read_at(n, at + a))

    def matrices(self) -> Iterator[WaveletMatrix]:
        for at, *_ in self.index:
            yield self.matrix(at)

    def __enter__(self) -> ShardFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, max_tokens: int = MAX_TOKENS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes docs (doc_id, text) in ascending doc_id order as files of wavelet matrices in folder. Returns the manifest, a row for each matrix: part, seq, path, place, n_docs, n_tokens, base (the tokens of all matrices before).

    Documents are range-partitioned by doc_id (ties by a hash of the text, then by where the row was read, so that rows of one id or with none are ranges as others). A matrix is closed at max_tokens, which bounds memory, and a file at file_bytes. Null ids come first; a null text has the end id alone.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path, "byte")
        bits = max(1, (words.size - 1).bit_length())
        end = np.array([end_id], words.dtype)
        part, made, files = TaskContext.get().partitionId(), [], 0
        out: ShardWriter | None = None
        ids: list = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal ids, parts, size, out, files
            if out is None:
                out = ShardWriter(folder, f"part-{part:06d}-{files:06d}.wvm")
                files += 1
            data = build(np.concatenate([x for p in parts for x in (p, end)]), bits, ids, [len(p) + 1 for p in parts])
            made.append((part, len(made), out.path, out.add(data, len(ids), size), len(ids), size))
            ids, parts, size = [], [], 0
            if out.size >= file_bytes:
                out.close()
                out = None

        for batch in it:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batches(texts):
                for name, data in zip(names[a:b], words.encode(texts[a:b])):
                    ids.append(name)
                    parts.append(data)
                    size += len(data) + 1
                    if size >= max_tokens:
                        flush()
        if ids:
            flush()
        if out is not None:
            out.close()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=["part", "seq", "path", "place", "n_docs", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("uid"))
    ordered = rows.repartitionByRange("doc_id", "h", "uid").sortWithinPartitions("doc_id", "h", "uid").select("doc_id", "text")
    made = common.written(ordered.mapInArrow(run, "part int, seq int, path string, place bigint, n_docs bigint, n_tokens bigint"), "manifest")
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a matrix, 2 million ids
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Each document from the files of a manifest: doc_id, start, n_tokens, ids_crc32. A task holds a matrix at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, place, base in zip(*(c.to_pylist() for c in batch.columns)):
                with ShardFile(path) as f:
                    m = f.matrix(place)
                    raw = m.all().astype("<u4")
                ends = np.cumsum(m.lengths)
                starts = ends - m.lengths
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(m.doc_ids, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(m.lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(manifest.count(), 20_000))
    dealt = manifest.select("path", "place", "base").repartition(tasks, "path", "place")
    return dealt.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to wavelet matrix shards and back: doc_id, start, n_tokens, ids_crc32. A null or empty text is its end id; null ids come first, rows with one id follow each other."""
    import public_tokenizers

    manifest = write_shards(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), common.new_path(spark, "wavelet"))
    return read_shards(common.written(manifest, "shards"))
