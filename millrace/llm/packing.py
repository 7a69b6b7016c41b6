"""Packing documents into fixed windows by minimum bin slack over the multiset of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import batches, tokenizer

CAPACITY = 2048
END_ID = 1
#: Where pieces follow an order, the repeats of each pattern are dealt over so many parts of it.
PARTS = 32
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most counts of each) whose sum is as near to room as it can be: subset sums as bits of one whole number, longest lengths first, counts split by powers of two, taken back from the stored bitsets."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for l in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, k = min(counts[l], room // l), 1
        while left:
            k = min(k, left)
            steps.append((reach, l, k))
            reach |= (reach << (k * l)) & mask
            left -= k
            k *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, l, k in reversed(steps):
        if not before >> at & 1:
            used[l] = used.get(l, 0) + k
            at -= k * l
    return used


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern, repeats): each window holds the longest length left and the fill of least slack beside it; a pattern is repeated while all of its lengths last. The plan depends on the histogram alone and its length on the number of lengths, not of pieces."""
    left, out = {l: c for l, c in counts.items() if c > 0}, []
    while left:
        top = max(left)
        left[top] -= 1
        used = best_fill(left, capacity - top)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        repeats = min(left[l] // m for l, m in used.items())
        for l, m in used.items():
            left[l] -= m * repeats
            if not left[l]:
                del left[l]
        out.append((used, repeats))
    return out


def placements(plan: list[tuple[dict[int, int], int]], first: int, parts: int = 1) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes, as sorted intervals of r: in one, piece r of `m` a window is in window base + (r - start) // m, at offset + (r - start) % m * length.

    With `parts`, each pattern's repeats are dealt evenly over so many parts, so the pieces of a window stand at about the same share of their lengths' ranks. The windows are the same ones.
    """
    if parts > 1:
        phase = [k * 19 % parts for k in range(len(plan))]
        plan = [(used, n) for part in range(parts) for k, (used, r) in enumerate(plan) if (n := ((part + 1) * r + phase[k]) // parts - (part * r + phase[k]) // parts)]
    taken: dict[int, int] = {}
    rows, base = [], first
    for used, repeats in plan:
        offset = 0
        for l, m in sorted(used.items(), reverse=True):
            r = taken.get(l, 0)
            rows.append((l << 48 | r, m, base, offset, l))
            taken[l] = r + m * repeats
            offset += m * l
        base += repeats
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("key", "m", "base", "offset", "length"))}


def piece_rows(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut every `capacity` ids; the last piece is the remainder. A null text has the end id alone. A column `position` is kept with the pieces."""
    kept = ["position"] if "position" in docs.columns else []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path, "word")
        end = np.array([end_id], words.dtype)
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = batch.column(2).to_pylist() if kept else ids
            rows: list[tuple] = []
            for a, b in batches(texts):
                for doc, k, data in zip(ids[a:b], at[a:b], words.encode(texts[a:b])):
                    x = np.concatenate([data, end]).astype("<u4")
                    rows += [(doc, s, min(capacity, len(x) - s), zlib.crc32(x[s : s + capacity].tobytes()), len(x), k) for s in range(0, len(x), capacity)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5 + len(kept))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *kept])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept).mapInArrow(run, PIECES + (", position bigint" if kept else ""))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a written table): every piece lies whole in one sequence of at most `capacity` ids.

    Only the histogram of lengths (at most `capacity` rows) comes to the driver. Pieces of full length are sequences of their own; the rest follow the minimum-bin-slack plan by their rank within their length, so the work is a ranking and a lookup at any size. An empty table gives no rows; pieces that are alike may swap places.

    If pieces have a `position` (their document's, from 0), ranks go by it, patterns are dealt over it, and the sequences are numbered by the mean position of their ids, so the sequences follow that order: a window's pieces come from about the same place of it, give or take one of PARTS parts.
    """
    ordered = "position" in pieces.columns
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    plan = pack_plan(histogram, capacity)
    where = placements(plan, full, PARTS if ordered else 1)
    n = full + sum(histogram.values())
    ties = [F.col(c) for c in (["start", "doc_id", "ids_crc32", "doc_tokens"] if ordered else ["doc_id", "start", "ids_crc32", "doc_tokens"])]
    order = {"by": "position", "span": (pieces.agg(F.max("position")).first()[0] or 0) + 1} if ordered else {}
    ranked = common.running(pieces, ["length"], ties, 11, n, **order)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        l, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        sequence, offset = r.copy(), np.zeros_like(r)
        short = l < capacity
        if short.any():
            k = np.searchsorted(where["key"], l[short] << 48 | r[short], "right") - 1
            since = r[short] - (where["key"][k] & ((1 << 48) - 1))
            sequence[short] = where["base"][k] + since // where["m"][k]
            offset[short] = where["offset"][k] + since % where["m"][k] * where["length"][k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = ranked.withColumn("__at", place("length", "rank"))
    out = at.select(*[c for c in pieces.columns], F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))
    if not ordered:
        return out
    out = common.written(out, "placed")
    windows = out.groupBy("sequence_id").agg(F.expr("sum(position * length) div sum(length)").alias("position"))
    windows = common.written(windows.select(F.lit(0).alias("__all"), F.col("sequence_id").alias("__s"), "position"), "windows")
    numbered = common.running(windows, ["__all"], [F.col("__s")], 11, full + sum(r for _, r in plan), **order).select("__s", "rank")
    names = [F.col("rank").alias(c) if c == "sequence_id" else F.col(c) for c in out.columns if c != "position"]
    return out.join(numbered, F.col("sequence_id") == F.col("__s")).select(*names)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(common.written(piece_rows(docs, tokenizer_path), "pieces"))


def op10_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids. A null or empty text is its end id; rows with null or repeated ids are documents as any other."""
    return pack_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents with their places; the sequences follow the order in which the documents were written.

    A null or empty text is its end id, rows with null or repeated ids are documents as any other, other columns are passed over whatever their names, an empty table gives no rows.
    """
    return pack_documents(common.in_file_order(docs.select("doc_id", "text")))
