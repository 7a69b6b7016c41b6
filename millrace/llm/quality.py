"""Quality rules: base measures of a text and cross-document line frequency within a host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A line is removed if more than MAX_DOCS distinct documents of its host hold it and these are more than MAX_SHARE per cent of them, or if more than MANY_DOCS hold it, however large the host.
MAX_DOCS = 20
MAX_SHARE = 5
MANY_DOCS = 1_000
#: A document is depleted if less than this per cent of its words is left.
LEAST_LEFT = 50
#: Above so many frequent lines the join is dealt by key instead of broadcast (16 bytes a row and the host's name).
BROADCAST_ROWS = 300_000
SALTS = 16

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_KEYS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 9)], np.uint64)


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words that stand in windows of `width` words which occur twice or more in the text, the first occurrence included."""
    if len(words) <= width:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(h) - width + 1
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows += h[k : k + n] * _KEYS[k]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(np.isin(windows, twice))
    edges[at] += 1
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measures(text: str, hashes: bool = True) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and words by hashed normalised line (ASCII lower case, one blank between words). bytes.split() parts at just the six characters that the words exclude."""
    import xxhash

    data = text.encode()
    words = data.split()
    letters = sum(map(len, words))
    seen: set = set()
    lines: dict[int, int] = {}
    repeated = 0
    for line in data.split(b"\n"):
        parts = line.split()
        if parts:
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
            if hashes:
                h = xxhash.xxh64_intdigest(b" ".join(parts).lower(), 42)  # Spark's xxhash64
                lines[h] = lines.get(h, 0) + len(parts)
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    return len(words), len(text) - (len(data) - letters), symbols, repeated, repeat_words(words), lines


def features(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, source, doc_hash (of the text), the measures, and lines (hash, words)."""
    spec = "doc_id bigint, source string, doc_hash bigint, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", lines array<struct<h: bigint, w: int>>"
    kind = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                rows = [measures(t or "") for t in batch.column(3).to_pylist()]
                h = np.array([x for r in rows for x in r[5]], np.uint64).view(np.int64)
                w = np.array([x for r in rows for x in r[5].values()], np.int32)
                ends = np.cumsum([0, *(len(r[5]) for r in rows)]).astype(np.int32)
                lines = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(h), pa.array(w)], names=["h", "w"])).cast(kind)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5)), lines], names=["doc_id", "source", "doc_hash", *MEASURES, "lines"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("doc_hash"), text.alias("text")).mapInArrow(run, spec)


def judged(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: int = MAX_SHARE, many_docs: int = MANY_DOCS, least_left: int = LEAST_LEFT) -> DataFrame:
    """A row for each document: its measures, base_failed, n_removed (words of its frequent lines), dropped (their hashes) and kept.

    Distinct documents are distinct texts, so exact copies count once, and a null source is a host of its own. A host's frequent lines are few (each is in max_share per cent of its texts or in many_docs of them), but hosts may be many: the table is broadcast only while it is small, and salted beyond that. A null, empty or short text fails the base rules; an empty table gives no rows.
    """
    rows = common.written(features(docs).withColumn("row", F.monotonically_increasing_id()), "quality")
    lines = rows.select("source", "doc_hash", F.col("lines.h").alias("hs"))
    counts = lines.select("source", "doc_hash", F.explode("hs").alias("h")).distinct().groupBy("source", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs)
    hosts = rows.select("source", "doc_hash").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n_host"))
    frequent = common.null_safe(counts, hosts, ["source"]).where((F.col("n") * 100 > F.col("n_host") * max_share) | (F.col("n") > many_docs)).select("source", "h")
    frequent = common.written(frequent, "frequent")
    own = rows.select("row", F.col("source").alias("s"), F.explode("lines").alias("x")).select("row", "s", F.col("x.h").alias("lh"), F.col("x.w").alias("w"))
    same = F.col("s").eqNullSafe(F.col("source")) & (F.col("lh") == F.col("h"))
    if frequent.count() <= BROADCAST_ROWS:
        hit = own.join(F.broadcast(frequent), same)
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = own.join(salted, same & (F.pmod(F.col("row"), F.lit(SALTS)) == F.col("salt")))
    removed = hit.groupBy(F.col("row").alias("r")).agg(F.sum("w").alias("n_removed"), F.collect_list("lh").alias("dropped"))
    out = rows.drop("lines").join(removed, F.col("row") == F.col("r"), "left").drop("r")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    gone = F.coalesce(F.col("n_removed"), F.lit(0))
    return out.select("doc_id", "doc_hash", *MEASURES, failed.alias("base_failed"), gone.alias("n_removed"), "dropped", (~failed & (100 * (F.col("n_words") - gone) >= least_left * F.col("n_words"))).alias("kept"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all documents: doc_id, the measures, base_failed, kept, n_removed. A null text has no words and fails; rows with null or repeated ids are judged each by its text; other columns are passed over."""
    return judged(common.table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept", "n_removed")


def normalised(line):
    """The Column of a line as measures() hashes it."""
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are kept, without their frequent lines; n_chars follows the new text. Null and empty texts go, rows with null or repeated ids are judged by their text, all columns stay whatever their names, an empty table gives no rows."""
    verdict = judged(docs).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__h")).agg(F.first("dropped").alias("__drop"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.withColumn("__t", F.xxhash64(text)).join(verdict, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__h")))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(F.col("__drop"), F.xxhash64(normalised(x)))), "\n")
    changed = F.size(F.coalesce("__drop", F.array().cast("array<bigint>"))) > 0
    new = {"text": F.when(changed, left).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length(left).cast(common.dtype(docs, "n_chars"))).otherwise(F.col("n_chars"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
b AS (SELECT r, doc_id, source, text, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
l AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM b),
ln AS (SELECT r, source, text, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l),
lw AS (SELECT r, source, text, line, norm, len(string_split(norm, ' ')) AS lw FROM ln WHERE norm <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY r),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM b WHERE len(ws) >= 8),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS win FROM p),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 8) t(k) GROUP BY r),
cnt AS (SELECT source, norm, count(DISTINCT text) AS n FROM lw GROUP BY source, norm),
host AS (SELECT source, count(DISTINCT text) AS n_host FROM b GROUP BY source),
freq AS (SELECT c.source, c.norm FROM cnt c JOIN host h ON c.source IS NOT DISTINCT FROM h.source WHERE n > 20 AND (n * 100 > n_host * 5 OR n > 1000)),
gone AS (SELECT r, sum(lw) AS n_removed FROM lw JOIN freq f ON lw.source IS NOT DISTINCT FROM f.source AND lw.norm = f.norm GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words) AND 100 * (n_words - coalesce(n_removed, 0)) >= 50 * n_words) AS kept, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM b LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
"""
