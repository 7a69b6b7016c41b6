"""Near-duplicate documents by SetSketch registers: bands of registers propose, a joint likelihood estimates, full shingle sets confirm."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WIDTH = 4
PER_CENT = 80
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: SetSketch parameters: registers hold floor(1 - log_b(min)) of minima that are exponential at rate a, cut to 0 .. q + 1.
B, A, Q = 1.001, 20.0, (1 << 16) - 2

_RNG = np.random.default_rng(20_240_229)
_MUL = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text in ASCII lower case. With fewer words the whole sequence is one; without words there is none."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = _mixed(out * _K[k % 4] + h[k : k + n])
    return np.unique(out)


def sketch(x: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of hashes: exponentially spaced, truncated minima. The registers of a union are the greater ones of each place."""
    if not len(x):
        return np.zeros(REGISTERS, np.uint16)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ (x >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        y = low[at : at + 1024, None] * _MUL
        y += _ADD
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(least, y.min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    value = -np.log1p(-u) / A
    return np.clip(np.floor(1 - np.log(value) / math.log(B)), 0, Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key a band (rows of registers: sets)."""
    r = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _K[0], (len(r), 1))
    for k in range(ROWS):
        out = _mixed(out * _K[1] + r[:, :, k])
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarities by maximum likelihood from how many registers are greater, smaller and equal, given the sets' sizes. The likelihood is concave in J, so its slope is bisected."""
    up, down = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    c = (B - 1) / B
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (lo + hi) / 2
        pu = np.maximum(-np.log1p(-c * (u - v * j)) / math.log(B), 1e-12)
        pd = np.maximum(-np.log1p(-c * (v - u * j)) / math.log(B), 1e-12)
        du = -v * c / ((1 - c * (u - v * j)) * math.log(B))
        dd = -u * c / ((1 - c * (v - u * j)) * math.log(B))
        slope = up * du / pu + down * dd / pd - same * (du + dd) / np.maximum(1 - pu - pd, 1e-12)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


#: A pair whose estimate is this far below the limit isn't verified: five standard deviations of REGISTERS registers.
SLACK = 0.125
BLOCK = 1_024
#: Bits of the filter that spares texts without candidates the second pass. Its size is fixed; when full it only spares fewer.
FILTER_BITS = 1 << 23


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the whole set) and sketch of each document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in it:
            for start in range(0, whole.num_rows, 1_000):
                batch = whole.slice(start, 1_000)
                n, digest, sketches = [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingles(text or "")
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sketches.append(sketch(s).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n", "digest", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, digest binary, sketch binary")


def memberships(nodes: DataFrame) -> DataFrame:
    """(key, node) for each band of each node."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(registers).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))], names=["key", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "key bigint, node bigint")


def likely(pairs: DataFrame, nodes: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose estimated similarity comes near it."""
    least = per_cent / 100 - SLACK

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(estimate(a, b, na, nb) >= least))

    own = nodes.select("node", "n", "sketch")
    wide = pairs.join(own.toDF("a", "na", "sa"), "a").join(own.toDF("b", "nb", "sb"), "b")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * per_cent
    return wide.where(fits).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(100 * shared >= per_cent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s): the shingle sets of the nodes, from a second pass over the texts.

    A Bloom filter of fixed size (a table of FILTER_BITS / 64 words, so its broadcast is bounded) keeps most other texts from the pass; the join that follows makes the result exact.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = nodes.select(bit(F.col("doc")).alias("x")).select(F.expr("x div 64").alias("w"), F.expr("shiftleft(1L, cast(x % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in it:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sets = [shingles(t or "") for t in batch.column(1).to_pylist()]
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "d", "s"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), bit(F.col("doc_id").cast("long")).alias("x"))
    hit = rows.join(F.broadcast(words), F.expr("x div 64") == F.col("w")).where(F.expr("(shiftright(m, cast(x % 64 as int)) & 1L) = 1")).select("doc_id", "text")
    made = hit.mapInArrow(run, "id bigint, d binary, s array<bigint>")
    return nodes.select("node", "doc", "digest").join(made, (F.col("doc") == F.col("id")) & (F.col("digest") == F.col("d"))).select("node", "s").dropDuplicates(["node"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches, by label spreading with pointer jumping; every step is a written table, so lineage stays short."""
    both = common.written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = common.written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    total = None
    while True:
        near = both.join(labels.select(F.col("u").alias("x"), F.col("l").alias("lx")), F.col("v") == F.col("x")).groupBy("u").agg(F.min("lx").alias("m"))
        least = near.join(labels, "u").select("u", F.least("m", "l").alias("l"))
        jump = labels.select(F.col("u").alias("y"), F.col("l").alias("ly"))
        following = common.written(least.join(jump, F.col("l") == F.col("y"), "left").select("u", F.least("l", F.coalesce("ly", "l")).alias("l")), "labels")
        now = following.agg(F.sum(F.col("l").cast("decimal(38,0)")).alias("t")).first()["t"]
        common.dropped(labels)
        labels = following
        if now == total:
            break
        total = now
    return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))


def rest(members: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, per_cent: int) -> DataFrame:
    """Likely pairs of different components that share a band and that no pivot stood for: all of them, so no link is lost.

    Shingles that only one of these nodes holds can't be shared, so with c the other shingles and u these, a pair's similarity is at most min(c) / (max(c) + u + u'). Buckets are compared block by block, whatever their size, and a pair comes from the first band that it shares.
    """
    named = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    open_keys = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select(F.col("key").alias("k"), "size")
    left = common.written(named.join(open_keys, F.col("key") == F.col("k")).select("key", "node", "c", "size"), "open")
    own = sets.join(left.select(F.col("node").alias("x")).distinct(), F.col("node") == F.col("x")).select("node", F.explode("s").alias("h"))
    alone = own.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")).where("df = 1").groupBy(F.col("node").alias("x")).agg(F.count(F.lit(1)).alias("u"))
    wide = nodes.join(left.select(F.col("node").alias("y")).distinct(), F.col("node") == F.col("y")).join(alone, F.col("node") == F.col("x"), "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u"), "sketch").where(F.expr(f"(n - u) * 100 >= {per_cent} * n"))
    wide = common.written(wide, "wide")
    blocks = F.expr(f"(size + {BLOCK - 1}) div {BLOCK}")
    at = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = left.select("key", "node", "c", blocks.cast("int").alias("nb"), at.alias("b"))
    sides = dealt.select("key", "node", "c", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")).select("key", "node", "c", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    rows = sides.join(wide.withColumnRenamed("node", "z"), F.col("node") == F.col("z")).drop("z")
    least = per_cent / 100 - SLACK

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        key = np.array([table.column("key")[0].as_py()], np.int64).view(np.uint64)[0]
        node, c, b, n, u = (table.column(k).to_numpy() for k in ("node", "c", "b", "n", "u"))
        registers = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(registers)
        mine = int(np.flatnonzero(keys[0] == key)[0])
        rows_, cols = np.flatnonzero(b == i), np.flatnonzero(b == j)
        out_a, out_b = [], []
        for r in rows_:
            other = cols[cols > r] if i == j else cols
            common_, extra = n[other] - u[other], u[other] + u[r]
            own = n[r] - u[r]
            ok = (c[other] != c[r]) & (np.minimum(common_, own) * 100 >= per_cent * (np.maximum(common_, own) + extra)) & (np.minimum(n[other], n[r]) * 100 >= per_cent * np.maximum(n[other], n[r]))
            other = other[ok]
            if len(other):
                other = other[~(keys[other, :mine] == keys[r, :mine]).any(1)]
            if len(other):
                near = estimate(np.broadcast_to(registers[r], (len(other), REGISTERS)), registers[other], np.full(len(other), float(n[r])), n[other].astype(float)) >= least
                other = other[near]
                out_a.append(np.minimum(node[other], node[r]))
                out_b.append(np.maximum(node[other], node[r]))
        empty = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([empty, *out_a])), "b": pa.array(np.concatenate([empty, *out_b]))})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def linked(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (doc_id = component_id) of each document.

    Equal sets are one node, under their smallest doc_id. Each bucket of a band first compares its members with one pivot, the node that shares most buckets (a group of copies is mostly settled by this, at a row a member); what then still joins different components in a bucket is compared in full by rest(). Each link is confirmed on full sets. A text without words is linked with nothing; a null doc_id is linked with nothing and kept. All texts of a repeated doc_id are compared, and what they reach is one component.
    """
    rows = common.written(features(docs), "features")
    some = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"))
    # ids with several texts: each text is a node, the least digest's under the id itself, and one link joins them
    several = some.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("m"))
    several = common.written(several, "several")
    own = classes.join(several, F.col("doc") == F.col("m"), "left")
    first = own.where("m IS NOT NULL").groupBy(F.col("m").alias("fm")).agg(F.min("digest").alias("fd"))
    other = F.col("m").isNotNull() & (F.col("digest") != F.col("fd"))
    made = F.xxhash64("digest").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    classes = own.join(first, F.col("m") == F.col("fm"), "left").select("digest", "doc", "copies", F.when(other, made).otherwise(F.col("doc")).alias("node"))
    classes = common.written(classes, "classes")
    named_ = classes.select(F.col("digest").alias("d"), "doc", "node")
    nodes = rows.join(named_, (F.col("doc_id") == F.col("doc")) & (F.col("digest") == F.col("d"))).select("node", "doc", "n", "digest", "sketch").dropDuplicates(["node"])
    nodes = common.written(nodes, "nodes")
    same = some.join(several, F.col("doc_id") == F.col("m")).select("m", "digest").distinct().join(named_.select("d", "node"), F.col("digest") == F.col("d")).select("m", "node")
    joined = same.join(same.groupBy(F.col("m").alias("lm")).agg(F.min("node").alias("least")), F.col("m") == F.col("lm")).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    every = memberships(nodes)
    sizes = every.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(F.col("key").alias("k"), "size")
    members = common.written(every.join(sizes, F.col("key") == F.col("k")).select("key", "node", "size"), "members")
    degree = members.groupBy(F.col("node").alias("x")).agg(F.sum(F.col("size") - 1).alias("deg"))
    degree = common.written(degree, "degree")
    ranked = members.join(degree, F.col("node") == F.col("x")).select("key", "node", F.struct("deg", (-F.col("node")).alias("m")).alias("r"))
    pivots = ranked.groupBy("key").agg(F.max("r").alias("top")).select(F.col("key").alias("k"), (-F.col("top.m")).alias("p"))
    stars = members.join(pivots, F.col("key") == F.col("k")).where("node <> p").select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
    near = nodes.join(degree.select("x"), F.col("node") == F.col("x")).select("node", "doc", "n", "digest", "sketch")
    near = common.written(near, "near")
    sets = common.written(full_sets(docs, near), "sets")
    links = common.written(confirmed(likely(stars, near, per_cent), sets, per_cent).union(joined).distinct(), "links")
    labels = components(links)
    more = common.written(confirmed(rest(members, near, sets, labels, per_cent), sets, per_cent), "links")
    if more.limit(1).count():
        labels = components(links.union(more))
    # a component goes by its smallest doc_id; a node's number differs from that only for further texts of a repeated id
    if several.limit(1).count():
        least = labels.join(classes.select(F.col("node").alias("cn"), "doc"), F.col("node") == F.col("cn")).groupBy(F.col("component").alias("lc")).agg(F.min("doc").alias("ld"))
        labels = labels.join(least, F.col("component") == F.col("lc")).select("node", F.col("ld").alias("component"))
    named = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    shared = classes.where("copies > 1 OR node <> doc").select(F.col("digest").alias("d"), F.col("node").alias("rep"), "doc")
    placed = named.join(shared, F.col("digest") == F.col("d"), "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    placed = placed.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("rep", "doc_id")).alias("rep"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("doc", "doc_id")).alias("doc"))
    out = placed.join(labels, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of all documents: doc_id, n_shingles, component_id, kept."""
    return linked(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group, that with the smallest doc_id; of several rows with that id one stays (one with words before others, then by a hash of the text).

    Rows with a null doc_id and texts without words are linked with nothing and stay; all columns stay whatever their names, an empty table gives no rows.
    """
    kept = linked(docs).where("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__times"))
    rows = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    once = F.col("__id").isNull() | (F.col("__times") == 1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    w = Window.partitionBy("__id").orderBy(~text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text))
    repeated = rows.where(~once).withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return rows.where(once).select(*docs.columns).union(repeated.select(*docs.columns))
