"""Approximate nearest neighbours: NN-descent builds a neighbour graph by joins of neighbours of neighbours, and queries walk it greedily.

Nodes are numbered block by block (`nid >> 32` is the block), and a block holds vectors that lie near each other. Every join of vectors goes by block, so a vector travels once to each block that needs it and not once to each neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

K = 24  # neighbours of a node
REVERSE = 16  # incoming neighbours that join in, drawn by a hash where there are more
TREES, LEAF = 4, 512
#: Centre, scale and planes come from at most so many vectors (and SAMPLE_BYTES); every vector is placed by them.
SAMPLE, SAMPLE_BYTES = 8_192, 1 << 25
#: A task holds at most about so many bytes of vectors: those of a block and of all neighbours of its nodes.
BLOCK_BYTES = 1 << 27
EF = 224  # nodes that a query keeps
SLABS = 64
#: Queries of one block that go to one task.
ASKED = 20_000


def valid(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v, h1, h2): the finite, non-zero vectors of rows whose id isn't null, with 128 bits of hash that equal vectors share. Vectors of another length than the most frequent (of several, the shortest) take no part."""
    single = common.dtype(vectors, vector).simpleString() == "array<float>"
    v = F.col(vector).cast("array<float>" if single else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v"), fine.alias("ok")).where(F.col("ok") & F.col("vec_id").isNotNull())
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    own = rows.where(F.size("v") == (size["n"] if size else 0))
    return own.select("vec_id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))


def forest(sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 9) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree the normals and offsets of a complete binary tree of planes, each halfway by count along the line of two sampled vectors."""
    rng, out = np.random.default_rng(seed), []
    depth = 0
    while n >> depth > leaf and len(sample) >> depth > 8:
        depth += 1
    for _ in range(trees):
        normals, offsets = np.zeros(((1 << depth) - 1, sample.shape[1]), np.float32), np.zeros((1 << depth) - 1, np.float32)
        groups = {0: np.arange(len(sample))}
        for node in range(len(offsets)):
            own = groups.pop(node, np.zeros(0, np.int64))
            a, b = sample[rng.choice(own, 2)] if len(own) else (sample[0], sample[-1])
            normal = a - b
            if not normal.any():
                normal = rng.normal(size=sample.shape[1])
            normal = normal / np.abs(normal).max()
            side = sample[own] @ normal
            at = np.median(side) if len(own) else 0.0
            normals[node], offsets[node] = normal, at
            groups[2 * node + 1], groups[2 * node + 2] = own[side <= at], own[side > at]
        out.append((normals, offsets))
    return out


def _matrix(column) -> np.ndarray:
    """A binary column of float32 vectors."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float32)
    return flat.reshape(len(column), -1)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The row number and the value of each element of a list column."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())), x.flatten().to_numpy(zero_copy_only=False)


def best(row: np.ndarray, ids: np.ndarray, d: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest distinct ids of each row, nearest first (ties: the smaller id); an id that was known stays so."""
    order = np.lexsort((new, ids, row))
    row, ids, d, new = row[order], ids[order], d[order], new[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, d, new = row[first], ids[first], d[first], new[first]
    order = np.lexsort((ids, d, row))
    row, ids, d, new = row[order], ids[order], d[order], new[order]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    keep = rank < k
    return row[keep], ids[keep], d[keep], new[keep]


def _lists(n: int, row: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in values]


GRAPH = "block bigint, nid bigint, ids array<bigint>, ds array<float>, new array<int>"


def _graph_table(nid: np.ndarray, row: np.ndarray, ids: np.ndarray, d: np.ndarray, new: np.ndarray) -> pa.Table:
    return pa.table([pa.array(nid >> 32), pa.array(nid), *_lists(len(nid), row, ids, d.astype(np.float32), new.astype(np.int32))], names=["block", "nid", "ids", "ds", "new"])


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The graph from rows of GRAPH: the k nearest for each node, a block at a time."""

    def run(x: pa.Table) -> pa.Table:
        nid, at = np.unique(x.column("nid").to_numpy(), return_inverse=True)
        row, ids = _flat(x.column("ids"))
        _, d = _flat(x.column("ds"))
        _, new = _flat(x.column("new"))
        return _graph_table(nid, *best(at[row], ids, d, new, k))

    return lists.groupBy("block").applyInArrow(run, GRAPH)


def squares(v: np.ndarray) -> np.ndarray:
    """Squared distances within a stack of vectors (.., n, dim), taken from their first one, so that what they have in common costs no precision."""
    v = v - v[..., :1, :]
    norm = (v**2).sum(-1)
    return np.maximum(norm[..., :, None] + norm[..., None, :] - 2 * v @ np.swapaxes(v, -1, -2), 0)


def placed(vectors: DataFrame, sample: np.ndarray, n: int, trees: int, leaf: int) -> tuple[DataFrame, int]:
    """Adds vec (float32 bytes; centred by the sample's medians and scaled by its median deviation), leaves (one a tree) and slabs (places along random lines) to vectors; and the depth of the trees."""
    centre = np.median(sample, 0)
    off = np.abs(sample - centre)
    scale = float(np.median(off[off > 0])) if (off > 0).any() else 1.0
    dim = sample.shape[1]
    names = vectors.columns

    def normal(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip((x - centre) / scale, -1e15, 1e15).astype(np.float32)

    planes = forest(normal(sample), n, trees, leaf)
    lines = np.random.default_rng(17).normal(size=(dim, 3 * trees)).astype(np.float32)
    at_v = names.index("v")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for start in range(0, whole.num_rows, 4_096):
                batch = whole.slice(start, 4_096)
                x = normal(batch.column(at_v).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, dim))
                leaves = np.zeros((len(x), len(planes)), np.int64)
                for t, (normals, offsets) in enumerate(planes):
                    at = leaves[:, t]
                    while at[0] < len(offsets):
                        at[:] = 2 * at + 1 + (np.einsum("nd,nd->n", x, normals[at]) > offsets[at])
                    at -= len(offsets)
                ends = lambda w: pa.array(np.arange(len(x) + 1, dtype=np.int32) * w)
                slabs = x @ lines
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([r.tobytes() for r in x], pa.binary()), pa.ListArray.from_arrays(ends(leaves.shape[1]), pa.array(leaves.ravel())), pa.ListArray.from_arrays(ends(slabs.shape[1]), pa.array(slabs.ravel()))],
                    names=[*names, "vec", "leaves", "slabs"],
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kinds}, vec binary, leaves array<bigint>, slabs array<float>"), int(math.log2(len(planes[0][1]) + 1))


def numbered(rows: DataFrame, n: int, depth: int, most: int) -> DataFrame:
    """Adds nid: blocks are runs of leaves of the first tree with about `most` vectors at most; larger leaves are dealt to several blocks."""
    shift = min(depth, max(0, int(math.log2(max(1.0, most * (1 << depth) / max(1, n))))))
    run = F.shiftright(F.col("leaves")[0], shift)
    sizes = {r["b"]: -(-r["n"] // (2 * most)) for r in rows.groupBy(run.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each of at most 2,048 runs
    wide = max(sizes.values(), default=1)
    chunks = F.broadcast(common.inline_table(rows.sparkSession, [{"__b": b, "__c": c} for b, c in sizes.items()], "__b: bigint, __c: int"))
    dealt = rows.join(chunks, run == F.col("__b")).withColumn("block", F.col("__b") * wide + F.pmod("h1", "__c")).drop("__b", "__c")
    w = Window.partitionBy("block").orderBy("h1", "h2")  # at most 2 * most rows or so
    return dealt.withColumn("nid", F.shiftleft("block", 32) + F.row_number().over(w))


def leaf_rows(nodes: DataFrame, leaf: int, slabs: int = SLABS) -> DataFrame:
    """(tree, leaf, nid, vec). A leaf of more than twice `leaf` vectors is cut into slabs along a random line, up to three times; what equal places leave in one is dealt by hash."""
    rows = nodes.select("nid", "vec", "slabs", F.posexplode("leaves").alias("tree", "leaf"))
    count = F.count(F.lit(1)).alias("n")
    for step in range(3):
        sizes = rows.groupBy("tree", "leaf").agg(count).where(F.col("n") > 2 * leaf)
        if not sizes.limit(1).count():
            return rows.drop("slabs")
        big = sizes.select(F.col("tree").alias("bt"), F.col("leaf").alias("bl"), F.least(F.lit(slabs), F.ceil(F.col("n") / leaf)).cast("int").alias("c"))
        same = (F.col("tree") == F.col("bt")) & (F.col("leaf") == F.col("bl"))
        at = F.get("slabs", F.col("tree") * 3 + step)
        cuts = rows.join(big, same).groupBy("bt", "bl", "c").agg(F.percentile_approx(at, F.array(*[F.lit((i + 1) / slabs) for i in range(slabs - 1)]), 2_000).alias("cuts"))
        inside = F.size(F.filter("cuts", lambda x: x < at)) * F.col("c")
        rows = rows.join(cuts, same, "left").withColumn("leaf", F.col("leaf") * slabs + F.coalesce(F.floor(inside / slabs), F.lit(0)))
        rows = common.written(rows.select("nid", "vec", "slabs", "tree", "leaf"), "leaves")
    sizes = rows.groupBy(F.col("tree").alias("bt"), F.col("leaf").alias("bl")).agg(F.ceil(F.count(F.lit(1)) / (2 * leaf)).alias("c"))
    dealt = rows.join(sizes, (F.col("tree") == F.col("bt")) & (F.col("leaf") == F.col("bl")))
    return dealt.withColumn("leaf", F.col("leaf") * F.lit(1 << 20) + F.pmod(F.xxhash64("tree", "nid"), F.col("c"))).select("nid", "vec", "tree", "leaf")


def first_graph(nodes: DataFrame, k: int, leaf: int, slabs: int = SLABS) -> DataFrame:
    """The k nearest within the leaves of a few trees of planes."""

    def near(x: pa.Table) -> pa.Table:
        ids = x.column("nid").to_numpy()
        d = squares(_matrix(x.column("vec")))
        np.fill_diagonal(d, np.inf)
        m = min(k, len(ids) - 1)
        if m < 1:
            return _graph_table(ids, *(np.zeros(0, np.int64) for _ in range(4)))
        top = np.argpartition(d, m - 1, 1)[:, :m]
        return _graph_table(ids, np.repeat(np.arange(len(ids)), m), ids[top].ravel(), np.take_along_axis(d, top, 1).ravel(), np.ones(top.size))

    rows = leaf_rows(nodes, leaf, slabs)
    return merged(rows.groupBy("tree", "leaf").applyInArrow(near, GRAPH), k)


def local_join(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The block's part of a round: where two members of a group (via) are closer than the farther one's list reaches, and one of them is new, each is a candidate of the other. Returned are the k nearest candidates of each node, in rows of GRAPH."""
    nothing = _graph_table(np.zeros(0, np.int64), *(np.zeros(0, np.int64) for _ in range(4)))
    if not left.num_rows or not right.num_rows:
        return nothing
    order = np.argsort(right.column("a").to_numpy())
    known, far = right.column("a").to_numpy()[order], right.column("far").to_numpy()[order]
    v = _matrix(right.column("vec"))[order]
    row, member = _flat(left.column("ids"))
    _, new = _flat(left.column("new"))
    via = left.column("via").to_numpy()[row]
    order = np.lexsort((-new, member, via))
    via, member, new = via[order], member[order], new[order]
    first = np.ones(len(via), bool)
    first[1:] = (via[1:] != via[:-1]) | (member[1:] != member[:-1])
    via, at, new = via[first], np.searchsorted(known, member[first]), new[first] > 0
    start = np.flatnonzero(np.concatenate([[True], via[1:] != via[:-1]]))
    size = np.diff(np.append(start, len(via)))
    use = np.flatnonzero(np.logical_or.reduceat(new, start) & (size > 1))
    use = use[np.argsort(size[use], kind="stable")]
    found: list[tuple[np.ndarray, ...]] = []
    many, done = 0, 0

    def shrink() -> None:
        nonlocal found, many
        a, b, d = (np.concatenate([f[i] for f in found]) for i in range(3))
        a, b, d, _ = best(a, b, d, np.ones(len(a), np.int8), k)
        found, many = [(a, b, d)], len(a)

    while done < len(use):
        width = int(size[use[min(done + 255, len(use) - 1)]])
        n = max(1, min(256, (1 << 22) // (width * max(width, v.shape[1]))))
        group = use[done : done + n]
        done += n
        width = int(size[group[-1]])
        col = np.arange(width)
        there = col[None] < size[group][:, None]
        place = np.where(there, start[group][:, None] + col[None], start[group][:, None])
        who, fresh = at[place], new[place] & there
        d = squares(v[who])
        ok = there[:, :, None] & there[:, None] & (fresh[:, :, None] | fresh[:, None]) & (d < far[who][:, :, None])
        ok &= ~np.eye(width, dtype=bool)
        g, i, j = np.nonzero(ok)
        found.append((who[g, i], who[g, j], d[g, i, j]))
        many += len(g)
        if many > 4_000_000:
            shrink()
    if not many:
        return nothing
    shrink()
    a, b, d = found[0]
    nid, row = np.unique(a, return_inverse=True)
    return _graph_table(known[nid], row, known[b], d, np.ones(len(row)))


def incoming(graph: DataFrame, step: int, reverse: int) -> DataFrame:
    """(via, back, fresh): the incoming neighbours of each node that has any, and whether they are new, cut to `reverse` of them by a hash. They are cut before they are exchanged, so a hub costs no more than another node."""
    edges = graph.select("nid", F.explode(F.arrays_zip("ids", "new")).alias("e")).select(F.col("e.ids").alias("via"), F.col("nid").alias("s"), F.col("e.new").alias("new"))
    w = Window.partitionBy("via").orderBy(F.xxhash64(F.lit(step), "via", "s"), "s")
    back = edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= reverse)
    return back.groupBy("via").agg(F.collect_list(F.struct("s", "new")).alias("e")).select("via", F.col("e.s").alias("back"), F.col("e.new").alias("fresh"))


def grouped(graph: DataFrame, step: int, reverse: int) -> DataFrame:
    """(block, via, ids, new): each node's neighbours and incoming ones, where at least one is new. The other groups have no pair left to compare, so neither they nor their vectors travel."""
    rows = graph.select("block", "nid", "ids", "new").join(incoming(graph, step, reverse), F.col("nid") == F.col("via"), "left")
    both = rows.select("block", F.col("nid").alias("via"), F.concat("ids", F.coalesce("back", F.array().cast("array<bigint>"))).alias("ids"), F.concat("new", F.coalesce("fresh", F.array().cast("array<int>"))).alias("new"))
    return both.where(F.array_contains("new", 1))


def descend(graph: DataFrame, groups: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Rows of GRAPH with closer neighbours found where two nodes are neighbours of a third, at least one of them newly so. A block has its own vectors at hand; those of other blocks are joined once for each block that needs them."""
    needed = groups.select("block", F.explode("ids").alias("n")).where(F.shiftright("n", 32) != F.col("block")).distinct()
    reach = graph.select(F.col("nid").alias("g"), F.when(F.size("ids") < k, F.lit(float("inf")).cast("float")).otherwise(F.element_at("ds", -1)).alias("far"))
    held = nodes.select("nid", "vec").join(reach, F.col("nid") == F.col("g")).select(F.col("nid").alias("a"), "vec", "far")
    foreign = needed.join(held, F.col("n") == F.col("a")).select(F.col("block").alias("home"), "a", "vec", "far")
    sent = held.select(F.shiftright("a", 32).alias("home"), "a", "vec", "far").union(foreign)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return local_join(left, right, k)

    return groups.groupBy("block").cogroup(sent.groupBy("home")).applyInArrow(run, GRAPH)


def neighbour_graph(nodes: DataFrame, n: int, k: int = K, reverse: int = REVERSE, leaf: int = LEAF, slabs: int = SLABS) -> DataFrame:
    """block, nid, ids, ds, new of every node: rounds go on until one changes less than a neighbour in a hundred. The lists only get nearer, so that comes. Each round is a written table."""
    graph = common.written(first_graph(nodes, k, leaf, slabs), "graph")
    step = 0
    while True:
        groups = common.written(grouped(graph, step, reverse), "groups")
        found = descend(graph, groups, nodes, k)
        old = graph.withColumn("new", F.transform("new", lambda x: F.lit(0)))
        following = common.written(merged(old.union(found), k), "graph")
        changed = following.agg(F.sum(F.aggregate("new", F.lit(0), lambda a, x: a + x)).alias("c")).first()["c"] or 0
        common.dropped(graph)
        common.dropped(groups)
        graph, step = following, step + 1
        if changed < 0.01 * n * k:
            return graph


def measured(asked: DataFrame, own: DataFrame, nodes: DataFrame, column: str, measure, spec: str) -> DataFrame:
    """measure(left, right) for each block's share of the pairs asked (qid, w), with what own (qid, q, far) says of the query, and the block's nodes (nid, column). A query's vector travels once to each block that it needs, and a block's vectors only where they are asked for; more than ASKED queries of a block are dealt to several tasks."""
    rows = asked.groupBy("qid", F.shiftright("w", 32).alias("block")).agg(F.collect_set("w").alias("ws"))
    rows = common.written(rows.join(own.withColumnRenamed("qid", "oq"), F.col("qid") == F.col("oq")).drop("oq"), "asked")
    parts = rows.groupBy(F.col("block").alias("b")).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("c"))
    left = rows.join(parts, F.col("block") == F.col("b")).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("c")).cast("int")).drop("b", "c")
    right = nodes.select("block", "nid", column).join(parts, F.col("block") == F.col("b")).select(F.col("block").alias("home"), "nid", column, F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("room"))
    return left.groupBy("block", "part").cogroup(right.groupBy("home", "room")).applyInArrow(measure, spec)


def _met(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of left, row of right and node of each pair."""
    row, w = _flat(left.column("ws"))
    nid = right.column("nid").to_numpy()
    order = np.argsort(nid)
    return row, order[np.searchsorted(nid[order], w)], w


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, ef: int = EF, reverse: int = REVERSE) -> DataFrame:
    """(qid, ids): the ef nearest nodes that a greedy walk finds for each node of queries (qid), from itself and its neighbours.

    The walk goes along neighbours and incoming ones. In a round every query opens all nodes that it keeps and hasn't opened; it ends when no query has any. The pools are written tables; the graph and the vectors are joined by key, so neither is gathered anywhere.
    """
    spec = "qid bigint, ids array<bigint>, ds array<float>, new array<int>"
    own = queries.join(nodes.select("nid", "vec"), F.col("qid") == F.col("nid")).select("qid", F.col("vec").alias("q"))
    own = common.written(own, "asking")
    both_ways = graph.select(F.col("nid").alias("via"), "ids").union(incoming(graph, 0, reverse).select("via", "back"))
    links = common.written(both_ways.groupBy(F.col("via").alias("g")).agg(F.flatten(F.collect_list("ids")).alias("next")), "links")
    starts = own.select("qid").join(graph, F.col("qid") == F.col("nid"))
    pool = starts.select("qid", F.concat(F.array("nid"), "ids").alias("ids"), F.concat(F.array(F.lit(0.0).cast("float")), "ds").alias("ds"), F.concat(F.array(F.lit(0)), F.transform("ids", lambda x: F.lit(1))).alias("new"))
    pool = common.written(pool, "pool")
    buckets = max(1, math.ceil(own.count() / 5_000))

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64()), *_lists(0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int32))], names=["qid", "ids", "ds", "new"])
        if not left.num_rows or not right.num_rows:
            return none
        row, at, w = _met(left, right)
        q, v, far = _matrix(left.column("q")), _matrix(right.column("vec")), left.column("far").to_numpy()
        d = np.concatenate([((q[row[a : a + 65_536]] - v[at[a : a + 65_536]]) ** 2).sum(1) for a in range(0, len(row), 65_536)])
        keep = d < far[row]
        row, w, d = row[keep], w[keep], d[keep]
        return pa.table([left.column("qid").combine_chunks(), *_lists(left.num_rows, row, w, d, np.ones(len(w), np.int32))], names=["qid", "ids", "ds", "new"])

    def keep(x: pa.Table) -> pa.Table:
        qid, at = np.unique(x.column("qid").to_numpy(), return_inverse=True)
        row, ids = _flat(x.column("ids"))
        _, d = _flat(x.column("ds"))
        _, new = _flat(x.column("new"))
        return pa.table([pa.array(qid), *_lists(len(qid), *best(at[row], ids, d, new, ef))], names=["qid", "ids", "ds", "new"])

    while True:
        open_ = pool.select("qid", F.explode(F.arrays_zip("ids", "new")).alias("e")).where("e.new = 1").select("qid", F.col("e.ids").alias("at"))
        step = open_.join(links, F.col("at") == F.col("g")).select("qid", F.explode("next").alias("w"))
        far = pool.select(F.col("qid").alias("fq"), F.when(F.size("ids") < ef, F.lit(float("inf")).cast("float")).otherwise(F.element_at("ds", -1)).alias("far"))
        found = measured(step, own.join(far, F.col("qid") == F.col("fq")).select("qid", "q", "far"), nodes, "vec", measure, spec)
        both = pool.withColumn("new", F.transform("new", lambda x: F.lit(0))).union(found)
        following = common.written(both.groupBy(F.pmod(F.xxhash64("qid"), F.lit(buckets))).applyInArrow(keep, spec), "pool")
        opened = following.agg(F.sum(F.aggregate("new", F.lit(0), lambda a, x: a + x)).alias("c")).first()["c"] or 0
        common.dropped(pool)
        pool = following
        if not opened:
            return pool.select("qid", "ids")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision; where squares leave the range, the differences are scaled first."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        diff = a - b
        out = np.sqrt((diff**2).sum(1))
        odd = ~np.isfinite(out) | (out < 1e-140)
        if odd.any():
            x = a[odd] / 2 - b[odd] / 2
            m = np.abs(x).max(1)
            safe = np.where(m > 0, m, 1)
            out[odd] = 2 * (m * np.sqrt(((x / safe[:, None]) ** 2).sum(1)))
    return out


def rescored(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, c, score) of pairs (qid, w): exact distances of the original vectors."""
    own = nodes.select(F.col("nid").alias("qid"), F.col("v").alias("q"))

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        row, at, w = _met(left, right)
        q, v = (_flat(x)[1].astype(np.float64).reshape(len(x), -1) for x in (left.column("q"), right.column("v")))
        score = np.concatenate([distances(q[row[a : a + 65_536]], v[at[a : a + 65_536]]) for a in range(0, len(row), 65_536)])
        return pa.table({"qid": left.column("qid").to_numpy()[row], "c": w, "score": score})

    return measured(pairs, own, nodes, "v", measure, "qid bigint, c bigint, score double")


def nearest(vectors: DataFrame, id_: str, vector: str, every: int = 100, top: int = 10, sample: int = SAMPLE, leaf: int = LEAF, trees: int = TREES, k: int = K, ef: int = EF, slabs: int = SLABS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found for each row whose id is divisible by `every`, among all other rows.

    Equal vectors are one node of the graph with its `top` + 1 smallest ids, which is exact: no query returns more. Every row is a candidate, so of rows that share an id only the query's own is left out, and each of them asks for itself. Scores are Euclidean distances of the original vectors in double precision, ties go to the smaller id; with fewer candidates all come back. The graph's own distances are in single precision of centred and scaled vectors, so they hold at any magnitude; vectors that differ by less than about 1e-7 of the spread are told apart only by the scores at the end. No valid vectors: no rows.
    """
    rows = valid(vectors, id_, vector)
    classes = common.written(rows.groupBy("h1", "h2").agg(F.first("v").alias("v")), "classes")
    n = classes.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = len(classes.first()["v"])
    most = max(1, min(sample, SAMPLE_BYTES // (8 * dim)))
    draw = F.xxhash64(F.lit(4), "h1", "h2")
    share = min(1.0, 1.5 * most / n)
    drawn = classes.where(F.pmod(draw, F.lit(1_000_000)) <= int(1_000_000 * share)).orderBy(draw).limit(most).select("v").toArrow().column("v")
    rows_, depth = placed(classes, np.asarray(drawn.combine_chunks().flatten(), np.float64).reshape(-1, dim), n, trees, leaf)
    nodes = common.written(numbered(common.written(rows_, "placed"), n, depth, max(256, block_bytes // (4 * dim * (k + REVERSE)))), "nodes")
    names = nodes.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "nid")
    named = rows.groupBy("h1", "h2", "vec_id").agg(F.count(F.lit(1)).alias("copies"))
    named = common.written(named.join(names, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select("vec_id", "copies", "nid"), "named")
    graph = neighbour_graph(nodes, n, k, leaf=leaf, slabs=slabs)
    asking = named.where(F.col("vec_id") % every == 0)
    found = search(graph, nodes, asking.select(F.col("nid").alias("qid")).distinct(), ef)
    scored = rescored(found.select("qid", F.explode("ids").alias("w")), nodes)
    # the rows of each class, by their least ids: at most top + 1 of them are of use
    sizes = named.groupBy(F.col("nid").alias("cn")).agg(F.count(F.lit(1)).alias("kinds"), F.min("vec_id").alias("least"), F.min("copies").alias("times"))
    many = sizes.where("kinds > 1").select("cn")
    several = common.first_ids(named.join(many, F.col("nid") == F.col("cn")).select("vec_id", "nid"), "nid", "vec_id", top + 1)
    copies = named.where("copies > 1").select(F.col("nid").alias("xn"), "vec_id", F.least("copies", F.lit(top)).cast("int").alias("times"))
    extra = copies.join(many, F.col("xn") == F.col("cn")).groupBy("xn").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.expr("array_repeat(vec_id, times - 1)")))), 1, top + 1).alias("extra"))
    several = several.join(extra, F.col("nid") == F.col("xn"), "left").select("nid", F.slice(F.array_sort(F.concat("members", F.coalesce("extra", F.array().cast("array<bigint>")))), 1, top + 1).alias("members"))
    members = sizes.where("kinds = 1").select(F.col("cn").alias("nid"), F.expr(f"array_repeat(least, cast(least(times, {top + 1}) as int))").alias("members")).union(several)
    lists = scored.join(members, F.col("c") == F.col("nid")).select("qid", "c", "score", "members")
    at = F.array_position("members", F.col("query_id")).cast("int")
    others = F.when((F.col("c") == F.col("qid")) & (at > 0), F.concat(F.slice("members", F.lit(1), at - 1), F.slice("members", at + 1, F.lit(top + 1)))).otherwise(F.col("members"))
    wide = lists.join(asking.select(F.col("vec_id").alias("query_id"), "copies", F.col("nid").alias("an")), F.col("qid") == F.col("an")).select("query_id", "qid", "copies", "score", F.explode(others).alias("vec_id"))
    best_ = wide.groupBy("query_id", "qid", "copies").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, top).alias("x"))
    each = best_.select("query_id", F.explode(F.expr("array_repeat(0, cast(copies as int))")), "x").select("query_id", F.posexplode("x").alias("p", "e"))
    return each.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all embeddings for each whose vec_id is divisible by 100."""
    return nearest(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
