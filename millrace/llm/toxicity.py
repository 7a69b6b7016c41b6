"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, with thresholds by language."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS = 1 << 22
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: The classifier is fitted on at most so many labelled rows, drawn by a hash of their ids; scoring covers all rows,
MAX_TRAINING = 12_000
#: and on at most so many bytes of their texts, so that long texts and repeated ids can't fill the task that trains.
MAX_TRAINING_BYTES = 1 << 26
SCORE_AT = 0.3
#: Labelled rows of each kind that a language's own threshold needs, and folds for those that have too few besides the fitted ones.
LEAST = 20
FOLDS = 5
SEGMENT = 65_536
#: A word's embedding is that of the word and that of its first bytes, so inflected and compound words count too.
STEM = 6
_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 or b == 39 else 32 for b in range(256))


def word_ids(text: str) -> np.ndarray:
    """(words, 2): the hashed words of the whole text and their hashed beginnings of STEM bytes. Words are runs of letters (and apostrophes, and bytes beyond ASCII), in ASCII lower case."""
    words = text.encode().lower().translate(_LETTERS).split()
    n = len(words)
    out = np.empty((n, 2), np.uint32)
    out[:, 0] = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    out[:, 1] = np.fromiter([zlib.crc32(w[:STEM], 1) for w in words], np.uint32, n)
    return out % np.uint32(BUCKETS)


@dataclass
class Model:
    known: np.ndarray  # sorted buckets (of words and beginnings) that have an embedding
    emb: np.ndarray  # one row each, and a last row of zeros for all others
    filters: dict[int, np.ndarray]  # width: (width, DIM, FILTERS)
    bias: np.ndarray
    w: np.ndarray
    b: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = SCORE_AT

    def table(self) -> np.ndarray:
        """Bucket: row of emb."""
        t = np.full(BUCKETS, len(self.known), np.int32)
        t[self.known] = np.arange(len(self.known), dtype=np.int32)
        return t

    def maps(self, x: np.ndarray) -> np.ndarray:
        """Filter values at each place of a run of rows (places, widths * FILTERS); x ends with two rows of padding, which give no place."""
        n = len(x) - 2
        each = x @ np.concatenate([self.filters[width][k] for width in WIDTHS for k in range(width)], axis=1)
        out, at = np.empty((n, FILTERS * len(WIDTHS)), np.float32), 0
        for i, width in enumerate(WIDTHS):
            own = out[:, i * FILTERS : (i + 1) * FILTERS]
            own[:] = each[:n, at * FILTERS : (at + 1) * FILTERS]
            for k in range(1, width):
                own += each[k : k + n, (at + k) * FILTERS : (at + k + 1) * FILTERS]
            at += width
        return out

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return self.emb[rows[:, 0]] + self.emb[rows[:, 1]]

    def pooled(self, rows: list[np.ndarray]) -> np.ndarray:
        """Max over the words of each document (rows of emb) as first places of a window; zero rows stand between documents, so no window spans two."""
        pad = np.full((2, 2), len(self.emb) - 1, np.int32)
        pieces, owner = [], []
        for i, r in enumerate(rows):
            for a in range(0, max(1, len(r)), SEGMENT):
                piece = r[a : a + SEGMENT + 2] if len(r) else pad[:1]
                pieces += [piece, pad]
                owner.append((i, len(piece) + 2))
        x = self.vectors(np.concatenate([*pieces, pad]))
        starts = np.cumsum([0, *(n for _, n in owner)])[:-1]
        ends = starts + [n - 2 for _, n in owner]
        top = np.maximum.reduceat(self.maps(x), np.stack([starts, ends], 1).ravel(), axis=0)[::2]
        out = np.full((len(rows), top.shape[1]), -np.inf, np.float32)
        np.maximum.at(out, [i for i, _ in owner], top)
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.w + self.b

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(rows)).astype(np.float64), -40, 40)))

    def score_ids(self, ids: list[np.ndarray], table: np.ndarray, most: int = 100_000) -> np.ndarray:
        out, at = [], 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size + len(ids[end]) <= most):
                size += len(ids[end])
                end += 1
            out.append(self.scores([table[i] for i in ids[at:end]]))
            at = end
        return np.concatenate(out) if out else np.zeros(0)


def random_model(known: np.ndarray, seed: int, base: float, kind=np.float32) -> Model:
    """A network that knows nothing but the base rate: small random embeddings, random filters and output weights."""
    rng, size = np.random.default_rng(seed), FILTERS * len(WIDTHS)
    emb = np.zeros((len(known) + 1, DIM), kind)
    emb[:-1] = rng.normal(0, 0.05, (len(known), DIM))
    filters = {width: rng.normal(0, (width * DIM) ** -0.5, (width, DIM, FILTERS)).astype(kind) for width in WIDTHS}
    return Model(known.astype(np.int64), emb, filters, np.zeros(size, kind), rng.normal(0, size**-0.5, size).astype(kind), float(np.log(base / (1 - base))))


def gradients(model: Model, rows: list[np.ndarray], y: np.ndarray) -> tuple[float, dict, np.ndarray, np.ndarray]:
    """The mean logistic loss of a batch, its gradients by filter width, "w", "bias" and "b", and for the embeddings the rows that are touched and their gradients. A maximum passes its gradient to its first place."""
    emb, pad = model.emb, np.full((2, 2), len(model.emb) - 1, np.int32)
    x = np.concatenate([z for r in rows for z in (r if len(r) else pad[:1], pad)] + [pad])
    lengths = [max(1, len(r)) for r in rows]
    starts = np.cumsum([0, *(n + 2 for n in lengths)])[:-1]
    maps = model.maps(model.vectors(x))
    at = np.stack([s + maps[s : s + n].argmax(0) for s, n in zip(starts, lengths)])
    hidden = np.maximum(np.take_along_axis(maps, at, 0) + model.bias, 0)
    z = np.clip(hidden @ model.w + model.b, -40, 40).astype(np.float64)
    g = (1 / (1 + np.exp(-z)) - y) / len(rows)
    d = g[:, None] * model.w * (hidden > 0)
    grads = {"w": g @ hidden, "b": g.sum(), "bias": d.sum(0)}
    touched, parts = [], []
    for n, width in enumerate(WIDTHS):
        cols = slice(n * FILTERS, (n + 1) * FILTERS)
        own = np.zeros(model.filters[width].shape)
        for k in range(width):
            r = x[at[:, cols] + k]
            own[k] = np.einsum("bf,bfd->df", d[:, cols], emb[r[..., 0]] + emb[r[..., 1]])
            touched += [r[..., 0].ravel(), r[..., 1].ravel()]
            parts += [(d[:, cols, None] * model.filters[width][k].T[None]).reshape(-1, DIM)] * 2
        grads[width] = own
    r, back = np.unique(np.concatenate(touched), return_inverse=True)
    ge = np.zeros((len(r), DIM))
    np.add.at(ge, back, np.concatenate(parts))
    ge[r == len(emb) - 1] = 0
    return float((np.logaddexp(0, z) - y * z).mean()), grads, r, ge


def train(ids: list[np.ndarray], labels: np.ndarray, seed: int = 5, epochs: int | None = None, least_docs: int = 2, rate: float = 0.05) -> Model:
    """Fits the network from a random start by Adagrad on the logistic loss; embeddings go at twice the rate.

    A bucket gets an embedding if least_docs training texts hold it. Without labels of both kinds the score is the base rate.
    """
    epochs = epochs or max(4, min(40, 12_000 // max(1, len(ids))))  # more passes over a small sample
    y = labels.astype(np.float64)
    base = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    docs = np.zeros(BUCKETS, np.int32)  # texts that hold a bucket, without gathering all of their words
    for x in ids:
        docs[np.unique(x)] += 1
    known = np.flatnonzero(docs >= least_docs)
    del docs
    model = random_model(known, seed, base)
    if not len(y) or y.min() == y.max():
        model.w[:] = 0
        return model
    rng, table, emb = np.random.default_rng(seed + 1), model.table(), model.emb
    sums = {"emb": np.full((len(emb), 1), 1e-6, np.float32), "bias": np.full(len(model.bias), 1e-6), "w": np.full(len(model.w), 1e-6), "b": 1e-6, **{k: np.full(f.shape, 1e-6) for k, f in model.filters.items()}}
    for _ in range(epochs):
        order, batch, room = rng.permutation(len(ids)), [], 0
        for j, i in enumerate(order):
            batch.append(i)
            room += len(ids[i])
            if len(batch) < 32 and room < 60_000 and j < len(order) - 1:
                continue
            _, grads, r, ge = gradients(model, [table[ids[i]] for i in batch], y[batch])
            sums["emb"][r] += (ge**2).mean(1, keepdims=True)
            emb[r] -= (2 * rate * ge / np.sqrt(sums["emb"][r])).astype(np.float32)
            for k, target in (("w", model.w), ("bias", model.bias), *model.filters.items()):
                sums[k] += grads[k] ** 2
                target -= (rate * grads[k] / np.sqrt(sums[k])).astype(np.float32)
            sums["b"] += grads["b"] ** 2
            model.b -= rate * grads["b"] / np.sqrt(sums["b"])
            batch, room = [], 0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 4 == 2


def add_scores(into: dict[int, list], rows) -> None:
    """Adds rows (bin, n, hits, least, most score) to a histogram."""
    for k, n, hits, lo, hi in rows:
        old = into.get(k, [0, 0, np.inf, -np.inf])
        into[k] = [old[0] + n, old[1] + hits, min(old[2], lo), max(old[3], hi)]


def enough(h: dict[int, list], least: int = LEAST) -> bool:
    hits = sum(x[1] for x in h.values())
    return min(hits, sum(x[0] for x in h.values()) - hits) >= least


def histogram_threshold(h: dict[int, list]) -> float | None:
    """The middle of the best F1's plateau, if there are enough rows of each label."""
    if not enough(h):
        return None
    x = [h[k] for k in sorted(h, reverse=True)]
    n, hit = np.cumsum([r[0] for r in x]), np.cumsum([r[1] for r in x])
    k = int((2 * hit / (n + hit[-1])).argmax())
    return float((x[k][2] + (x[k + 1][3] if k + 1 < len(x) else 0)) / 2)


def score_bin(score: Column) -> Column:
    """Bins of log odds, 20 a unit, so that scores near 0 and 1 keep apart (about 1,600 bins)."""
    return F.floor(20 * (F.log(F.greatest(score, F.lit(1e-18))) - F.log(F.greatest(1 - score, F.lit(1e-18))))).cast("int")


def gathered(it: Iterator[pa.RecordBatch]) -> tuple[list[int], list[str], np.ndarray, list[np.ndarray]]:
    """doc_id, lang, label and hashed words of the training rows, in the order of doc_id and words."""
    rows = []
    for batch in it:
        words = [np.frombuffer(v.as_buffer(), "<u4").reshape(-1, 2) for v in batch.column(3)]
        rows += zip(*(batch.column(k).to_pylist() for k in range(3)), words)
    rows.sort(key=lambda r: (r[0], zlib.crc32(r[3])))
    return [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], np.int64), [r[3] for r in rows]


def fitted_model(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of all training rows."""
    _, _, y, ids = gathered(it)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(ids, y))], pa.binary())], names=["model"])


def fold_scores(few: set[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """lang, label and score of the training rows in the languages `few`, each by a network that hasn't seen its fold."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, lang, y, ids = gathered(it)
        fold = np.array([zlib.crc32(b"fold" + str(i).encode()) % FOLDS for i in doc])
        for k in range(FOLDS):
            asked = [i for i in np.flatnonzero(fold == k) if lang[i] in few]
            if not asked:
                continue
            part = train([ids[i] for i in np.flatnonzero(fold != k)], y[fold != k])
            scores = part.score_ids([ids[i] for i in asked], part.table())
            yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in asked], pa.string()), pa.array(y[asked], pa.int32()), pa.array(scores, pa.float64())], names=["lang", "y", "score"])

    return run


def in_one_task(rows: DataFrame, run: Callable, spec: str) -> pa.Table:
    """What run makes of all rows in one Python worker, so the driver holds neither the rows nor the memory that training takes; the caller has bounded them."""
    return rows.coalesce(1).mapInArrow(run, spec).toArrow()


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, most_bytes: int = MAX_TRAINING_BYTES) -> Model:
    """Trains on four fifths of at most `most` labelled rows that aren't held out, and sets a threshold for each language from the scores of all other ones. lang is used for that alone.

    The sample is drawn by a hash of doc_id, and of its distinct texts by a hash too where they are more than `most` or hold more than most_bytes bytes (a text that doesn't fit in is passed over); that bounds what the one task that trains gathers (hashed words, 8 bytes each); the driver gets the model and the score histogram of each language. A language with under LEAST other rows of a label also counts its fitted rows, scored by networks of FOLDS folds that haven't seen them. Only one that has under LEAST labelled rows of each kind in all takes the threshold of all languages together.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("__y")).where(~held_out(F.col("__id")))
    # labelled rows may have gone in an earlier stage, so the draw is among documents; ids alone are read for it
    ids = common.written(docs.select(F.col("doc_id").cast("long").alias("__id")).distinct().join(known, "__id"), "known")
    apart = F.crc32(F.concat(F.lit("cal"), F.col("__id").cast("string")).cast("binary")) % 5 == 0
    fitted = common.written(ids.orderBy(F.xxhash64(F.lit(1), "__id"), "__id").limit(most).where(~apart), "labelled")
    others = common.written(ids.join(F.broadcast(fitted.select("__id")), "__id", "left_anti"), "others")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    own = F.xxhash64("text")
    chosen = common.written(texts.join(F.broadcast(fitted), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "lang", F.col("__y").alias("y"), own.alias("h")), "chosen")
    sizes = chosen.groupBy("doc_id", "h").agg(F.max(F.octet_length("text")).alias("b"))
    room, taken = most_bytes, []
    for r in sizes.orderBy(F.xxhash64(F.lit(2), "doc_id", "h"), "doc_id", "h").limit(most).collect():
        if r["b"] <= room:
            room -= r["b"]
            taken.append((r["doc_id"], r["h"]))
    if chosen.count() > len(taken):  # repeated rows, or more than the bounds
        take = pa.table([pa.array([t[i] for t in taken], pa.int64()) for i in (0, 1)], names=["ti", "th"])
        take = F.broadcast(docs.sparkSession.createDataFrame(take))
        chosen = chosen.join(take, (F.col("doc_id") == F.col("ti")) & (F.col("h") == F.col("th"))).dropDuplicates(["doc_id", "h"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data = [word_ids(t).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(data, pa.binary())], names=["doc_id", "lang", "y", "ids"])

    training = common.written(chosen.select("doc_id", "text", "lang", "y").mapInArrow(run, "doc_id bigint, lang string, y int, ids binary"), "training")  # at most `most` rows and most_bytes bytes
    model = pickle.loads(in_one_task(training, fitted_model, "model binary").column("model")[0].as_py())

    small = others.count() <= 1_000_000
    rest = texts.join(F.broadcast(others) if small else others, F.col("doc_id") == F.col("__id")).select("text", "lang", "__y")
    score = F.col("__score")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("__y").alias("hits"), F.min(score).alias("lo"), F.max(score).alias("hi")]
    scores: dict[str, dict[int, list]] = {}
    for r in scored(rest, model).groupBy("lang", score_bin(score).alias("bin")).agg(*sums).collect():  # about 1,600 rows a language at most
        add_scores(scores.setdefault(r["lang"], {}), [tuple(r)[1:]])
    own_counts = training.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") != 0).alias("hits")).collect()  # a row a language
    few = {r["lang"] for r in own_counts if enough({**scores.get(r["lang"], {}), None: [r["n"], r["hits"], 0, 0]}) and not enough(scores.get(r["lang"], {}))}
    if few:
        found = in_one_task(training, fold_scores(few), "lang string, y int, score double")
        for l, v, s in zip(*(found.column(k).to_pylist() for k in range(3))):
            at = int(np.floor(20 * (np.log(max(s, 1e-18)) - np.log(max(1 - s, 1e-18)))))
            add_scores(scores.setdefault(l, {}), [(at, 1, v, s, s)])
    together: dict[int, list] = {}
    for h in scores.values():
        add_scores(together, [(k, *x) for k, x in h.items()])
    model.threshold = histogram_threshold(together) or SCORE_AT
    model.thresholds = {l: t for l, h in sorted(scores.items()) if (t := histogram_threshold(h)) is not None}
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score` (float64) added; every whole text is scored, null and empty ones as texts without words."""
    names = docs.columns
    spec = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        at = names.index("text")
        for whole in it:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                ids = [word_ids(t or "") for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score_ids(ids, table))], names=[*names, "__score"])

    return docs.mapInArrow(run, spec)


def by_language(model: Model) -> Column:
    out = F.lit(model.threshold)
    for l, t in sorted(model.thresholds.items()):
        out = F.when(F.coalesce(F.col("lang"), F.lit("")) == l, F.lit(t)).otherwise(out)
    return out


def op7_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents: doc_id, held_out, score, predicted (score >= 0.3), flagged (score >= the language's threshold). A null id isn't held out; a null or empty text is scored as one without words, rows with repeated ids each by its text; of several labels of an id the greatest counts."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    out = scored(rows, model).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= SCORE_AT).cast("int").alias("predicted"), (F.col("__score") >= by_language(model)).alias("flagged"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose score is below their language's threshold. Null and empty texts are scored as texts without words, a null language takes the threshold of the empty one or of all, repeated rows stay or go together, all columns stay whatever their names; an empty table gives no rows."""
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model).where(F.col("__score") < by_language(model)).drop("__score")
