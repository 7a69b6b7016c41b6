"""The operators on documents against brute force."""

import collections
import itertools
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, mixing, neardup, packing, quality, queries, sharding, tokens, toxicity, wavelet

P = pytest.importorskip("public_tokenizers")
Q = queries.queries()


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(name, spark, empty):
    assert Q[name](spark, empty).count() == 0


# 1
def test_pfair_windows():
    for weights in ([1], [1, 1], [5, 3, 2], [7, 1, 1, 1], [13, 11, 5, 2, 1]):
        slots, total = mixing.pfair_period(weights), sum(weights)
        for t in range(total + 1):
            ran = collections.Counter(slots[:t])
            assert all(abs(ran[i] - t * w / total) < 1 for i, w in enumerate(weights))


def naive(blocks, weights):
    """Slot by slot, a new schedule whenever a source has run out."""
    left, out = {s: n for s, n in sorted(blocks.items()) if n}, []
    while left:
        names, t, period = list(left), 0, mixing.pfair_period([weights[s] for s in left])
        while all(left.values()):
            s = names[period[t % len(period)]]
            out.append(s)
            left[s] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_schedule_places_each_block_once():
    rng = random.Random(1)
    for _ in range(30):
        blocks = {f"s{i}": rng.randint(0, 40) for i in range(rng.randint(1, 5))}
        weights = {s: rng.randint(1, 9) for s in blocks}
        slots = {}
        for r in mixing.schedule(blocks, weights):
            for b in range(r["first"], r["last"] + 1):
                k = b - r["first"]
                slots[r["base"] + k // r["w"] * r["total"] + r["slots"][k % r["w"]]] = r["__s"]
        assert [slots[t] for t in range(len(slots))] == naive(blocks, weights)


def test_mix(spark, tables, documents):
    rows = Q["op1_pfair_mix"](spark, tables).collect()
    assert sorted(r.position for r in rows) == list(range(len(documents)))
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d[0] for d in documents)
    rows.sort(key=lambda r: r.position)
    assert all(a.slot <= b.slot for a, b in zip(rows, rows[1:]))
    small = mixing.mix(mixing.narrow(spark.read.parquet(f"{tables}/documents.parquet")), ["doc_id", "crc", "bytes"], {"hot": 2, "s1": 1, mixing.POOL: 1}, block_bytes=500).collect()
    assert sorted(r.position for r in small) == list(range(len(documents)))
    by = collections.defaultdict(set)
    for r in small:
        by[r.slot].add(r.source if r.source in ("hot", "s1") else None)
    assert all(len(v) == 1 for v in by.values())


def test_block_schedule_stays_within_a_block():
    rng = np.random.default_rng(0)
    for n_sources, most, step in ((1, 9, 4), (5, 40, 7), (300, 30, 1000)):
        blocks, weights = rng.integers(1, most, n_sources), rng.integers(1, 1000, n_sources)
        blocks[0] *= 20
        weights[0] = weights.sum()
        out = [(i, j) for a, b in mixing.block_schedule(blocks, weights, step) for i, j in zip(a.tolist(), b.tolist())]
        assert sorted(out) == [(i, j) for i in range(n_sources) for j in range(blocks[i])]
        ran = np.zeros(n_sources)
        for t, (i, j) in enumerate(out, 1):
            assert ran[i] == j
            ran[i] += 1
            low, high = 0.0, float((blocks / weights).max())
            for _ in range(60):  # the clock at which the ideal shares sum to t
                mid = (low + high) / 2
                low, high = (mid, high) if np.minimum(blocks, weights * mid).sum() < t else (low, mid)
            assert np.abs(ran - np.minimum(blocks, weights * high)).max() < 1 + 1e-4


def test_mix_schedules_every_source(spark):
    rng = random.Random(8)
    rows = [(i, f"s{i % 300}" if i < 900 else "hot" if i < 1500 else None, rng.randint(50, 150), i) for i in range(1520)]
    for weights in (None, {"hot": 500, **{f"s{i}": 1 + i % 3 for i in range(300)}}):
        out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, bytes bigint, crc bigint"), ["doc_id"], weights, block_bytes=200).collect()
        assert sorted(r.position for r in out) == list(range(len(rows)))
        slots = collections.defaultdict(set)
        for r in out:
            slots[r.slot].add(r.source)
            if weights and r.source:
                assert r.target_weight == weights[r.source]
        assert all(len(v) == 1 for v in slots.values())
        ordered = sorted(out, key=lambda r: r.position)
        assert all(a.slot <= b.slot for a, b in zip(ordered, ordered[1:]))


# 3
def test_quality_against_sql(spark, tables):
    got = Q["op3_line_frequency"](spark, tables).toPandas()
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tables}/documents.parquet/*.parquet'")
    want = c.sql(quality.SQL).df()
    key = ["doc_id", "n_words", "word_chars"]
    a, b = (x[sorted(want.columns)].sort_values(key).reset_index(drop=True).astype(float) for x in (got, want))
    assert a.equals(b)
    verdict = got[got.doc_id.notna()].drop_duplicates("doc_id").set_index("doc_id")
    assert not verdict.kept[list(range(130, 140))].any() and verdict.kept[list(range(140, 160))].all()
    assert verdict.kept[list(range(130))].all()


def test_repeat_words():
    def brute(words, width=8):
        at = collections.defaultdict(list)
        for i in range(len(words) - width + 1):
            at[tuple(words[i : i + width])].append(i)
        return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(width)})

    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]
        assert quality.repeat_words(words) == brute(words)


def test_quality_stage_removes_lines(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = quality.stage(spark, docs, tables)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert "Shared notice" not in rows[150].text and rows[150].n_chars == len(rows[150].text)
    assert 135 not in rows and 173 not in rows and rows[1].text == docs.where("doc_id = 1").first().text


def test_a_line_of_very_many_documents_goes_whatever_the_host(spark, monkeypatch):
    rows = [(i, f"one {i} word after another in text number {i} so that it has its twenty words and some more to be kept {i}" + ("\nthe line" if i < 60 else ""), "h" if i % 10 else "s") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    removed = lambda **k: {r.doc_id for r in quality.judged(df, **k).where("n_removed > 0").collect()}
    assert removed() == set()  # 54 of 1,800 texts of the host are 3 per cent
    want = {i for i in range(60) if i % 10}
    assert removed(many_docs=50) == want
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert removed(many_docs=50) == want  # by the salted join


# 4
def test_rows_alike_are_spread(spark):
    """100,000 rows without ids and with one text: no bucket or partition holds more than its share."""
    df = spark.range(100_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(7).cast("bigint").alias("size"))
    df = common.written(df, "alike")
    parts = common.packed(df)
    assert parts.count() == 100 and parts.agg(F.sum("__n"), F.max("__n")).first()[:] == (100_000, 1000)
    out = sharding.shuffle_to_shards(df, [F.col("doc_id"), F.col("size")], rows_per_partition=1_000)
    sizes = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d")).collect()
    assert [tuple(r[1:]) for r in sizes] == [(6250, 0, 6249, 6250)] * 16
    few = common.written(df.withColumn("key", F.lit(1)), "few")
    ranks = common.running(few, ["key"], [F.col("doc_id")], 3, 100_000, "size")
    assert ranks.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.max("before"), F.countDistinct("before")).first()[:] == (0, 99_999, 100_000, 7 * 99_999, 100_000)


def test_hypergeometric_draws():
    rng = random.Random(5)
    for good, bad, draws in ((30, 70, 20), (3, 5, 6), (1000, 9000, 500)):
        xs = [sharding.hypergeometric(rng, good, bad, draws) for _ in range(4000)]
        mean = draws * good / (good + bad)
        var = mean * bad / (good + bad) * (good + bad - draws) / (good + bad - 1)
        assert abs(np.mean(xs) - mean) < 5 * (var / 4000) ** 0.5 and 0.85 < np.var(xs) / var < 1.15
    m = sharding.communication_matrix([5, 0, 11, 4], [7, 7, 6], 3)
    assert [sum(r) for r in m] == [5, 0, 11, 4] and [sum(c) for c in zip(*m)] == [7, 7, 6]


def test_shards(spark, tables, documents):
    df = Q["op4_hypergeometric_shards"](spark, tables)
    rows = df.collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(documents) and set(sizes) <= set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))
    want = collections.Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in documents)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# 5 and 10
@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {k: Tokenizer.from_file(P.path(f)) for k, f in (("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json"))}


@pytest.mark.parametrize("kind, file", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_tokens_are_those_of_the_whole_text(kind, file, libraries, documents):
    rng = random.Random(4)
    bits = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "1", "é", "É", ",", "Σ", "\xa0", "\x1c", "\x85", "ſ", "İ", "²", "×", "汉", "\U0001f600", "<|endoftext|>", "<|"]
    texts = [d[1] or "" for d in documents] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    t = tokens.WordTokenizer(P.path(file), kind, most=500)
    got = [x for a, b in tokens.batches(texts, 2_000) for x in t.encode(texts[a:b])]
    for text, ids, want in zip(texts, got, libraries[kind].encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, repr(text)


def test_wavelet_file():
    rng = np.random.default_rng(0)
    for n in (0, 1, 9, 5000, 140_000):
        x = (rng.zipf(1.4, n) % 50_257).astype("<u2")
        m = wavelet.WaveletMatrix(wavelet.build(x, 16, [1], [n]))
        assert (m.all() == x).all()
        for i in rng.integers(0, n, 25).tolist() if n else []:
            t = int(x[i])
            at = np.flatnonzero(x == t)
            assert m.access(i) == t and m.count(t) == len(at) and m.count(t, i) == (at < i).sum() and m.select(t, len(at) - 1) == at[-1]
        assert m.count(65_000) == 0
    with pytest.raises(IndexError):
        m.select(65_000, 0)


def test_wavelet_files_hold_several_matrices(spark, documents):
    df = spark.createDataFrame([(None, "no id " * 3)] * 300 + [(d[0], d[1]) for d in documents], "doc_id bigint, text string").repartition(4)
    folder = common.new_path(spark, "wavelet")
    made = wavelet.write_shards(df, P.path("byte_bpe_50k.json"), folder, max_tokens=1_000, file_bytes=6_000)
    made = common.written(made, "shards")
    rows = made.collect()
    assert len(rows) > len({r.path for r in rows}) > 1
    got = sorted(wavelet.read_shards(made).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in df.collect()), key=lambda i: (i is not None, i or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    with wavelet.ShardFile(rows[0].path) as f:
        first = next(f.matrices())
        x = first.all().tolist()
        assert [first.access(i) for i in range(40)] == x[:40] and first.count(x[7]) == x.count(x[7]) and first.select(x[7], 0) == x.index(x[7])


def test_wavelet_round_trip(spark, tables, documents, libraries):
    rows = Q["op5_wavelet_matrix"](spark, tables).collect()
    docs = sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0))
    at = 0
    got = sorted(rows, key=lambda r: r.start)
    assert len(rows) == len(docs)
    for d, r in zip(docs, got):
        ids = [*libraries["byte"].encode(d[1] or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_best_fill():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(0, 4))}
        room = rng.randint(0, 40)
        items = [l for l, c in counts.items() for _ in range(c)]
        sums = {sum(s) for k in range(len(items) + 1) for s in itertools.combinations(items, k)}
        used = packing.best_fill(counts, room)
        assert all(m <= counts[l] for l, m in used.items()) and sum(l * m for l, m in used.items()) == max(s for s in sums if s <= room)


def test_packing(spark, tables, documents, libraries):
    rows = Q["op10_minimum_bin_slack"](spark, tables).collect()
    want = collections.Counter()
    for d in documents:
        ids = np.array([*libraries["word"].encode(d[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((d[0], s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1


# 7
def test_toxicity_held_out(spark, tables, documents):
    rows = Q["op7_convolutional_toxicity"](spark, tables).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d[0] for d in documents)
    text = {d[0]: d[1] or "" for d in documents}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert np.mean([r.predicted == ("zorgle" in text[r.doc_id]) for r in rows if r.doc_id is not None and r.doc_id < 160]) > 0.97


def sample_model(kind=np.float64):
    m = toxicity.random_model(np.arange(20), 3, 0.3, kind)
    rng = np.random.default_rng(1)
    m.emb[:-1] = rng.normal(0, 1, m.emb[:-1].shape)
    m.bias[:] = rng.normal(0, 0.1, m.bias.shape)
    return m, [rng.integers(0, 21, (n, 2)).astype(np.int32) for n in (1, 2, 3, 7, 0, 12)]


def test_convolution_against_loops():
    m, rows = sample_model()
    for r, got in zip(rows, m.logits(m.pooled(rows))):
        x = [m.emb[a] + m.emb[b] for a, b in r] + [np.zeros(toxicity.DIM)] * 2
        z, j = m.b, 0
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                top = max(sum(float(x[i + k] @ m.filters[width][k, :, f]) for k in range(width) if i + k < len(x)) for i in range(max(1, len(r))))
                z += max(0.0, top + m.bias[j]) * m.w[j]
                j += 1
        assert got == pytest.approx(z, abs=1e-5)


def test_gradients_against_differences():
    m, rows = sample_model()
    maps = m.maps
    m.maps = lambda x: sum_maps(m, x)  # in double precision
    y = np.array([1.0, 0, 1, 0, 1, 0])
    _, grads, touched, ge = toxicity.gradients(m, rows, y)
    m.maps = maps
    rng = np.random.default_rng(2)
    whole = np.zeros(m.emb.shape)
    whole[touched] = ge
    for part, g in [(m.w, grads["w"]), (m.bias, grads["bias"]), (m.emb, whole)] + [(m.filters[k], grads[k]) for k in toxicity.WIDTHS]:
        for _ in range(8):
            at = tuple(int(rng.integers(0, n - (part is m.emb and d == 0))) for d, n in enumerate(part.shape))
            old, loss = part[at], []
            for step in (1e-6, -1e-6):
                part[at] = old + step
                m.maps = lambda x: sum_maps(m, x)
                loss.append(toxicity.gradients(m, rows, y)[0])
            part[at] = old
            assert (loss[0] - loss[1]) / 2e-6 == pytest.approx(g[at], abs=1e-5)


def sum_maps(m, x):
    n = len(x) - 2
    return np.concatenate([sum(x[k : k + n] @ m.filters[w][k] for k in range(w)) for w in toxicity.WIDTHS], axis=1)


def test_the_network_learns_from_a_random_start():
    rng = random.Random(8)
    made = [(" ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(40)) + (f" {rng.choice(['awful', 'nasty'])} thing" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(900)]
    ids, y = [toxicity.word_ids(t) for t, _ in made], np.array([v for _, v in made])

    def area(rate):
        m = toxicity.train(ids[:600], y[:600], rate=rate)
        s = m.score_ids(ids[600:], m.table())
        hit, miss = s[y[600:] == 1], s[y[600:] == 0]
        return (hit[:, None] > miss[None]).mean() + (hit[:, None] == miss[None]).mean() / 2

    assert area(0.05) > 0.95
    assert 0.3 < area(0.0) < 0.7  # what the start alone knows


def test_training_rows_are_bounded_by_bytes(spark):
    docs = [(1, "bad " * 50 + str(i)) for i in range(300)] + [(2, "x " * 100_000)] + [(i, f"good words {i}" + (" bad" if i % 3 == 0 else "")) for i in range(10, 200)]
    d = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id bigint, text string, lang string")
    y = spark.createDataFrame([(i, int(i % 3 == 0 or i == 1)) for i in {i for i, _ in docs}], "doc_id bigint, toxic int")
    m = toxicity.fit(d, y, most=150, most_bytes=6_000)
    assert len(m.known) < 150 * 60 and m.score_ids([toxicity.word_ids("good")], m.table()).shape == (1,)


def test_thresholds_use_all_labelled_rows(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(4000):  # xx has one in 40 rows: too few of a small sample, enough of all; yy has under 20 toxic rows
        lang, toxic = "yy" if i % 100 == 7 else "xx" if i % 40 < 2 else "en", int(i % 3 == 0)
        docs.append((i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(12)) + (" bad word" if toxic else ""), lang))
        labels.append((i, toxic))
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    y = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    assert set(toxicity.fit(d, y, most=500).thresholds) == {"en", "xx"}
    crossed = toxicity.fit(d, y, most=4000)  # a fifth of xx is not enough, its fitted rows are scored by folds
    assert set(crossed.thresholds) == {"en", "xx"} and all(0 < t < 1 for t in crossed.thresholds.values())


def test_training_stays_out_of_the_driver(spark, monkeypatch):
    rng, here, inner = random.Random(9), os.getpid(), toxicity.train
    docs = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(12)) + (" bad word" if i % 3 == 0 else ""), "en") for i in range(240)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(4)
    y = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id bigint, toxic int")

    def train(*args, **more):
        assert os.getpid() != here, "the driver trains"
        return inner(*args, **more)

    monkeypatch.setattr(toxicity, "train", train)
    m = toxicity.fit(d, y)
    assert sum(i % 3 == 0 and zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(f"cal{i}".encode()) % 5 == 0 for i in range(240)) < toxicity.LEAST
    assert set(m.thresholds) == {"en"}  # from networks of folds
    chosen = [(i, t) for i, t, _ in docs if zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(f"cal{i}".encode()) % 5]
    want = inner([toxicity.word_ids(t) for _, t in chosen], np.array([int(i % 3 == 0) for i, _ in chosen]))
    assert (m.known == want.known).all() and np.allclose(m.emb, want.emb, atol=1e-3) and np.allclose(m.w, want.w, atol=1e-3)


def test_histogram_threshold():
    rng = np.random.default_rng(1)
    y = rng.random(500) < 0.3
    s = np.clip(rng.normal(0.4 + 0.3 * y, 0.1), 0.01, 0.99)
    h = {}
    toxicity.add_scores(h, [(k, 1, int(v), s[k], s[k]) for k, v in zip(range(500), y)])
    h = dict(zip(np.argsort(np.argsort(s)).tolist(), h.values()))  # a bin for each score
    f1 = lambda t: 2 * (y & (s >= t)).sum() / ((s >= t).sum() + y.sum())
    assert f1(toxicity.histogram_threshold(h)) == max(f1(t) for t in s)
    assert toxicity.histogram_threshold({0: [30, 19, 0.1, 0.9]}) is None


def test_toxicity_without_labels():
    m = toxicity.train([], np.zeros(0))
    assert m.score_ids([toxicity.word_ids(""), toxicity.word_ids("a b c")], m.table()).tolist() == pytest.approx([0.001, 0.001])


def test_long_text_scores_by_its_segments():
    rng = random.Random(7)
    ids = [toxicity.word_ids(" ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + (" bad word" if i % 2 else "")) for i in range(60)]
    m = toxicity.train(ids, np.array([i % 2 for i in range(60)]))
    long = toxicity.word_ids("abc " * 70_000 + "bad word")
    assert m.score_ids([long], m.table())[0] > 0.5 > m.score_ids([toxicity.word_ids("abc " * 70_000)], m.table())[0]


# 8
def words_of(text):
    return (text or "").encode().lower().split()


def brute_components(documents):
    sets = {}
    for d in documents:
        w = words_of(d[1])
        sets[d[0]] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    of = {i: i for i in sets if i is not None}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in itertools.combinations(sorted(of), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((find(a), find(b)))
            of[b] = a
    return sets, {i: find(i) for i in of}


def test_near_duplicates(spark, tables, documents):
    sets, want = brute_components(documents)
    rows = Q["op8_setsketch_near_duplicates"](spark, tables).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        else:
            assert r.kept
    assert len({want[i] for i in range(120, 130)}) == 1


def test_texts_of_a_repeated_id(spark):
    """Both texts of doc 5 have near copies; an exact copy of one stands under two ids that have other texts too."""
    rng = random.Random(9)
    w, z, y = (" ".join(rng.choice("abcdefgh") * 2 + str(rng.randint(0, 999)) for _ in range(31)) for _ in range(3))
    rows = [(5, w), (5, z), (7, w + " more"), (8, z + " more"), (20, y), (9, y), (9, w + " other"), (30, "quite alone here today"), (30, "another text of thirty altogether")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.linked(df).collect())
    assert got == collections.Counter([(5, 28, 5, True), (5, 28, 5, True), (7, 29, 5, False), (8, 29, 5, False), (20, 28, 5, False), (9, 28, 5, False), (9, 29, 5, False), (30, 1, 30, True), (30, 2, 30, True)])
    kept = neardup.stage(spark, df, "").collect()
    assert collections.Counter(r.doc_id for r in kept) == {5: 1, 30: 1}


def test_setsketch():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        n = 4_000
        both = int(2 * n * share / (1 + share))
        x = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
        a, b = np.sort(x[:n]), np.sort(x[n - both :])
        sa, sb = neardup.sketch(a), neardup.sketch(b)
        assert (neardup.merged(sa, sb) == neardup.sketch(np.union1d(a, b))).all()
        j = neardup.estimate(sa[None], sb[None], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(j - share) < 5 * (share * (1 - share) / neardup.REGISTERS) ** 0.5


def test_rest_finds_what_no_pivot_stood_for(spark):
    """Two links in one bucket, neither of them to the pivot."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    mutated = lambda x, k, seed: np.unique(np.concatenate([np.random.default_rng(seed).permutation(x)[k:], np.random.default_rng(seed + 99).integers(0, 1 << 62, k).astype(np.uint64)]))
    sets = {1: np.unique(base), 2: mutated(base, 90, 1), 3: mutated(base, 90, 2)}
    sets[12], sets[13] = mutated(sets[2], 15, 5), mutated(sets[3], 15, 6)
    nodes = spark.createDataFrame([(i, len(s), b"", neardup.sketch(s).tobytes()) for i, s in sets.items()], "node bigint, n bigint, digest binary, sketch binary")
    full = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in sets.items()], "node bigint, s array<bigint>")
    labels = spark.createDataFrame([], "node bigint, component bigint")
    pairs = neardup.rest(neardup.memberships(nodes), nodes, full, labels, 80)
    got = {(r.a, r.b) for r in neardup.confirmed(pairs, full, 80).collect()}
    assert got == {(2, 12), (3, 13)}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.component for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
