"""WARC, HTML and neighbour operators against brute force."""

import base64
import collections
import hashlib
import io

import numpy as np
import pytest

from millrace.llm import common, html, nndescent, queries, warc

Q = queries.queries()
CLASH = ("k", 1, "t")


@pytest.fixture(scope="module")
def pages():
    long = "<p>" + "long payload " * 3000 + "é</p>"
    rows = [(i, f"http://x/{i}", f"<html><body><article><p>page {i % 7} words</p></article></body></html>") for i in range(40)]
    return [*rows, (100, None, None), (101, "http://x/\r\ny", ""), (102, "u", long), (103, "u", long), (None, "n", "without an id"), (104, "v", "once"), (104, "v", "once"), (104, "v", "twice")]


@pytest.fixture(scope="module")
def folder(spark, pages, tmp_path_factory):
    d = tmp_path_factory.mktemp("pages")
    spark.createDataFrame([p + CLASH for p in pages], "page_id bigint, url string, html string, key string, chunk int, text string").write.parquet(f"{d}/pages.parquet")
    return str(d)


def test_archives(spark, folder, pages):
    rows = Q["op2_chunked_warc"](spark, folder).collect()
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in rows) == collections.Counter((i, len((h or "").encode()), digest(h or "")) for i, _, h in pages)
    by = {digest(h): i for h, i in largest.items()}
    responses = collections.Counter(r.payload_digest for r in rows if r.record_type == "response")
    assert all(responses[d] == 1 for d in by)
    for r in rows:
        if r.record_type == "response":
            assert r.refers_to is None and r.page_id == (by[r.payload_digest] if by[r.payload_digest] >= 0 else None)
        else:
            assert r.record_type == "revisit" and r.refers_to == by[r.payload_digest]


def test_rows_alike_are_written_in_parts(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_ALIKE", 50)
    df = spark.createDataFrame([(None, "u", None)] * 400 + [(1, "u", "x")] * 120 + [(2, "u", "x")], "page_id bigint, url string, html string")
    assert {(r.d_key[:2], r.n_parts) for r in warc.decided(df).collect()} == {("nu", 8), ("1:", 3), ("2:", 1)}
    rows = warc.read_archives(warc.write_archives(df, common.new_path(spark, "warc"))).where("last").collect()
    assert collections.Counter((r.page_id, r.record_type) for r in rows) == {(None, "response"): 1, (None, "revisit"): 399, (1, "revisit"): 120, (2, "response"): 1}
    assert len({r.record_id for r in rows}) == 521


def test_payloads_are_shuffled_once(spark, monkeypatch):
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in off}
    df = spark.createDataFrame([(7, "u", "x" * 3000)] * 120 + [(i, "u", f"page {i}") for i in range(100, 140)], "page_id bigint, url string, html string")
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        for most in (1_000, 50):  # no key of several parts, one of three
            monkeypatch.setattr(warc, "MAX_ALIKE", most)
            plan = warc.dealt(warc.chunk_rows(df), warc.decided(df))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(") == 2  # of the chunks and of their verdict
            rows = warc.read_archives(warc.write_archives(df, common.new_path(spark, "warc"))).where("last").collect()
            assert collections.Counter((r.page_id == 7, r.record_type) for r in rows) == {(True, "response"): 1, (True, "revisit"): 119, (False, "response"): 40}
            assert len({r.record_id for r in rows}) == 160
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_payloads_come_back_in_chunks(spark, folder, pages):
    manifest = warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"), common.new_path(spark, "warc"), chunk_bytes=1000, max_bytes=2000)
    chunks = warc.read_archives(manifest, chunk_bytes=700).where("record_type = 'response'").collect()
    assert manifest.count() > 1
    got = collections.defaultdict(bytes)
    for r in sorted(chunks, key=lambda r: (r.record_id, r.chunk)):
        assert len(r.data) <= 700
        got[r.record_id] += bytes(r.data)
        assert r.bytes_so_far == len(got[r.record_id]) and r.digest_so_far == base64.b32encode(hashlib.sha1(got[r.record_id]).digest()).decode()
    assert set(got.values()) == {(h or "").encode() for _, _, h in pages}


def test_a_damaged_archive_is_an_error(spark, folder):
    manifest = warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet").where("page_id = 102"), common.new_path(spark, "warc"))
    import gzip

    path = manifest.first().path.removeprefix("file://")
    plain = gzip.decompress(open(path, "rb").read())
    with pytest.raises(ValueError, match="differs"):
        list(warc.records(io.BytesIO(gzip.compress(plain.replace(b"long payload long", b"wrong payload lon", 1)))))
    with pytest.raises((EOFError, ValueError)):
        list(warc.records(io.BytesIO(gzip.compress(plain[:-500]))))


def page(body):
    return f"<!DOCTYPE html><html><head><title>No title</title><style>p{{}}</style></head><body>{body}</body></html>"


WORDS = "some running text with enough words to be content"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<nav><ul><li><a>Home</a></ul></nav><article><h1>Head</h1><p>{WORDS}</p></article><footer>&copy; us</footer>", f"Head\n{WORDS}"),
        (f"<div class='ad'>buy now</div><main><p>A &amp;amp; B&nbsp;&#233; {WORDS}<p>next  \n one {WORDS}</main>", f"A &amp; B é {WORDS}\nnext one {WORDS}"),
        (f"<article><p>{WORDS}</p><script>var a='<p>no</p>';</script><form><input>Search</form><aside>related {WORDS}</aside><p>1 < 2 {WORDS}</p></article><div id='comments'><p>reader says {WORDS}</p></div>", f"{WORDS}\n1 < 2 {WORDS}"),
        (f"<div class='cookie-notice'>accept {WORDS}</div><div><p>{WORDS} <b>bold <i>and</i></b> <a href='x'>link</a>.</p></div><div class='site-footer'>foot</div>", f"{WORDS} bold and link."),
        ("", ""),
        ("<!-- only a comment -->", ""),
        ("<article><p>é<br>x</p>", "é x"),
    ],
)
def test_extraction(body, want):
    assert html.extract(page(body), html.Weights()) == want


def test_best_run_against_all_runs():
    import random

    rng = random.Random(3)
    for _ in range(300):
        x = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 14))]
        a, b = html.best_run(x)
        assert sum(x[a:b]) == max([0.0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))])


def labelled_pages(n):
    """Articles between parts whose class names say nothing to the prior weights."""
    import random

    rng = random.Random(4)
    say = lambda k: " ".join(rng.choice(WORDS.split()) for _ in range(k))
    out = []
    for _ in range(n):
        part = [f"<div class='zq'><p>{say(9)}</p></div><ul class='kw'><li>{say(2)}<li>{say(2)}</ul>", f"<h1>{say(4)}</h1><p>{say(40)}</p><p>{say(12)}</p>", f"<div class='vx'><p>{say(15)}</p><p>{say(8)}</p></div>"]
        text = [t for x in part[1].split("</") for t in [x.split(">")[-1]] if t]
        out.append((part, "\n".join(text)))
    return out


def test_weights_are_learned_from_labelled_pages(spark):
    rows = labelled_pages(80)
    train = spark.createDataFrame([(i, f"{a}<article>{b}</article>{c}") for i, ((a, b, c), _) in enumerate(rows[:40])] + [(900 + i, "<p>no article is named here") for i in range(300)], "page_id bigint, html string")
    weights = html.fit(train, most=40, prior={})
    assert weights.by[".zq"] < -1 and weights.by[".vx"] < -1 and weights.by["article"] > 0
    for (a, b, c), want in rows[40:]:
        assert html.extract(page(f"{a}<article>{b}</article>{c}"), weights) == want
        assert html.extract(page(f"{a}<div>{b}</div>{c}"), weights) == want  # without the label
        assert html.extract(page(f"{a}{b}{c}"), html.Weights({}, 5.0)) != want  # every block taken
        assert html.extract(page(f"{a}{b}{c}"), html.Weights({})) != want


def test_the_region_decides():
    """Of two runs of content with a long menu between them the better one stays, though every block of both scores positive."""
    menu = "<nav>" + "<ul><li><a>x</a></li></ul>" * 300 + "</nav>"
    assert html.extract(page(f"<p>a short note</p>{menu}<p>{WORDS} {WORDS}</p>"), html.Weights()) == f"{WORDS} {WORDS}"
    assert html.extract(page(f"<p>{WORDS} {WORDS}</p><div class=ad>buy</div><p>a short note of few words</p>"), html.Weights()) == f"{WORDS} {WORDS}\na short note of few words"


def test_extraction_takes_linear_time():
    import time

    for text in ("<b>x " * 16_000, "<b>" * 10_000 + "<p>y</p></i>" * 5_000, "<div>" * 16_000 + "x" + "</div>" * 16_000, "<table>" * 8_000 + "<tr><td>z", "<a " * 20_000, "<li>x" * 16_000):
        start = time.perf_counter()
        html.extract(text, html.Weights())
        assert time.perf_counter() - start < 1.0


def test_extraction_of_broken_pages():
    for text in ("", "<", "<p", "</", "<a href='x", "&#xffffff; &nope; x", "<p>" * 3000, "<![CDATA[x", "<!--", "\x00<b>\x00", "<script>never closed"):
        assert isinstance(html.extract(text, html.Weights()), str)


def test_extraction_query(spark, folder, pages):
    rows = Q["op6_maximum_subsequence"](spark, folder).collect()
    assert collections.Counter(r.page_id for r in rows) == collections.Counter(p[0] for p in pages)
    for r in rows:
        assert r.n_chars == len(r.text)
        if r.page_id is not None and r.page_id < 40:
            assert r.text == f"page {r.page_id % 7} words"
        if r.page_id in (100, 101):
            assert r.text == ""


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(i, rows[7][1]) for i in range(2000, 2060)]  # equal vectors
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0, None] + [1.0] * 14), (3004, [float("inf")] * 16), (3005, [1.0] * 3), (None, [1.0] * 16)]
    return rows


def exact(vectors, q, top=10):
    keep = {i: np.array(v, np.float64) for i, v in vectors if i is not None and i < 3000}
    d = sorted((float(np.sqrt(((v - keep[q]) ** 2).sum())), i) for i, v in keep.items() if i != q)
    return d[:top]


def test_neighbours(spark, vectors, tmp_path):
    spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = Q["op9_nn_descent"](spark, str(tmp_path)).collect()
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r)
    asked = [i for i, v in vectors if i is not None and i % 100 == 0 and i < 3000]
    assert sorted(by) == sorted(asked)
    hits = total = 0
    for q, found in by.items():
        want = exact(vectors, q)
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        known = {i: s for s, i in exact(vectors, q, 10_000)}
        assert all(abs(known[r.vec_id] - r.score) < 1e-12 for r in found)
        hits += len({r.vec_id for r in found} & {i for _, i in want})
        total += len(want)
    assert hits / total >= 0.9
    assert [r.vec_id for r in by[2000]] == [7, *range(2001, 2010)]  # ties go to the smaller id


def recall(spark, x, **settings):
    import pyarrow as pa

    kind = pa.float32() if x.dtype == np.float32 else pa.float64()
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.tolist(), pa.list_(kind))}))
    got = collections.defaultdict(set)
    for r in nndescent.nearest(df, "vec_id", "embedding", **settings).collect():
        got[r.query_id].add(r.vec_id)
    y = x.astype(np.float64) / np.abs(x).max()
    hits = total = 0
    for q in range(0, len(x), 100):
        d = ((y - y[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
        total += 10
    return hits / total


def mixture(n, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(6, dim))[np.arange(n) % 6] + rng.normal(size=(n, dim))


@pytest.mark.parametrize("scale, offset, kind", [(1e-9, 0, np.float32), (1e6, 1e9, np.float32), (1e200, 0, np.float64)])
def test_recall_at_any_magnitude(spark, scale, offset, kind):
    assert recall(spark, (mixture(700) * scale + offset).astype(kind)) >= 0.98


def test_recall_with_leaves_beyond_the_planes(spark):
    """A sample of 32 vectors gives shallow trees, so leaves are cut into slabs and nodes dealt to several blocks."""
    assert recall(spark, mixture(1200).astype(np.float32), sample=32, leaf=24, slabs=8, block_bytes=1 << 19) >= 0.95


def test_local_join_against_loops():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    v = rng.normal(size=(30, 4)).astype(np.float32)
    far = rng.uniform(1, 12, 30).astype(np.float32)
    groups = {100 + g: {int(m): int(rng.integers(0, 2)) for m in rng.choice(30, 8, replace=False)} for g in range(12)}
    left = pa.table({"via": list(groups), "ids": [list(g) for g in groups.values()], "new": [list(g.values()) for g in groups.values()]})
    right = pa.table({"a": np.arange(30), "vec": [x.tobytes() for x in v], "far": far})
    out = nndescent.local_join(left, right, 5)
    want = collections.defaultdict(dict)
    for g in groups.values():
        for a, b in ((a, b) for a in g for b in g if a != b and (g[a] or g[b])):
            d = float(((v[a] - v[b]) ** 2).sum())
            if d < far[a]:
                want[a][b] = d
    got = {r["nid"]: r["ids"] for r in out.to_pylist()}
    assert got == {a: sorted(x, key=x.get)[:5] for a, x in want.items()}


def test_rows_that_share_an_id_are_candidates_of_each_other(spark):
    rows = [(100, [0.0, 1.0]), (100, [0.0, 1.0]), (100, [0.0, 2.0]), (1, [0.0, 4.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in nndescent.nearest(df, "vec_id", "embedding").collect())
    near = [(100, 1, 2, 0.0), (100, 2, 2, 0.0), (100, 3, 100, 0.0), (100, 4, 100, 1.0), (100, 5, 1, 3.0)]
    other = [(100, 1, 2, 1.0), (100, 2, 2, 1.0), (100, 3, 100, 1.0), (100, 4, 100, 1.0), (100, 5, 1, 2.0)]
    assert got == collections.Counter(near * 2 + other)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nndescent.nearest(df, "vec_id", "embedding").orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")
    assert nndescent.nearest(one, "vec_id", "embedding").count() == 0
