"""The pipeline: each stage on its own input, and all of them together."""

import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tables, tmp_path):
    from test_documents import brute_components

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        before = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        ids, kept = (collections.Counter(r.doc_id for r in x) for x in (before, after))
        if name == "near_duplicates":
            _, component = brute_components([(r.doc_id, r.text) for r in before])
            assert set(kept) - {None} == {i for i, c in component.items() if i == c}
        elif name == "mixing":
            assert kept == ids
        elif name == "toxicity":
            clean = {r.doc_id for r in before if r.doc_id is not None and "zorgle" not in r.text and r.doc_id < 160}
            assert clean <= set(kept) and not any("zorgle" in r.text for r in after)
        elif name == "packing":
            assert set(kept) == set(ids)
            assert sum(r.length for r in after) == sum(r.doc_tokens for r in after if r.start == 0)


def test_run(spark, tables, empty):
    assert corpus_pipeline.run(spark, tables).count() > 50
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_sequences_follow_the_mixture(spark, tmp_path, monkeypatch):
    import random

    from conftest import WORDS
    from millrace.llm import mixing

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(100, 900))), "a" if i % 2 else "b") for i in range(800)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    source = {r[0]: r[2] for r in rows}

    def early(weights):
        """The share of a's ids in the first quarter of the sequences."""
        stages = [("mixing", lambda *x: mixing.stage(*x, weights=weights))] if weights else []
        monkeypatch.setattr(corpus_pipeline, "STAGES", stages + [s for s in corpus_pipeline.STAGES if s[0] == "packing"])
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        n = max(r.sequence_id for r in out) + 1
        assert {r.sequence_id for r in out} == set(range(n)) and {r.doc_id for r in out} == set(source)
        room = collections.defaultdict(list)
        for r in out:
            room[r.sequence_id].append((r.offset, r.length))
        for v in room.values():  # pieces follow each other without a gap
            assert [o for o, _ in sorted(v)] == [sum(l for _, l in sorted(v)[:i]) for i in range(len(v))] and sum(l for _, l in v) <= 2048
        first = [r for r in out if r.sequence_id < n // 4]
        return sum(r.length for r in first if source[r.doc_id] == "a") / sum(r.length for r in first)

    assert early({"a": 4, mixing.POOL: 1}) == pytest.approx(0.8, abs=0.1)
    assert early({"a": 1, mixing.POOL: 4}) == pytest.approx(0.2, abs=0.1)
    assert early(None) == pytest.approx(0.5, abs=0.15)
