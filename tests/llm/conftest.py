"""Small tables with the awkward cases: nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""

import random

import pytest

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran sel tip vox wem zul".split()]
BAD = "zorgle"


def prose(rng, n, lines=6):
    words = [rng.choice(WORDS) for _ in range(n)]
    cut = sorted(rng.sample(range(1, n), min(lines, n - 1))) if n > 1 and lines else []
    out, at = [], 0
    for c in [*cut, n]:
        out.append(" ".join(words[at:c]).capitalize() + ".")
        at = c
    return "\n".join(out)


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text, lang, source, n_chars) rows."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        source = "hot" if i % 3 else f"s{i % 7}"
        text = prose(rng, rng.randint(25, 90))
        if i % 10 == 0:
            text += f"\n{prose(rng, 4, 0)[:-1]} {BAD} {prose(rng, 3, 0)[:-1].lower()} {BAD}, {rng.choice(WORDS)}."
        rows.append([i, text, "en" if i % 2 else "de", source, len(text)])
    base = prose(rng, 200)
    for i in range(120, 130):  # near copies: one word of 200 differs
        words = base.split(" ")
        words[(i - 120) * 9] = f"other{i}"
        rows.append([i, " ".join(words), "en", "hot", len(base)])
    notice = "Shared notice of the host that stands everywhere and is far longer than what else a short page holds, so little is left\n"
    for i in range(130, 160):  # a line that a host repeats; the first ten documents hold little else
        text = notice + prose(rng, 12 if i < 140 else 40)
        rows.append([i, text, "en", "hot", len(text)])
    for i in range(160, 172):  # exact copies
        rows.append([i, rows[5][1], "en", "hot", None])
    rows.append([172, None, None, None, None])
    rows.append([173, "", "en", "s1", 0])
    rows.append([174, " \n\t ", "en", "s1", 4])
    rows.append([175, "one two", "en", "s1", 7])
    rows.append([176, " ".join(rng.choice(WORDS) for _ in range(9000)), "en", "s2", 1])
    rows.append([177, "ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab\nab", "xx", "s2", 1])
    rows.append([178, "Tabs\tand  double blanks \n \n end ", "en", "s2", 1])
    rows.append([179, "naïve café İstanbul 汉字 don't 'S 12,34 <b>#tag</b> $5 ~~~ <|endoftext|>", "fr", "s3", 1])
    rows.append([None, "a row without an id has words too", "en", "s3", 1])
    rows.append(rows[7][:])  # a row repeated whole
    return [tuple(r) for r in rows]


PAGES = "page_id bigint, url string, html string, key string, chunk int, text string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, size string, shard int, score double, n bigint, position string, part int, via string"
CLASH = (1, "x", 2, 0.5, 3, "p", 4, "v")


@pytest.fixture(scope="session")
def tables(spark, documents, tmp_path_factory):
    """A folder of the tables."""
    d = tmp_path_factory.mktemp("edge")
    spark.createDataFrame([r + CLASH for r in documents], DOCUMENTS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(i % 10 == 0)) for i in range(120)] + [(5, 1, None), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], PAGES).write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)
