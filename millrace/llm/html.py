"""Main-text extraction by the maximum-scoring subsequence of a page's words and tags.

A word scores by how likely an element chain like its own holds the article, a tag scores negative, and one pass finds the contiguous region of greatest sum. The weights of tags, class words and roles come from labelled pages (those whose own markup names the article), drawn towards prior weights where these are few.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: At most so many labelled pages, drawn by a hash of page_id among all that name their article, give the weights.
MAX_LABELLED = 1_500
#: Element chains that are counted apart; beyond that the most frequent ones of the labelled pages.
MAX_CHAINS = 20_000
#: A labelled page weighs as much as this share of a squared unit between a weight and its prior.
STIFFNESS = 0.5
LEAST, MOST = -8.0, 3.0

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCK - frozenset("html head body title td th tr tbody thead tfoot caption".split())
#: Elements that the standard gives no meaning of their own, or that hold the whole page.
PLAIN = frozenset("html body div span".split())
#: What names a page's article, and what the standard sets apart from the article that it stands in: the labels.
ARTICLE = frozenset("article main".split())
APART = frozenset("aside nav footer form dialog".split())

#: Prior weights, in log odds of standing in the article: what a corpus with few or no labelled pages starts from.
PRIOR = {
    **dict.fromkeys("article main".split(), 2.0),
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split(), 1.0),
    "header": -1.6,
    "a": -1.0,
    **dict.fromkeys("head nav footer aside form fieldset button select option menu dialog search noscript template svg math canvas object audio video".split(), -6.5),
    **{f"@{x}": -6.5 for x in "hidden navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()},
    **{
        f".{x}": -6.5
        for x in "ad ads adbox adslot advert adverts advertisement advertising banner banners sponsor sponsored promo promos promotion sidebar sidebars rail widget widgets related recommended share sharing social comment comments commentlist respond replies reply cookie cookies consent gdpr notice notices notification breadcrumb breadcrumbs nav navbar navigation menu menus toolbar pager pagination newsletter subscribe subscription signup login popup modal overlay footer copyright masthead skip".split()
    },
}
BIAS = 0.3

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def features(name: str, attributes: str) -> frozenset:
    """An element's features: its name, the words of its class and id (.word), its role (@role) and @hidden."""
    out = set() if name in PLAIN else {name}
    if attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            value, key = a or b or c, key.lower()
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                out.add("@hidden")
            elif key == "role":
                out.add("@" + value.lower())
            elif key in ("class", "id"):
                out.update("." + w.lower() for w in WORDS.findall(value))
    return frozenset(out)


class Chains:
    """The feature sets of element chains, each held once, so that a deeper chain costs a lookup."""

    def __init__(self):
        self.own: dict = {}
        self.next: dict = {}

    def child(self, chain: frozenset, name: str, attributes: str) -> frozenset:
        if len(self.next) > 100_000:
            self.own.clear()
            self.next.clear()
        own = self.own.get((name, attributes))
        if own is None:
            own = self.own[name, attributes] = features(name, attributes)
        found = self.next.get((chain, own))
        if found is None:
            found = self.next[chain, own] = chain if own <= chain else chain | own
        return found


@dataclass
class Weights:
    """A feature's weight in log odds of standing in the article; those not named weigh nothing."""

    by: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    bias: float = BIAS

    def __post_init__(self):
        self.known: dict[frozenset, float] = {}

    def of(self, chain: frozenset) -> float:
        z = self.known.get(chain)
        if z is None:
            if len(self.known) > 100_000:
                self.known.clear()
            z = self.known[chain] = self.bias + sum(self.by.get(f, 0.0) for f in chain)
        return z


EMPTY = frozenset()


def tokens(page: str, chains: Chains) -> Iterator[tuple[str, str, frozenset]]:
    """(kind, value, features of the element chain) in page order: ("tag", name) at its start and end, ("text", raw text) and ("br", "").

    Tags that the page leaves open are closed as far as the standard's main rules do: a block ends an open paragraph, an end tag closes all that was opened since its start, and an end tag without a start is passed over. Each tag costs a constant number of steps, whatever the nesting.
    """
    stack: list[tuple[str, frozenset]] = []
    open_: Counter = Counter()
    blocks: list[int] = []  # places on the stack of block elements
    cells: list[int] = []  # .. of tables, rows and cells
    at, end = 0, len(page)

    def cut(n: int) -> None:
        for name, _ in stack[n:]:
            open_[name] -= 1
        del stack[n:]
        while blocks and blocks[-1] >= n:
            blocks.pop()
        while cells and cells[-1] >= n:
            cells.pop()

    def here() -> frozenset:
        return stack[-1][1] if stack else EMPTY

    while at < end:
        m = TAG.search(page, at)
        start = m.start() if m else end
        if start > at:
            yield "text", page[at:start], here()
        if not m:
            return
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            if page.startswith("<![CDATA[", start):
                yield "text", page[start + 9 : at - 3], here()
            continue
        if m.group(1) or m.group(4):
            yield "tag", name, here()
            if open_[name] > 0:
                n = len(stack) - 1
                while stack[n][0] != name:
                    n -= 1
                cut(n)
            continue
        attributes = m.group(3) or m.group(6) or ""
        if name == "br":
            yield "br", "", here()
            continue
        if (name in ENDS_P or name == "li") and blocks and (stack[blocks[-1]][0] == "p" or name == "li" and stack[blocks[-1]][0] == "li"):
            cut(blocks[-1])
        elif name in ("tr", "td", "th"):
            if cells and stack[cells[-1]][0] in ("td", "th"):
                cut(cells[-1])
            if name == "tr" and cells and stack[cells[-1]][0] == "tr":
                cut(cells[-1])
        chain = chains.child(here(), name, attributes)
        yield "tag", name, chain
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            yield "tag", name, here()
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCK and name != "a":
            continue
        if name in BLOCK:
            blocks.append(len(stack))
        if name in ("table", "tr", "td", "th"):
            cells.append(len(stack))
        open_[name] += 1
        stack.append((name, chain))


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of greatest sum (the first one found; empty if no sum is positive), in one pass."""
    total = best = 0.0
    start = a = b = 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, a, b = total, start, k + 1
    return a, b


def extract(page: str, weights: Weights, chains: Chains | None = None) -> str:
    """The main text: blocks of the best-scoring contiguous region, in page order, joined by a newline each.

    A block counts as content if its words' mean log odds are positive; words of an inline element that stands far on the other side (below -2) are no part of it. A content word scores 2p - 1 and a tag costs at least 0.2; of tags outside of content the k-th in a row costs 2 (1 - p) / k, so an advert within the article costs little and what lies beyond a menu must be worth the way. Blocks of the region that aren't content are left out.
    """
    chains = chains or Chains()
    scores: list[float] = []
    blocks: list[tuple[str, int]] = []  # text and place among the scores
    parts: list[tuple[str, int, float]] = []
    row = 0

    def flush() -> None:
        nonlocal row
        whole = [x for x in parts if x[2] >= -2.0]
        n = sum(x[1] for x in whole)
        if n:
            z = sum(x[1] * x[2] for x in whole) / n
            if z > 0:
                scores.append(n * math.tanh(z / 2))
                blocks.append((" ".join("".join(x[0] for x in whole).split()), len(scores) - 1))
                row = 0
        parts.clear()

    for kind, value, chain in tokens(page, chains):
        z = weights.of(chain)
        if kind == "tag":
            if value in BLOCK:
                flush()
            if z > 0:
                scores.append(-0.2)
            else:
                row += 1
                scores.append(-2 / (1 + math.exp(max(z, -30.0))) / row)
        elif kind == "br":
            if parts:
                parts.append((" ", 0, z))
        else:
            text = entities.unescape(value) if "&" in value else value
            n = len(text.split())
            if n or parts:
                parts.append((text, n, z))
    flush()
    a, b = best_run(scores)
    return "\n".join(t for t, k in blocks if a <= k < b)


def counts(page: str, chains: Chains) -> Counter:
    """Words in the article and out of it by element chain, of a page that names its article (one that doesn't gives none). What the standard sets apart from the article is out of it."""
    seen: Counter = Counter()
    labelled = False
    for kind, value, chain in tokens(page, chains):
        labelled |= kind == "tag" and value in ARTICLE
        if kind == "text" and (n := len(value.split())):
            seen[" ".join(sorted(chain)), bool(chain & ARTICLE) and not chain & APART] += n
    return seen if labelled else Counter()


def learned(seen: list[tuple[str, bool, int]], pages: int, prior: dict[str, float] | None = None, steps: int = 300) -> Weights:
    """Weights by logistic regression on the words of labelled pages, in and out of the article weighing alike, drawn towards the prior.

    Each chain counts once as it is and once without the elements that name the article, so that the other features can tell it too and pages without such an element are read as well.
    """
    prior = PRIOR if prior is None else prior
    rows = [(set(c.split()), y, n) for c, y, n in seen]
    total = {y: sum(n for _, v, n in rows if v == y) for y in (True, False)}
    if not total[True] or not total[False]:
        return Weights(dict(prior))
    sets = [(x, y, pages * n / total[y] / 4) for c, y, n in rows for x in (c, c - ARTICLE)]
    names = sorted(set(prior).union(*(x for x, _, _ in sets)))
    index = {f: i for i, f in enumerate(names)}
    start = np.array([prior.get(f, 0.0) for f in names])
    at = np.array([k for k, (x, _, _) in enumerate(sets) for _ in x], np.int64)
    which = np.array([index[f] for x, _, _ in sets for f in sorted(x)], np.int64)
    y, n = np.array([float(v) for _, v, _ in sets]), np.array([v for _, _, v in sets])
    w, b, sums = start.copy(), BIAS, np.full(len(names) + 1, 1e-6)
    for _ in range(steps):
        z = b + np.bincount(at, w[which], len(sets))
        g = n * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        d = np.append(np.bincount(which, g[at], len(names)) + STIFFNESS * (w - start), g.sum() + STIFFNESS * (b - BIAS))
        sums += d**2
        step = 0.3 * d / np.sqrt(sums)
        w, b = np.clip(w - step[:-1], LEAST, MOST), float(np.clip(b - step[-1], -1.0, 1.0))
    return Weights(dict(zip(names, w.tolist())), b)


def fit(pages: DataFrame, most: int = MAX_LABELLED, prior: dict[str, float] | None = None) -> Weights:
    """Weights from at most `most` of the pages that name their article, drawn among all of these by a hash of page_id; counts only come to the driver."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)[\s/>]"))
    ids = named.select(F.col("page_id").alias("i")).distinct().orderBy(F.xxhash64(F.lit(3), "i"), "i").limit(most)
    drawn = named.join(F.broadcast(ids), F.col("page_id").eqNullSafe(F.col("i")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        chains, n = Chains(), 0
        for batch in it:
            for page in batch.column(0).to_pylist():
                own = counts(page, chains)
                seen += own
                n += bool(own)
        keys = [*seen, ("", None)]
        yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in keys], pa.string()), "y": pa.array([y for _, y in keys], pa.bool_()), "n": pa.array([*seen.values(), n], pa.int64())})

    rows = drawn.select("html").mapInArrow(run, "k string, y boolean, n bigint").groupBy("k", "y").agg(F.sum("n").alias("n")).orderBy(F.col("y").isNotNull(), F.desc("n"), "k", "y").limit(MAX_CHAINS).collect()
    return learned([(r["k"], r["y"], r["n"]) for r in rows if r["y"] is not None], sum(r["n"] for r in rows if r["y"] is None), prior)


def extracted(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every page; a null or empty html, or a page without words, has an empty text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = Chains()
        for whole in it:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [extract(p or "", weights, chains) for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op6_maximum_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages: page_id, url, text, n_chars. A null or empty html, or one without words, has an empty text; rows with a null or repeated page_id are pages as any other."""
    pages = common.table(spark, sf_dir, "pages")
    return extracted(pages, fit(pages))
