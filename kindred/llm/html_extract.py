"""Main text of web pages as a maximum-scoring subsequence (operator 5).

After Pasternack and Roth, "Extracting article text from the web with maximum subsequence segmentation" (WWW 2009): a page is a
sequence of words, which score positive, and tags, which score negative; the contiguous region with the highest sum is the content, found by one
linear scan. A word scores 1. Tags' scores are learnt from labelled pages, whose content is known, by an averaged structured
perceptron: while the best region of a labelled page isn't its content, the tags in which the two differ move.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shared

TRAIN_PAGES, EPOCHS, SEED = 600, 12, 42
#: Elements whose content isn't text: with what they hold they count as one tag, as comments do; an unclosed one reaches to the page's end.
_OPAQUE = ("script", "style", "noscript", "template", "svg", "textarea")
_OPENS = re.compile(rf"<({'|'.join(_OPAQUE)})\b", re.I | re.A)
_CLOSES = {t: re.compile(rf"</{t}\s*+>", re.I | re.A) for t in _OPAQUE}
_TAG = re.compile(r"<[!?]?(/?[a-zA-Z][a-zA-Z0-9:-]*+)?+[^<>]*+>")
_INLINE = frozenset(x for t in ("a", "abbr", "b", "bdi", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var") for x in (t, "/" + t))
OTHER = "?"
_LEAST, _START = -0.05, -1.0


def tokens(page: str) -> tuple[list[str], list[str]]:
    """Tags' names, and the texts before, between and after them (one more). Linear in the page, whatever it holds: what isn't there further on is looked for once."""
    names, texts, begin, at = [], [], 0, page.find("<")
    last = page.rfind(">")
    closed = {}
    while at >= 0:
        opaque = _OPENS.match(page, at)
        name, end = OTHER, -1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif opaque and last >= opaque.end():
            name = opaque[1].lower()
            inner = page.find(">", opaque.end()) + 1
            close = closed.get(name, True) and _CLOSES[name].search(page, inner)
            closed[name] = close is not None and close is not False
            end = close.end() if close else len(page)
        elif at < last and (tag := _TAG.match(page, at)):
            name, end = (tag[1] or OTHER).lower(), tag.end()
        if end < 0:
            at = page.find("<", at + 1)
            continue
        texts.append(page[begin:at])
        names.append(name)
        begin = end
        at = page.find("<", end)
    texts.append(page[begin:])
    return names, texts


def best_region(words: list[float], tags: list[float]) -> tuple[int, int, float]:
    """First and last text of the region of the highest sum, the shortest of the earliest; (0, -1, 0) if none is positive."""
    best, at, now, begin = (0, -1, 0.0), 0, 0.0, 0
    for i, w in enumerate(words):
        if now <= 0:
            now, begin = 0.0, i
        now += w
        if now > best[2]:
            best = (begin, i, now)
        if i < len(tags):
            now += tags[i]
    return best


def _known_region(texts: list[list[str]], content: list[str]) -> tuple[int, int]:
    """The texts that hold the known content: its first word and words that stand in it after the same word score 1, others -3."""
    pairs = set(zip(content, content[1:]))
    firsts, begins = set(content), content[:1]
    score, last = [], None
    for words in texts:
        s = 0
        for w in words:
            s += 1 if ((last, w) in pairs or [w] == begins or (last is None and w in firsts)) else -3
            last = w
        score.append(float(s))
    return best_region(score, [0.0] * (len(score) - 1))[:2]


def learn(pages: list[tuple[str, str]], epochs: int = EPOCHS) -> dict[str, float]:
    """Tags' weights from (page, content) pairs. Without pages every tag scores -1."""
    data = []
    for page, content in pages:
        names, texts = tokens(page)
        split = [html.unescape(t).split() for t in texts]
        a, b = _known_region(split, content.split())
        if b >= a:
            data.append((names, [float(len(s)) for s in split], a, b))
    weights: dict[str, float] = {OTHER: _START}
    total: dict[str, float] = {}
    rng = np.random.default_rng(SEED)
    steps = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(data)):
            names, counts, a, b = data[k]
            p, q, _ = best_region(counts, [weights.get(n, _START) for n in names])
            if (p, q) != (a, b):
                rate = 2.0 / (1 + epoch)
                for n, sign in [(n, 1) for n in names[a:b]] + [(n, -1) for n in names[p : max(p, q)]]:
                    weights[n] = weights.get(n, _START) + sign * rate
                for n in {*names}:
                    weights[n] = min(weights.get(n, _START), _LEAST)
        if epoch >= epochs // 2:
            steps += 1
            for n, w in weights.items():
                total[n] = total.get(n, 0.0) + w
    return {n: w / steps for n, w in total.items()} if steps else weights


def extract(page: str | None, weights: dict[str, float]) -> tuple[str, int, float]:
    """The page's content, its words and its score. Inline tags leave no mark; others end a line."""
    if not page:
        return "", 0, 0.0
    names, texts = tokens(page)
    texts = [html.unescape(t) for t in texts]
    other = weights.get(OTHER, _START)
    a, b, score = best_region([float(len(t.split())) for t in texts], [weights.get(n, other) for n in names])
    parts = []
    for i in range(a, b + 1):
        parts.append(texts[i])
        if i < b and names[i] not in _INLINE:
            parts.append("\n")
    lines = [" ".join(x.split()) for x in "".join(parts).split("\n")]
    text = "\n".join(x for x in lines if x)
    return text, len(text.split()), score


def labelled_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(page_id, doc_id, html, text) of pages whose address ends in the identifier of a document, which is their known content."""
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '/([0-9]+)/?(?:[?#].*)?$', 1), '') as bigint)")
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return pages.where("html is not null").select("page_id", "html", number.alias("doc_id")).join(known, "doc_id").select("page_id", "doc_id", "html", "text")


def train(pages: DataFrame, documents: DataFrame, limit: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from at most `limit` labelled pages, drawn by a hash of the identifier: identifiers first, and the texts of these alone.

    One task gathers the pages and learns; the weights of their tags reach the driver.
    """
    drawn = labelled_pages(pages, documents).select("page_id", "doc_id").distinct().orderBy(F.xxhash64(F.lit(SEED), "page_id"), "page_id", "doc_id").limit(limit)
    work = Shared(pages.sparkSession, "pages")
    drawn = work.written(drawn, "drawn")
    few = lambda c: F.broadcast(drawn.select(F.col(c).alias(f"__{c}")).distinct())  # noqa: E731  # `limit` rows at most
    mine = labelled_pages(pages.join(few("page_id"), F.col("page_id") == F.col("__page_id"), "left_semi"), documents.join(few("doc_id"), F.col("doc_id") == F.col("__doc_id"), "left_semi"))
    rows = mine.join(F.broadcast(drawn), ["page_id", "doc_id"]).orderBy("page_id", "doc_id", F.xxhash64("html"), F.xxhash64("text")).limit(limit).select("html", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = sorted({(h, t) for b in batches for h, t in zip(b["html"], b["text"])})
        weights = learn(found)
        yield pd.DataFrame({"tag": list(weights), "weight": list(weights.values())})

    learnt = {r["tag"]: r["weight"] for r in rows.repartition(1).mapInPandas(run, "tag string, weight double").collect()}
    work.dropped("drawn")
    return learnt or learn([])


def extract_pages(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(page_id, text, n_words, score) of every row of pages.

    A null or empty page, and one without a word, has an empty text of score 0. Rows keep their identifiers, null and
    repeated ones too. Of equally good regions the earliest counts. Tags never seen in training score like the tag "?". Other columns are ignored; an empty table gives no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [extract(p, weights) for p in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "text": [x[0] for x in found], "n_words": [x[1] for x in found], "score": [x[2] for x in found]})

    return pages.select("page_id", F.col("html").cast("string").alias("html")).mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_words bigint, score double")


def main_text(pages: DataFrame, documents: DataFrame, limit: int = TRAIN_PAGES) -> DataFrame:
    """extract_pages with weights from the pages that labelled_pages finds. Where there are none, every tag scores -1."""
    return extract_pages(pages, train(pages, documents, limit))
