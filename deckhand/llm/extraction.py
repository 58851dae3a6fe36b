"""Main text of web pages: a tree-structured graphical model over the elements.

Every element is content or not. An element's own features give its potential, and each pair of parent
and child has one that depends on the child's kind, so that neighbours in the tree agree where nothing
speaks against it. Sum-product messages go up from the leaves and down from the root; the product at an
element is its exact marginal. Pages of a batch are worked on together, depth by depth.

The potentials are trained on made-up pages whose main text is known, by the exact gradient.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from deckhand.llm import common
from deckhand.llm.dom import BLOCKS, Page
from deckhand.llm.pages import MARK, Maker

#: Made-up pages on which the model is trained, and the seed of the first.
TRAINING_PAGES, SEED, STEPS = 700, 1000, 150
#: Pages of about so many bytes are worked on together.
BATCH_BYTES = 1 << 19

KINDS = ["p", "h1", "h2", "h3 h4 h5 h6", "div", "section", "article", "main", "nav menu", "header", "footer", "aside", "ul ol dl", "li dt dd", "a", "form button label input fieldset select textarea option", "table tbody thead tr td th", "blockquote pre", "figure figcaption", "body html #", "b i em strong u span small code"]
KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags.split()}
BAD = [r"\b(?:nav|navbar|navigation|menu|breadcrumbs?|toc|tabs)", r"\b(?:ads?|advert\w*|sponsor\w*|promo\w*|banner)\b", r"\b(?:sidebar|side|rail|widget|related|recommended|popular|trending|more)", r"\b(?:footer|bottom|colophon|copyright|legal)", r"\b(?:header|masthead|topbar|title)", r"cookie|consent|notice|gdpr|alert|newsletter|subscribe|popup|modal|overlay|paywall", r"comment|responses|replies|discussion|disqus", r"share|sharing|social|tools|tags|meta|byline", r"search|login|signup|contact"]
GOOD = [r"\b(?:article|story|entry|hentry|post)", r"\b(?:content|main|text|body)"]
NAMED = [re.compile(p) for p in BAD + GOOD]
#: Kinds of children for the potentials of pairs: containers, lists and cells, text blocks, inline and others.
GROUPS = ["div section article main aside header footer nav form", "ul ol li table tr td blockquote figure", "p h1 h2 h3 h4 pre"]
CHILD = {k: next((g for g, tags in enumerate(GROUPS) if kind.split()[0] in tags.split()), 3) for k, kind in enumerate(KINDS)}
N_FEATURES = len(KINDS) + 1 + len(NAMED) + 6
N_CHILD = 4


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    #: By the child's kind, the parent's label and the child's label.
    pairs: np.ndarray


@functools.lru_cache(maxsize=20_000)
def _remembered(name: str) -> tuple[int, ...]:
    return tuple(k for k, p in enumerate(NAMED) if p.search(name))


def _named(name: str) -> tuple[int, ...]:
    return _remembered(name) if len(name) < 200 else _remembered.__wrapped__(name)


def features(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row an element; parents; kinds of children. Text counts for an element and for all above it."""
    n = len(page.tags)
    x = np.zeros((n, N_FEATURES))
    kinds = [KIND.get(t, len(KINDS)) for t in page.tags]
    x[np.arange(n), kinds] = 1.0
    own, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    in_link = np.zeros(n, bool)
    for k in range(1, n):
        in_link[k] = page.tags[k] == "a" or in_link[page.parents[k]]
        if page.names[k]:
            for f in _named(page.names[k]):
                x[k, len(KINDS) + 1 + f] = 1.0
    for element, _, text in page.runs:
        size = len(text)
        if size > 1:
            own[element] += size
            linked[element] += size * in_link[element]
            stops[element] += text.count(".") + text.count(",")
    whole, links, marks = own.copy(), linked.copy(), stops.copy()
    for k in range(n - 1, 0, -1):
        p = page.parents[k]
        whole[p] += whole[k]
        links[p] += links[k]
        marks[p] += marks[k]
    f = len(KINDS) + 1 + len(NAMED)
    x[:, f] = np.log1p(whole) / 8
    x[:, f + 1] = links / np.maximum(whole, 1)
    x[:, f + 2] = np.minimum(marks / np.maximum(whole, 1) * 20, 1)
    x[:, f + 3] = np.log1p(own) / 8
    x[:, f + 4] = own > 60
    x[:, f + 5] = whole / max(whole[0], 1)
    return x, np.array(page.parents), np.array([CHILD.get(k, 3) for k in kinds])


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Forest:
    """Trees of several pages, with their elements by depth."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.starts = np.cumsum([0, *(len(t[0]) for t in trees)])
        self.x = np.concatenate([t[0] for t in trees])
        self.parents = np.concatenate([np.where(t[1] < 0, -1, t[1] + s) for t, s in zip(trees, self.starts)])
        self.child = np.concatenate([t[2] for t in trees])
        depth = np.zeros(len(self.x), np.int64)
        for k, p in enumerate(self.parents.tolist()):
            if p >= 0:
                depth[k] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
        self.levels = np.split(order, cuts)[1:-1]

    def _pair(self, model: Model, k: int) -> list[list[float]]:
        return model.pairs[self.child[k]].tolist()

    def marginals(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of content for each element; of pairs for each element and its parent; log of the sums at the roots."""
        up = np.column_stack([np.zeros(len(self.x)), self.x @ model.weights])
        message = np.zeros_like(up)
        for level in reversed(self.levels):
            if len(level) == 1:  # a long chain is quicker number by number
                k, p = level[0], self.parents[level[0]]
                message[k] = [_log_sum(a + up[k, 0], b + up[k, 1]) for a, b in self._pair(model, k)]
                up[p] += message[k]
                continue
            message[level] = np.logaddexp.reduce(model.pairs[self.child[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, self.parents[level], message[level])
        down = up.copy()
        pairs = np.zeros((len(self.x), 2, 2))
        for level in self.levels:
            if len(level) == 1:
                k, p = level[0], self.parents[level[0]]
                joint = [[down[p, y] - message[k, y] + a + up[k, 0], down[p, y] - message[k, y] + b + up[k, 1]] for y, (a, b) in enumerate(self._pair(model, k))]
                down[k] = _log_sum(joint[0][0], joint[1][0]), _log_sum(joint[0][1], joint[1][1])
                pairs[k] = np.array(joint) - _log_sum(down[k, 0], down[k, 1])
                continue
            outside = down[self.parents[level]] - message[level]
            joint = outside[:, :, None] + model.pairs[self.child[level]] + up[level][:, None, :]
            down[level] = np.logaddexp.reduce(joint, axis=1)
            pairs[level] = joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None]
        z = np.logaddexp.reduce(down, axis=1)
        return np.exp(down[:, 1] - z), np.exp(pairs), z


def labelled_page(seed: int) -> tuple[Page, np.ndarray]:
    """A made-up page and which of its elements are content."""
    source = Maker(seed).page()
    marked = Page(source.replace(MARK, ' role="\x02"'))
    content = np.array([MARK in n for n in marked.names], np.int64)
    for k, (tag, parent) in enumerate(zip(marked.tags, marked.parents)):
        if k and tag not in BLOCKS and content[parent]:
            content[k] = 1  # inline elements go with their block
    return Page(source.replace(MARK, "")), content


@functools.cache
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Model:
    found = [labelled_page(seed + k) for k in range(pages)]
    forest, y = Forest([features(p) for p, _ in found]), np.concatenate([y for _, y in found])
    inner = np.flatnonzero(forest.parents >= 0)
    seen = np.zeros((N_CHILD, 2, 2))
    np.add.at(seen, (forest.child[inner], y[forest.parents[inner]], y[inner]), 1.0)
    params = np.zeros(N_FEATURES + 4 * N_CHILD)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, STEPS + 1):  # Adam
        model = Model(params[:N_FEATURES], params[N_FEATURES:].reshape(N_CHILD, 2, 2))
        p, pairs, _ = forest.marginals(model)
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.child[inner], pairs[inner])
        g = np.concatenate([forest.x.T @ (y - p), (seen - expected).ravel()]) / len(y) - 3e-5 * params
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + 0.12 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(params[:N_FEATURES], params[N_FEATURES:].reshape(N_CHILD, 2, 2))


def main_texts(sources: list[str], model: Model) -> list[str]:
    """Blocks of the elements whose marginal is at least a half, joined by line ends."""
    pages = [Page(s) for s in sources]
    forest = Forest([features(p) for p in pages])
    content = forest.marginals(model)[0] >= 0.5
    out = []
    for page, lo, hi in zip(pages, forest.starts[:-1], forest.starts[1:]):
        out.append("\n".join(page.lines(content[lo:hi])))
    return out


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Adds each page's main text and keeps all other columns; one of that name is replaced.

    A null or empty page, or one without main text, gives an empty text. Rows are worked on one by one,
    so repeated rows get equal texts, and an empty table stays empty. Pages may be of any length and depth:
    time and memory grow with the page. A column that differs from the new one by case only is replaced too.
    """
    model = model or trained()
    own = common.others(df, [text_col])
    at = own.index(html_col)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in common.slices(common.text_bytes(whole.column(at))[1], BATCH_BYTES):
                batch = whole.slice(lo, hi - lo)
                found = main_texts([s or "" for s in batch.column(at).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*own, text_col])

    return df.select(*map(common.quoted, own)).mapInArrow(run, f"{common.ddl(df, own)}, {common.quoted(text_col)} string")


def page_digest(df: DataFrame) -> DataFrame:
    return extract(df.select("page_id", "url", "html")).selectExpr("page_id", "url", "text", "CAST(length(text) AS LONG) AS n_chars")
