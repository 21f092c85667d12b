"""Main text of web pages as a maximum-scoring subsequence.

A page is read once as a sequence of tags and text. A word scores the sum of the weights of what it stands in: a bias,
the open elements, and the words of their class, id and role values. A tag scores one weight below zero. A linear
scan finds the contiguous region of greatest sum. The region is widened to whole blocks, and text inside it that
scores below zero by itself (adverts, forms, comments) is left out.

Weights are learned on labelled pages (html_labelled): those of words by logistic regression of "is article text", the
tags' weight and the scale of words below zero by the best extraction of these pages. They are not bounded or set by
hand. Only what HTML does not show at all (scripts, hidden elements and the like) is left out by rule.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_labelled import pages as labelled_pages
from .shared import text_batches, unused

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
# Fixed values of HTML: elements by how they lay out and what they show.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul".split())
NOT_SHOWN = RAW | frozenset("head template noscript svg canvas object audio video select option datalist".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = ("ul", "ol", "dl", "table", "select")
CELLS = ("td", "th", "table")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


def _features(name: str, attributes: str, inside: Counter) -> tuple[list[str], bool]:
    """(features of an element, is it hidden)."""
    own = [f"<{name}>" if not inside["<article>"] else f"<{name}> in article"] if name in ("header", "article") else [f"<{name}>"]
    hidden = name in NOT_SHOWN
    if attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
                hidden = True
            elif key in ("class", "id", "role") and name not in ("html", "body"):
                for part in value.split()[:20]:
                    words = [w.lower() for w in NAME_WORD.findall(part)][:8]
                    own += words if len(words) < 2 else [*words, "-".join(words)]
    return own, hidden


def events(page: str):
    """(tag or None, raw text, open features, how many of them have not changed since the last event) in page order, in
    time that grows with the page's length only. The open features are one list that changes between events. Text that
    is not shown is passed over.
    """
    stack: list[tuple[str, int, bool]] = []  # name, number of features before it, hidden
    places: dict[str, list[int]] = defaultdict(list)  # where on the stack a name is open
    blocks: list[int] = []
    features: list[str] = []
    inside: Counter = Counter()
    hidden, at, same = False, 0, 0

    def close(k: int) -> None:
        nonlocal hidden, same
        while len(stack) > k:
            name, n, hidden = stack.pop()
            places[name].pop()
            if name in BLOCK:
                blocks.pop()
            for f in features[n:]:
                inside[f] -= 1
            del features[n:]
        same = min(same, len(features))

    def event(tag: str | None, text: str = ""):
        nonlocal same
        before, same = same, len(features)
        return tag, text, features, before

    def last(names) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    while at < len(page):
        m = TOKEN.search(page, at)
        start = m.start() if m else len(page)
        if start > at and not hidden:
            yield event(None, page[at:start])
        if m is None:
            return
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            k = last((name,))
            if k >= 0 and (name in BLOCK or last(CELLS) <= k):
                close(k)
                yield event(name)
            elif k < 0 and name in ("p", "br"):
                yield event(name)
            continue
        if name in BLOCK and blocks and stack[blocks[-1]][0] == "p":  # a block ends an open paragraph
            close(blocks[-1])
        if name in CLOSES and (k := last(CLOSES[name])) > last(SCOPES):
            close(k)
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
            if not hidden:
                yield event(name)
            continue
        own, gone = _features(name, m[3], inside)
        places[name].append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append((name, len(features), hidden))
        features += own
        inside.update(own)
        hidden = hidden or gone
        if not hidden:
            yield event(name)


Weights = tuple[dict[str, float], float, float, float]  # of features, the bias, a tag, scale of words below zero


def learn(pages: list[list[tuple[str, bool]]], steps: int = 300, decay: float = 1e-5) -> Weights:
    """Weights from pages whose parts are labelled."""
    runs: list[tuple[frozenset[str], int, bool]] = []
    for page in pages:
        label, marked = [], []
        for k, (part, content) in enumerate(page):
            label.append(content)
            marked.append(re.sub(r"(>)([^<]+)|^([^<]+)", lambda m, k=k: f"{m[1] or ''}\x01{k}\x02{m[2] or m[3]}", part))
        for tag, text, features, _ in events("".join(marked)):
            if tag is None:
                runs += [(frozenset(features), len(own.split()), label[int(k)]) for k, own in re.findall(r"\x01(\d+)\x02([^\x01]*)", text)]
    names = sorted({f for fs, *_ in runs for f in fs})
    place = {f: k for k, f in enumerate(names)}
    row = np.repeat(np.arange(len(runs)), [len(fs) for fs, *_ in runs])
    col = np.array([place[f] for fs, *_ in runs for f in sorted(fs)], np.int64)
    n = np.sqrt(np.array([x for _, x, _ in runs], float))
    n /= n.sum()
    y = np.array([x for *_, x in runs], float)
    w, bias = np.zeros(len(names)), 0.0
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam
        z = np.bincount(row, weights=w[col], minlength=len(runs)) + bias
        g = n * (1 / (1 + np.exp(-z)) - y)
        gw, gb = np.bincount(col, weights=g[row], minlength=len(names)) + decay * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        bias -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    known = dict(zip(names, w.tolist(), strict=True))
    checked = []
    for page in pages[:300]:
        want = Counter(re.sub(r"<[^>]*>", " ", " ".join(part for part, content in page if content)).split())
        checked.append((want, scored("".join(part for part, _ in page), known, float(bias))))
    right = {}
    for tag in (-0.01, -0.03, -0.1, -0.3, -0.9):
        for scale in (0.01, 0.03, 0.1, 0.3, 1.0):
            got = [(want, Counter(" ".join(chosen(items, tag, scale)).split())) for want, items in checked]
            right[tag, scale] = sum((x == y) + 2 * (x & y).total() / max(1, x.total() + y.total()) for x, y in got)
    return known, float(bias), *max(right, key=right.get)


@cache
def weights() -> Weights:
    return learn(labelled_pages())


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, last) of the contiguous run of greatest sum; the longest of equal ones from the earliest start; (0, 0) if none is above zero."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, region = total, (start, k + 1)
    return region


def scored(page: str, known: dict[str, float], bias: float) -> list[tuple[str | None, int, float, bool, bool]]:
    """(text or None for a tag, words, score of a word, is the text furniture, starts a block) of each event."""
    out: list[tuple[str | None, int, float, bool, bool]] = []
    sums: list[tuple[float, float]] = [(bias, bias)]  # after so many features: the score, and without links
    counts: Counter = Counter()
    held: list[str] = []
    for tag, raw, features, same in events(page):
        while len(held) > same:
            counts[held.pop()] -= 1
            sums.pop()
        for f in features[same:]:
            x = known.get(f, 0.0) if not counts[f] else 0.0
            a, b = sums[-1]
            sums.append((a + x, b if f == "<a>" else b + x))
            counts[f] += 1
            held.append(f)
        if tag is None:
            text = html.unescape(raw)
            out.append((text, len(text.split()), sums[-1][0], sums[-1][1] < 0, False))
        else:
            out.append((" " if tag == "br" else None, 0, 0.0, False, tag in BLOCK))
    return out


def chosen(items: list[tuple[str | None, int, float, bool, bool]], tag: float, scale: float) -> list[str]:
    """The blocks of the best region."""
    first, last = best_region([n * score * (scale if score < 0 else 1) if n else 0.0 if text and text != " " else tag for text, n, score, _, _ in items])
    if first == last:
        return []
    while first > 0 and not items[first][4] and not items[first - 1][4]:
        first -= 1
    while last < len(items) and not items[last][4]:
        last += 1
    blocks: list[str] = []
    words: list[str] = []
    for text, _, _, furniture, block in [*items[first:last], (None, 0, 0.0, False, True)]:
        if text is not None:
            if not furniture:
                words.append(text)
        elif block:
            if found := "".join(words).split():
                blocks.append(" ".join(found))
            words = []
    return blocks


def extract(page: str | None, model: Weights | None = None) -> list[str]:
    """The article's blocks."""
    known, bias, tag, scale = model or weights()
    return chosen(scored(page or "", known, bias), tag, scale)


def texts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text (blocks joined by a blank line, empty if none) and n_chars.

    Null and empty html gives an empty text; unclosed, wrongly nested and very long pages are read in time that grows
    with their length. A column that is called text or n_chars already is replaced, others stay, whatever their names;
    rows may repeat. An empty table gives an empty result.
    """
    rest = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    picked = text_batches(pages.select(*[F.col(f"`{c}`") for c in rest], F.col(html_col).alias(unused(pages, "_html"))))
    sent = pages.sparkSession.sparkContext.broadcast(weights())

    def run(batches):
        for b in batches:
            found = ["\n\n".join(extract(p, sent.value)) for p in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*rest, "text", "n_chars"])

    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)
    return picked.mapInArrow(run, f"{fields + ', ' if fields else ''}text string, n_chars bigint")
