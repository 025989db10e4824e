"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text by its block tags. A block's cost of being boilerplate or content comes from a
logistic classifier over its text and place, plus what the deepest telling ancestor (tag, class or id) says. These costs are
the terminal capacities of a graph; neighbours in page order, and neighbours within one parent and one grandparent
element, are joined by smoothness edges. The maximum flow separates content from boilerplate, and the content blocks
are the text.

What a name says has a strength. An element that is called an advert or a comment list weighs more than the classifier
can: a reader's comment is worded like an article, and what its text looks like must not bring it back. A name that only
has such a word in it weighs less, so the classifier decides where it is sure; a name that speaks of the page's layout (``no-sidebar``)
says nothing, and neither do names of ``html`` and ``body``. The more of the page's text lies in an element, the less
a name can condemn it. Where nothing tells anything, classifier and cut decide alone.

The classifier is trained on the blocks of at most ``TRAIN_PAGES`` pages (smallest hash of page_id), labelled by ancestors that
tell most strongly and described without them. Everything else covers every page and its whole html.

Defined cases: NULL or empty html gives an empty text. Elements without text of the page's own (pictures, buttons,
fallbacks) are left out up to their end tag or that of the element around them. Unclosed elements, comments, scripts and cut-off pages are read
as far as they go. Character references are decoded, white space in a block becomes one space, blocks are joined by an
empty line; nothing else is dropped. Repeated rows give repeated rows. Other columns are not looked at.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treestat.llm.tables import add_columns

TRAIN_PAGES = 1500
#: Log-odds of an element that is what its name or tag says, and of one whose name has a telling word in it; the classifier
#: says at most ``LEARNED``. Weights of the smoothness edges.
TELLING, HINT, LEARNED = 4.0, 2.0, 3.0
NEXT, SIBLING, COUSIN = 0.4, 0.8, 0.2
#: Shares of the page's text from which names of an element weigh less, until they say nothing: hints, and whole names.
HINT_SHARES, NAME_SHARES = (0.6, 0.9), (0.9, 0.99)
#: Log-odds of a block that nothing is known about: content.
PRIOR = 0.1

#: Element kinds and telling names.
RAW = ("script", "style", "textarea", "title")
SKIPPED = frozenset("noscript template select button svg iframe canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form header menu dialog fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
#: Tags that are boilerplate however much they hold, unless a name says otherwise.
ALWAYS = frozenset("nav footer aside menu dialog".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disclaimer dropdown footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article articlebody articletext story storybody entry entrycontent post postbody postcontent main maincontent maintext".split())

#: Words beside a telling one that leave the name what it is, and words that make it speak of the layout.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons col column container content element entry form global group holder inner item items js left link links list main mobile outer page panel post primary right row secondary section site slot text title top unit wp wrap wrapper".split()
)
LAYOUT_WORDS = frozenset("closed disabled enabled fixed free full has hidden hide is layout no not off on open show sticky with without".split())

#: A tag ends before the next "<" outside quotes, so what is no tag costs no second look at the rest of the page.
_ATTRS = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})(?=[\s/>]){_ATTRS}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*+)({_ATTRS})>|<[!?][^<>]*+>|([^<]++|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _named(name: str) -> float:
    """What one class name or id says: below 0 boilerplate, above 0 content."""
    if name.lower().replace("-", "").replace("_", "") in CONTENT_WORDS:
        return TELLING
    parts = {p.lower() for p in _PARTS.findall(_CAMEL.sub(" ", name))}
    if not parts & BOILERPLATE_WORDS or parts & LAYOUT_WORDS:
        return 0.0
    return -TELLING if parts <= BOILERPLATE_WORDS | PLAIN_WORDS else -HINT


def _says(tag: str, attrs: str, inside_article: bool) -> float:
    """What an element's names, or else its tag, say. Of several names the strongest for boilerplate counts."""
    if tag in ("html", "body"):
        return 0.0
    if attrs:
        said = [_named(x) for m in _NAMES.finditer(attrs) for x in (m[1] or m[2] or m[3] or "").split()]
        if any(said):
            return min(said) if min(said) < 0 else max(said)
    if tag in CONTENT_TAGS:
        return TELLING
    if tag == "header" and inside_article:  # an article's own head line
        return 0.0
    return -TELLING if tag in BOILERPLATE_TAGS else 0.0


class _Element:
    __slots__ = ("block", "chars", "depth", "parent", "says", "skipped", "source", "tag")

    def __init__(self, tag: str, parent: "_Element | None", says: float, own: bool = False) -> None:
        self.tag, self.parent, self.says = tag, parent, says
        #: The element that says it, which may stand above; the nearest block element.
        self.source = self if own or parent is None else parent.source
        self.block = self if tag in BLOCKS or parent is None else parent.block
        self.skipped = tag in SKIPPED or (parent is not None and parent.skipped)
        self.depth, self.chars = 0 if parent is None else parent.depth + 1, 0


def blocks(page: str) -> list[tuple[str, _Element, float]]:
    """(text, innermost block element, share of characters in links) of every block with text, in page order."""
    root = _Element("", None, 0.0)
    stack, out, text, links, in_link = [root], [], [], 0, 0
    where, open_, telling = root, defaultdict(list), [root]

    def close() -> None:
        nonlocal text, links
        if text:
            if t := " ".join(_html.unescape("".join(text)).split()):
                out.append((t, where, min(1.0, links / len(t))))
            text, links = [], 0

    def leave(k: int) -> None:
        for e in stack[k:]:
            open_[e.tag].pop()
        del stack[k:]

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            if m[5] is not None and not stack[-1].skipped:
                text.append(m[5])
                if in_link:
                    links += len(m[5].strip())
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            close()
        if m[2]:
            if open_[tag] and (block or open_[tag][-1] > stack[-1].block.depth):
                leave(open_[tag][-1])
            if tag == "a":
                in_link = 0
        elif tag not in VOID:
            x = stack[-1].block
            if block and (x.tag == "p" or (x.tag == tag and tag in ("li", "dt", "dd", "td", "th", "tr"))):
                leave(x.depth)  # a block tag ends an open paragraph; li, td, ... end their like
            up = stack[-1]
            says = _says(tag, m[4], up.says > 0)
            if not m[4].endswith("/") or block:
                stack.append(_Element(tag, up, says or up.says, bool(says)))
                open_[tag].append(stack[-1].depth)
                if says:
                    telling.append(stack[-1])
                in_link = in_link or tag == "a"
        if block:
            where = stack[-1].block
    close()
    for t, e, _ in out:
        e.source.chars += len(t)
    for e in reversed(telling[1:]):  # text below each element that says something, in those around it too
        e.parent.source.chars += e.chars
    return out


def features(found: list[tuple[str, _Element, float]]) -> np.ndarray:
    """What the classifier sees of each block: its text and place, nothing of its ancestors' names."""
    n = len(found)
    rows = []
    for k, (t, e, links) in enumerate(found):
        words = t.count(" ") + 1
        rows.append((
            1.0, np.log1p(len(t)) / 5, np.log1p(words) / 5, links, float(links > 0.5), float(t[-1] in ".!?\"'»”"), sum(map(t.count, ".,;:!?")) / (words + 3),
            float(e.tag == "p"), float(e.tag in ("h1", "h2", "h3")), float(e.tag == "li"), float(e.tag == "div"), (k + 0.5) / n, float(k == n - 1),
        ))
    return np.array(rows).reshape(n, 13)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Logistic regression by Newton steps; zeros (no opinion) where there is one class alone."""
    w = np.zeros(x.shape[1] if len(x) else 13)
    if not len(y) or y.min() == y.max():
        return w
    for _ in range(min(rounds, 25)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def min_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source side. ``cost`` > 0: capacity from the source; < 0: to the sink."""
    n = len(cost)
    gain, loss = [max(0.0, c) for c in cost], [max(0.0, -c) for c in cost]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    if not any(x > _EPS for x in loss):
        return [True] * n
    if not any(g > _EPS for g in gain):
        return [False] * n
    while True:
        level, reached = _levels(gain, loss, near)
        if not reached:
            return [x >= 0 for x in level]
        _block(gain, loss, near, level)


_EPS = 1e-9


def _levels(gain: list[float], loss: list[float], near: list[dict[int, float]]) -> tuple[list[int], bool]:
    """Steps from the source over edges with room (-1: none), and whether the sink can be reached."""
    queue = deque(i for i, g in enumerate(gain) if g > _EPS)
    level, reached = [-1] * len(gain), False
    for i in queue:
        level[i] = 0
    while queue:
        i = queue.popleft()
        reached = reached or loss[i] > _EPS
        for j, w in near[i].items():
            if w > _EPS and level[j] < 0:
                level[j] = level[i] + 1
                queue.append(j)
    return level, reached


def _block(gain: list[float], loss: list[float], near: list[dict[int, float]], level: list[int]) -> None:
    """Augment shortest paths until every one has a full edge; an edge that leads nowhere is tried once."""
    left = [iter(near[i]) for i in range(len(gain))]
    for start in range(len(gain)):
        path = [start]
        while path and level[start] == 0 and gain[start] > _EPS:
            i = path[-1]
            if loss[i] > _EPS:
                edges = list(zip(path, path[1:]))
                flow = min(gain[start], loss[i], *(near[a][b] for a, b in edges)) if edges else min(gain[start], loss[i])
                gain[start] -= flow
                loss[i] -= flow
                full = None
                for k, (a, b) in enumerate(edges):
                    near[a][b] -= flow
                    near[b][a] += flow
                    if full is None and near[a][b] <= _EPS:
                        full = k
                if full is not None:
                    del path[full + 1 :]
                continue
            for j in left[i]:
                if level[j] == level[i] + 1 and near[i][j] > _EPS:
                    path.append(j)
                    break
            else:
                path.pop()


def told(found: list[tuple[str, _Element, float]]) -> np.ndarray:
    """What the deepest telling ancestor says of each block, less the more of the page's text a condemned one holds."""
    total = sum(len(t) for t, _, _ in found)
    out = []
    for _, e, _ in found:
        low, high = HINT_SHARES if e.says == -HINT else NAME_SHARES
        share = e.source.chars / total if e.says < 0 and e.source.tag not in ALWAYS else 0.0
        out.append(e.says * min(1.0, max(0.0, (high - share) / (high - low))))
    return np.array(out)


def costs(found: list[tuple[str, _Element, float]], weights: np.ndarray) -> np.ndarray:
    """Terminal capacities: above 0 for content, below 0 for boilerplate."""
    return PRIOR + np.clip(features(found) @ weights, -LEARNED, LEARNED) + told(found)


def smoothness(found: list[tuple[str, _Element, float]]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order, and between neighbours within one parent and one grandparent element."""
    edges, last = [], {}
    for k, (_, e, _) in enumerate(found):
        if k:
            edges.append((k - 1, k, NEXT))
        for up, w in ((e.parent, SIBLING), (e.parent.parent if e.parent else None, COUSIN)):
            if up is not None and up.tag != "":
                if (key := (id(up), w)) in last:
                    edges.append((last[key], k, w))
                last[key] = k
    return edges


def content(page: str, weights: np.ndarray) -> str:
    """The page's main text."""
    found = blocks(page)
    if not found:
        return ""
    side = min_cut(costs(found, weights).tolist(), smoothness(found))
    return "\n\n".join(t for (t, _, _), ok in zip(found, side) if ok)


def train(pages: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Classifier weights from a bounded sample of pages, labelled by their telling ancestors."""
    ids = pages.select("page_id").filter("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages)
    rows = pages.select("page_id", F.col(html).alias("h")).filter("h IS NOT NULL").join(F.broadcast(ids), "page_id", "left_semi")  # at most train_pages ids
    rows = rows.groupBy("page_id").agg(F.min("h").alias("h"))  # and as many rows: the least html of a repeated page_id

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for pid, h in zip(pdf["page_id"], pdf["h"]):
                found = blocks(h)
                said = told(found)
                sure = np.abs(said) == TELLING
                x = features(found)[sure] if found else np.zeros((0, 13))
                out.append((pid, x.tobytes(), (said[sure] > 0).astype(float).tobytes() if found else b""))
            yield pd.DataFrame(out, columns=["page_id", "x", "y"])

    got = sorted(rows.mapInPandas(run, "page_id long, x binary, y binary").collect())
    x = np.concatenate([np.zeros((0, 13)), *(np.frombuffer(r["x"]).reshape(-1, 13) for r in got)])
    return fit(x, np.concatenate([np.empty(0), *(np.frombuffer(r["y"]) for r in got)]))


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = train(pages, html)

    def run(found: list[str | None]) -> list[list]:
        texts = [content(h or "", weights) for h in found]
        return [texts, [len(t) for t in texts]]

    return add_columns(pages.select("page_id", "url", F.col(html).alias("h")), ["page_id", "url"], ["h"], run, {"text": "string", "n_chars": "long"})
