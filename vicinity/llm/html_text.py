"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block-level element. A line weighs its length; what is known of it may
lower that: lines of menus, headers, footers, sidebars, notices, adverts, forms, comments of readers and the
like, known by element or by the words of class and id, weigh nothing, links count for nothing, and where a
page marks its article (``article``, ``main`` or ``role="main"``) and that holds any text, lines outside weigh nothing. A name with a
preposition or article in it, as ``share-of-votes``, tells what a text is about and is no mark of noise.

Weights are summed over sliding windows of ``WINDOW`` lines, centred on each line. A surge is where the sum rises
to ``SURGE``, or to ``SHARE`` of the page's largest sum if that is less, so that short articles surge too; a
dive is where it falls to nothing: as many lines without weight. The stretch between, from where it first
weighs anything, is a candidate. Kept are the candidate of most weight, those with at least ``SHARE`` of it, and those
in the same container, which an advert or a list of links may have split. In a marked article every stretch is kept,
surging or not, however many lines of lists or adverts lie between; so on such pages the mark decides and not the sums. Lines at the ends
of these in other containers, or parted from the rest by weightless lines, go unless the sums over their own windows reach ``SHARE`` of
the page's largest, or they belong to that container; so do lines of lowered weight that would not surge alone.

A null page counts as empty; a page without such text gives the empty string. Of candidates of equal weight
the first is the one of most. Unclosed elements end with their parent; a page cut short keeps what it has; the
time taken is in proportion to the page, however deep its elements. Text is never shortened. Repeated rows
stay; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

WINDOW = 5
SURGE = 60
SHARE = 0.3
LINKS = 0.5

# Element names of HTML.
BLOCKS = set(
    """address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""".split()
)
VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
DROPPED = set(
    """aside audio button canvas datalist dialog footer form frameset head header iframe input math menu nav noembed noframes noscript object script search
    select style svg template textarea title video""".split()
)
HEADED = {"article", "main"}
# Elements that an opening tag closes, if they are open and no container stands between.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"br", "body", "html", "head", "title", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "figcaption", "frameset"}
CONTAINERS = set("article aside blockquote body details div dl fieldset footer form header html main nav ol section table td th ul".split())
# Words in class, id or role that name what is not the article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|complementary|consent|contentinfo|cookies?|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notice|pagination|pager|popup|promo\w*|recommended|related|replies|reply|responses|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])",
    re.I,
)
NOISE_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|promo\w*|recommended|related|replies|reply|sponsor\w*|teaser)(?=$|[\s_-])", re.I)
# Words that make a name a phrase.
PHRASE = re.compile(r"(?<=[_-])(?:of|on|in|the|and|for|to|by|about|with|from|at)(?=[_-])", re.I)
_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$))", re.S)
_MARK = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")


@dataclass
class Line:
    """The text of one block, the part of it in links, and what its ancestors say. ``home`` numbers its container."""

    text: str
    linked: int
    noise: bool
    article: bool
    home: int = 0


def _marks(attributes: str, words: re.Pattern = NOISE) -> tuple[bool, bool]:
    """Do the attributes name a noise block? The main part?"""
    noise = main = False
    for name, *values in _MARK.findall(attributes):
        name, value = name.lower(), html.unescape(next((v for v in values if v), "")).lower()
        if name in ("class", "id", "role"):
            noise |= any(words.search(v) and not PHRASE.search(v) for v in value.split())
            main |= name == "role" and value == "main"
        else:
            noise |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", ""))
    return noise, main


class Stack:
    """Open elements as (name, noise, article, link), with counts of the names open inside each container.

    The counts tell whether a search would find an element to close, so that only what is closed is looked at.
    """

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
        self.inside: list[Counter] = [Counter()]
        self.homes = [0]
        self.containers = Counter()
        self.number = 0

    @property
    def top(self) -> tuple[str, bool, bool, bool]:
        return self.open[-1]

    @property
    def home(self) -> int:
        return self.homes[-1]

    def push(self, name: str, noise: bool, article: bool, link: bool) -> None:
        self.open.append((name, noise, article, link))
        if name in CONTAINERS:
            self.number += 1
            self.containers[name] += 1
            self.inside.append(Counter())
            self.homes.append(self.number)
        else:
            self.inside[-1][name] += 1

    def _pop(self) -> str:
        name = self.open.pop()[0]
        if name in CONTAINERS:
            self.containers[name] -= 1
            self.inside.pop()
            self.homes.pop()
        else:
            self.inside[-1][name] -= 1
        return name

    def close(self, name: str) -> None:
        """Ends the innermost ``name``, with all in it; a container's border is only crossed by a container's end."""
        if self.containers[name] if name in CONTAINERS else self.inside[-1][name]:
            while self._pop() != name:
                pass

    def close_any(self, names: set[str]) -> None:
        """Ends the innermost element of ``names`` since the last container, or that container if it is one of them."""
        if any(self.inside[-1][n] for n in names):
            while self._pop() not in names:
                pass
        elif len(self.homes) > 1 and names & CONTAINERS:
            at = len(self.open) - 1
            while self.open[at][0] not in CONTAINERS:
                at -= 1
            if self.open[at][0] in names:
                while self._pop() not in names:
                    pass


def lines(page: str) -> list[Line]:
    """The page's blocks in order. Character references are decoded; white space is one space."""
    out: list[Line] = []
    stack = Stack()
    parts: list[str] = []
    linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if stack.top[3]:
            linked += len(raw)

    def end() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            _, noise, article, _ = stack.top
            out.append(Line(text, linked, noise, article, -1 if article else stack.home))
        parts.clear()
        linked = 0

    at = 0
    while at < len(page):
        tag = _TAG.search(page, at)
        if not tag:
            put(page[at:])
            break
        if tag.start() > at:
            put(page[at : tag.start()])
        at = tag.end()
        closing, name, attributes = tag[1], (tag[2] or "").lower(), tag[3] or ""
        if not name:
            continue
        if closing:
            if name in BLOCKS:
                end()
            stack.close(name)
            continue
        if name in BLOCKS or name in DROPPED:
            end()
        if name in RAW:
            stop = _END[name].search(page, at)
            at = stop.start() if stop else len(page)
            if name in DROPPED:
                continue
        closes = CLOSED_BY.get(name, {"p"} if name in ENDS_P else None)
        if closes:
            stack.close_any(closes)
        if name in VOID or attributes.endswith("/"):
            continue
        _, noise, article, link = stack.top
        named, main = _marks(attributes, NOISE_ARTICLE if name in HEADED else NOISE) if attributes else (False, False)
        inside = article or name in HEADED or main
        dropped = name in DROPPED and not (name == "header" and article)
        stack.push(name, noise or dropped or (named and name not in ("html", "body")), inside, link or name == "a")
    end()
    return out


def weights(rows: list[Line]) -> np.ndarray:
    """What each line counts for: its length, lowered by what is known of it."""
    marked = any(r.article and not r.noise for r in rows)  # a line has text
    out = np.zeros(len(rows))
    for n, r in enumerate(rows):
        size = len(r.text)
        if not r.noise:
            own = size if r.article else size - r.linked if r.linked <= LINKS * size else 0
            out[n] = own if r.article or not marked else 0
    return out


def block_sums(weight: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sums over ``window`` lines centred on each line."""
    total = np.concatenate([[0.0], np.cumsum(weight)])
    at = np.arange(len(weight))
    return total[np.minimum(at + window // 2 + 1, len(weight))] - total[np.maximum(at - window // 2, 0)]


def surges(weight: np.ndarray, least: float | None = None, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, after last) weighing line of the stretches that surge, each ended by a dive.

    ``least``: the sum of a surge; if none, ``SURGE`` or, if less, ``SHARE`` of the largest sum.
    """
    held = np.flatnonzero(weight > 0)
    if not len(held):
        return []
    sums = block_sums(weight, window)
    if least is None:
        least = min(SURGE, SHARE * sums.max())
    dives = np.flatnonzero(np.diff(held) > window)  # that many lines without weight, or more: a sum of nothing between
    first, last = held[np.concatenate([[0], dives + 1])], held[np.concatenate([dives, [len(held) - 1]])]
    return [(int(a), int(b) + 1) for a, b in zip(first, last, strict=True) if sums[a : b + 1].max() >= least]


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by one space."""
    rows = lines(page or "")
    weight = weights(rows)
    if any(r.article and w > 0 for r, w in zip(rows, weight, strict=True)):
        return " ".join(r.text for r, w in zip(rows, weight, strict=True) if w > 0)
    found = surges(weight)
    if not found:
        return ""
    peak = block_sums(weight).max()
    least = min(SURGE, SHARE * peak)
    size = [weight[a:b].sum() for a, b in found]
    a, b = found[int(np.argmax(size))]
    home = Counter()
    for n in range(a, b):
        home[rows[n].home] += weight[n]
    (own, _), *_ = home.most_common(1)
    kept = []
    for (a, b), s in zip(found, size, strict=True):
        mine = [n for n in range(a, b) if rows[n].home == own and weight[n] > 0]
        if s < SHARE * max(size) and not mine:
            continue
        # what stands apart at an end of the stretch, in another container or behind weightless lines, has to surge by itself
        apart = [n for n in range(a + 1, b) if (weight[n] > 0) != (weight[n - 1] > 0) or rows[n].home != rows[n - 1].home]
        runs = [r for r in np.split(np.arange(a, b), np.array(apart, int) - a) if weight[r[0]] > 0]
        strong = [k for k, r in enumerate(runs) if rows[r[0]].home == own or block_sums(weight[r]).max() >= SHARE * peak]
        for r in runs[strong[0] : strong[-1] + 1] if strong else []:
            kept += [rows[n].text for n in r if weight[n] >= LINKS * len(rows[n].text) or weight[n] >= least]
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1000):
            texts = [main_text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
