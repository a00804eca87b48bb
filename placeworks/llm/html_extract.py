"""Main text of web pages by composite text density.

Every element gets the density of its text, in characters per tag, adjusted
for links; the element whose children's densities have the largest sum is the
content, and the least density on its way up to the body is the threshold that
other elements must reach to count as content too. Elements that are never
article text by their tag, role or visibility are left out before. Names only
weigh: what an element called like page furniture holds counts for a tenth in
the choice, and it is left out unless the content is inside it. What an article
or the main part holds is preferred to denser text outside, comments are left
out where there are other paragraphs, and a form unless it is the page.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

# Element names of HTML by how a reader treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset(
    "script style textarea title iframe noembed noframes xmp head nav footer aside button select option input noscript template svg math canvas object audio video dialog menu map datalist".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Parts of class names and ids that tell page furniture.
FURNITURE = frozenset(
    """ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb
    breadcrumbs sidebar sidebars widget widgets footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal
    overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist
    reply replies respond disqus discussion toolbar pagination pager copyright banner skip outbrain taboola""".split()
)
#: Those of them that tell what readers wrote.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: What the density inside an element with such a name counts for.
FURNITURE_WEIGHT = 0.1
#: The part of all text outside of them that the text of an article, or of a form that is the page, has at least.
ARTICLE_SHARE, FORM_SHARE = 0.2, 1.0
HEADERS = frozenset("header site-header page-header main-header top-header".split())
NEGATIONS = frozenset("no has with without is not".split())
SAFE = frozenset("html body article main".split())
#: What an opening tag closes, if it is open within the nearest of the listed limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
P_LIMITS = frozenset("table td th caption button object html body".split())
P_CLOSERS = BLOCKS - {"br", "html", "body", "caption", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}

TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<odd>[!?][^>]*+(?:>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z)))""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.I)


def _told(rest: str, tag: str) -> tuple[bool, bool, bool]:
    """Whether attributes say that an element is no article text, and whether its name is one of page furniture, of comments among it."""
    named = comments = False
    for name, value in ATTRIBUTE.findall(" " + rest.rstrip(">")):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, False
        if name == "role" and value in ROLES:
            return True, False, False
        if name in ("class", "id") and tag not in SAFE:
            for word in value.split():
                parts = re.split(r"[-_:]+", word)
                named |= word in HEADERS or parts[0] not in NEGATIONS and not FURNITURE.isdisjoint(parts)
                comments |= parts[0] not in NEGATIONS and not COMMENTS.isdisjoint(parts)
    return False, named, comments


class Page:
    """Elements in the order they open, and the text and block borders between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.named, self.last = ["#root"], [-1], [False], [False], [0]
        self.comments: list[int] = []
        self.events: list[tuple[int, str | None]] = []  # text of an element, or None where a block begins or ends
        self.stack = [0]
        #: Where in the stack each tag is open, so that no tag walks the stack.
        self.open: dict[str, list[int]] = defaultdict(list)
        at = 0
        for m in iter(lambda: TAG.search(source, at), None):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if not m["name"]:
                continue
            name = m["name"].lower()
            if m["end"]:
                self._close(name)
                continue
            self._open(name, m["rest"])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else len(source)
        if at < len(source):
            self._text(source[at:])
        while self.stack:
            self._pop()

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if not self.out[top]:
            self.events.append((top, html.unescape(raw)))

    def _pop(self) -> None:
        i = self.stack.pop()
        self.last[i] = len(self.tag)
        if i:
            self.open[self.tag[i]].pop()
        if self.tag[i] in BLOCKS:
            self.events.append((i, None))

    def _deepest(self, names: Iterable[str]) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def _pop_to(self, names: Iterable[str], limits: Iterable[str]) -> None:
        """Closes the nearest of names, and what is open inside it, unless one of limits is nearer."""
        depth = self._deepest(names)
        if depth and depth >= self._deepest(limits):
            while len(self.stack) > depth:
                self._pop()

    def _open(self, name: str, rest: str) -> None:
        if name in P_CLOSERS:
            self._pop_to(("p",), P_LIMITS)
        if name in CLOSES:
            self._pop_to(*CLOSES[name])
        top = self.stack[-1]
        outside = name == "header" and not (self.open.get("article") or self.open.get("main"))
        never, named, comments = _told(rest, name)
        i = len(self.tag)
        if comments:
            self.comments.append(i)
        self.tag.append(name)
        self.parent.append(top)
        self.out.append(self.out[top] or name in DROPPED or outside or never)
        self.named.append(named)
        self.last.append(i + 1)
        if name in BLOCKS:
            self.events.append((i, None))
        if name not in VOID and (not rest.endswith("/>") or name in BLOCKS):
            self.open[name].append(len(self.stack))
            self.stack.append(i)

    def _close(self, name: str) -> None:
        if name == "br":
            self.events.append((self.stack[-1], None))
        # A stray end tag must not close the page around it.
        self._pop_to((name,), ("body",) if name in ("p", "div", "span", "b", "i", "a", "li") else ())

    def _leave_out(self, some: Iterable[int]) -> None:
        for i in some:
            self.out[i] = True
        for i in range(1, len(self.tag)):
            self.out[i] = self.out[i] or self.out[self.parent[i]]

    def _masses(self) -> tuple[Callable[[int], int], Callable[[int], int]]:
        """Of an element: the characters of its text, less those of links, and those of them in paragraphs; without what is left out."""
        n = len(self.tag)
        plain, told = [0] * (n + 1), [0] * (n + 1)
        linked, within = [False] * n, [False] * n
        for i in range(1, n):
            linked[i] = self.tag[i] == "a" or linked[self.parent[i]]
            within[i] = self.tag[i] == "p" or within[self.parent[i]]
        for i, text in self.events:
            if text is not None and not self.out[i] and not linked[i]:
                size = len(" ".join(text.split()))
                plain[i + 1] += size
                told[i + 1] += size * within[i]
        for sums in (plain, told):
            for i in range(n):
                sums[i + 1] += sums[i]
        return (lambda i: plain[self.last[i]] - plain[i]), (lambda i: told[self.last[i]] - told[i])

    def _sort_out(self) -> None:
        """Leaves out forms, but for one that holds most of the page, and comments, where there are paragraphs beside them."""
        if forms := [i for i, t in enumerate(self.tag) if t == "form" and not self.out[i]]:
            mass, _ = self._masses()
            whole = mass(0)
            self._leave_out(i for i in forms if mass(i) <= FORM_SHARE * (whole - mass(i)))
        if self.comments:
            _, told = self._masses()
            outer: list[int] = []
            for i in self.comments:
                if not outer or i >= self.last[outer[-1]]:
                    outer.append(i)
            if told(0) > sum(told(i) for i in outer):
                self._leave_out(outer)

    def _articles(self, usable: list[int]) -> list[int]:
        """Those of usable that are in an article, or else in the main part, if there is one of some weight that says more than links do."""
        mass, _ = self._masses()
        for tag in ("article", "main"):
            tops: list[int] = []
            for i in usable:
                if self.tag[i] == tag and (not tops or i >= self.last[tops[-1]]):
                    tops.append(i)
            held = [mass(i) for i in tops]
            if tops and max(held) > 0 and max(held) >= ARTICLE_SHARE * (mass(0) - sum(held)):
                return [i for i in usable if (k := bisect_right(tops, i) - 1) >= 0 and i < self.last[tops[k]]]
        return usable

    def densities(self) -> tuple[list[float], list[float]]:
        """Of each element: its composite text density, and the sum of its children's. Elements with names of page furniture count inside themselves alone."""
        n = len(self.tag)
        chars, links, tags, anchors = [0] * n, [0] * n, [0] * n, [0] * n
        linked = [False] * n
        for i in range(1, n):
            linked[i] = self.tag[i] == "a" or linked[self.parent[i]]
        for i, text in self.events:
            if text is not None:
                size = len(" ".join(text.split()))
                chars[i] += size
                links[i] += size * linked[i]
        for i in range(n - 1, 0, -1):
            if not self.out[i] and not self.named[i]:
                up = self.parent[i]
                chars[up] += chars[i]
                links[up] += links[i]
                tags[up] += tags[i] + 1
                anchors[up] += anchors[i] + (self.tag[i] == "a")
        share = links[0] / max(chars[0], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if chars[i] and not self.out[i]:
                c, lc, t, lt = chars[i], max(links[i], 1), max(tags[i], 1), max(anchors[i], 1)
                base = math.log(c / max(c - links[i], 1) * links[i] + share * c + math.e)
                density[i] = c / t * max(math.log(max(c / lc * t / lt, 1)) / math.log(max(base, 1 + 1e-9)) if base > 1 else math.log(max(c / lc * t / lt, 1)), 0)
            if i and not self.named[i]:
                total[self.parent[i]] += density[i]
        return density, total

    def content(self) -> list[int]:
        """The elements whose whole text is content, in page order, none inside another."""
        self._sort_out()
        density, total = self.densities()
        body = next((i for i, t in enumerate(self.tag) if t == "body"), 0)
        weight = [1.0] * len(self.tag)
        for i in range(1, len(self.tag)):
            weight[i] = FURNITURE_WEIGHT if self.named[i] else weight[self.parent[i]]
        usable = [i for i in range(body, self.last[body]) if not self.out[i]]
        if not usable:
            return []
        unnamed = [i for i in usable if weight[i] == 1.0]
        inside = self._articles(unnamed)
        best = max(usable if len(inside) == len(unnamed) else inside, key=lambda i: (weight[i] * total[i], weight[i] * density[i], -i))
        path = [best]
        while path[-1] != body and self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        # Names of furniture leave out what is not on the way to the content.
        for i in set(range(1, len(self.tag))) - set(path) if any(self.named) else ():
            self.out[i] = self.out[i] or self.named[i]
        for i in range(1, len(self.tag)):
            self.out[i] = self.out[i] or self.out[self.parent[i]]
        usable = [i for i in usable if not self.out[i]]
        least = min(density[i] for i in path)
        holder = "article" if any(self.tag[i] == "article" for i in path) else "main"
        for i in path:  # what stands beside the densest part in its article is article too
            if self.tag[i] == holder:
                best = i
                break
        else:
            up = self.parent[best]
            if up > body and any(self.tag[i] == "h1" and self.parent[i] == up and not self.out[i] for i in range(up + 1, best)):
                best = up  # the heading stands before the part that holds the paragraphs
        if self.tag[best] not in ("article", "main") and best != body and least > 0:
            # Every element dense enough, outside the one selected, and the parts beside it that hold paragraphs:
            # density grows with length, so a short section of a page can miss a threshold set by a long one.
            holds = lambda i: any(self.tag[j] == "p" and not self.out[j] for j in range(i + 1, self.last[i]))
            beside = lambda i: self.parent[i] == self.parent[best] and self.tag[i] == self.tag[best] and holds(i)
            above = set(path)
            more = [i for i in usable if i not in above and (density[i] >= least or beside(i))]
            picked = sorted({best, *more})
        else:
            picked = [best]
        out: list[int] = []
        for i in picked:
            if not out or i >= self.last[out[-1]]:
                out.append(i)
        return out

    def main_text(self) -> str:
        ranges = [(i, self.last[i]) for i in self.content()]
        firsts = [a for a, _ in ranges]
        inside = lambda i: (k := bisect_right(firsts, i) - 1) >= 0 and i < ranges[k][1]
        blocks: list[str] = []
        now: list[str] = []

        def flush() -> None:
            if block := " ".join("".join(now).split()):
                blocks.append(block)
            now.clear()

        for i, text in self.events:
            if text is None:
                flush()
            elif not self.out[i] and inside(i):
                now.append(text)
        flush()
        return " ".join(blocks)


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.sliced(batches):
        texts = [main_text(h) for h in pc.fill_null(batch["html"], "").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    text is the article, its blocks joined by one space in page order, white
    space inside a block made one space, character references decoded; n_chars
    counts its code points. Null, empty and textless pages give an empty text.
    Broken markup is read as far as it goes. Repeated rows get a row each; null
    ids and urls stay null. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(T.task(_extracted), "page_id long, url string, text string, n_chars long")
