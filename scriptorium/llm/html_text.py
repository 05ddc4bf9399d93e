"""Main text of web pages by tree scoring.

A tolerant reader turns the html into a tree, closing what pages leave open (paragraphs, list items,
cells, stray end tags).  Elements that are no article by their nature (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) are told by their tag, their
role or a word of their class or id.  In the rest every block that holds text of its own earns
points for its length and its commas; they pass to its parent, half of them to the next ancestor,
and so on by halves, and an element's sum is discounted by the share of its text in links.  The
element with most points is the container; inside a semantic element (``article``, ``main``) that is
worth a tenth of the best, the search is held to it, and the enclosing article is kept whole.
Siblings of the container are kept too: other articles beside an article; else headings,
paragraphs, lists, tables and quotes that are not links, and what has a fifth of its points.

Within what is kept nothing is dropped for being short.  Character references are decoded, white
space inside a block (also ``br``) becomes one blank, blocks come in page order, one a line; an empty
block gives none.  Headings of an article's own ``header`` stay.  Lists with three links or more and
nothing else are menus.  Elements that are hidden hold no text of the page.

Nulls: a null html, and one without text, gives the empty text; a null id or url is passed on.
Every row gives one row, equal or not.  Reading takes time linear in the page, whatever is left open
in it.  An empty table gives no rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.common import blocks, over_batches

# Elements of HTML by what a reader has to know of them.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Inline elements that mark text up and never matter here.
MARKUP = frozenset("abbr acronym b bdi bdo big cite code del dfn em i ins kbd mark nobr q s samp small strike strong sub sup tt u var".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup option p plaintext "
    "pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that leave an open paragraph as it is, though they are blocks.
IN_PARAGRAPH = frozenset("option optgroup legend caption tbody td tfoot th thead tr".split())
#: What a start tag closes, and the elements that it does not look beyond.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "caption"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption"), ("table",)),
}
CELLS = ("td", "th", "caption", "table")
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
#: Elements that are never part of an article.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer head header iframe input menu nav noembed noframes noscript "
    "object script search select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
#: Words of a class or id that say what an element is, by kind.
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
OTHER_WORDS = frozenset(
    "ad adbox adcontainer ads adsense adslot adunit adv advert advertisement advertisements advertising adverts "
    "adwrapper alert banner breadcrumb breadcrumbs colophon consent cookie cookies dfp footer gdpr header login "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager "
    "pagination paywall popup popups promo promoted promotion recommendations recommended related search share "
    "sharing sidebar sidebars signin signup skyscraper social sponsor sponsored subscribe subscription taboola toast "
    "toolbar topbar trending widget widgets".split()
)
#: Words beside one of those that turn its sense.
TURNED = frozenset("has no not with without".split())
#: What stays beside a container for what it is.
PLAIN_SIBLINGS = HEADINGS | frozenset("blockquote dl figure ol p pre table ul".split())
#: Blocks whose own text earns points for what is above them only.
LEAVES = HEADINGS | frozenset("blockquote dd dt figcaption li p pre td th".split())
#: Lists that are menus if they are links.
MENUS = frozenset("dl ol table ul".split())

#: Points: one for a comma, and one for so many characters.
COMMAS, CHARACTERS = ",\u060c\u3001\uff0c", 100
#: Shares of the best element's points that a semantic element and a sibling need.
SEMANTIC_SHARE, SIBLING_SHARE = 0.1, 0.2

_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
_TAG_END = re.compile(r"[^>\"']*>")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"|'|[^\s>]*+))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)
_WORDS = re.compile(r"[A-Z]*[a-z]+|[A-Z]+|\d+")
#: The label of one comment.
_COMMENT = re.compile(r"(?:comment|reply)(?![a-z])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def attributes(html: str, at: int) -> tuple[dict[str, str] | None, int]:
    """Attributes of the tag whose name ends at ``at`` and the place after its ``>``; None where the
    page ends before."""
    plain = _TAG_END.match(html, at)
    if plain and plain.end() == at + 1:
        return {}, at + 1
    found: dict[str, str] = {}
    size = len(html)
    while True:
        m = _ATTRIBUTE.match(html, at)
        if m is None:
            end = html.find(">", at)
            return (found, end + 1) if end >= 0 else (None, size)
        name, value = m.group(1).lower(), m.group(2) or ""
        at = m.end()
        if value in ("'", '"'):
            end = html.find(value, at)
            if end < 0:
                return None, size
            value, at = html[at:end], end + 1
        found.setdefault(name, value)


def script_end(html: str, at: int) -> int:
    """Where the end tag of a script begins; a script within a comment is part of it."""
    depth = 0
    for m in _SCRIPT.finditer(html, at):
        mark = m.group(0)
        if mark == "<!--":
            depth = depth or 1
        elif mark == "-->":
            depth = 0
        elif not m.group(1):
            depth = 2 if depth else 0
        elif depth == 2:
            depth = 1
        else:
            return m.start()
    return len(html)


def labels_of(found: dict[str, str]) -> tuple[bool, bool]:
    """Whether class, id and role say reader comments, and another thing that is no article."""
    comment = other = False
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & TURNED:
            continue
        comment = comment or bool(words & COMMENT_WORDS)
        other = other or bool(words & OTHER_WORDS)
    return comment, other or found.get("role", "").strip().lower() in ROLES


class Tree:
    """Elements of a page in page order, each with its parent, and the runs of text.

    ``texts`` are (element, block number, text); a block number is new at every block's edge.
    """

    def __init__(self, html: str):
        self.tags, self.parents = ["body"], [-1]
        self.dropped, self.labelled, self.links = [False], [False], [False]
        self.headers, self.semantic, self.guarded = [False], [0], [True]
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        self._stack, self._blocks = [0], [0]
        self._open: dict[str, list[int]] = {"body": [0]}  # places in the stack
        self._read(html)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = _TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                return
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m.group(3):
                end = _COMMENT_END.search(html, at - 2)
                at = end.end() if end else size
                continue
            if not m.group(2):  # <!, <? or </ that begins no tag
                end = html.find(">", at - 1)
                at = end + 1 if end >= 0 else size
                continue
            tag = m.group(2).lower()
            found, at = attributes(html, at)
            if found is None:
                return
            if m.group(1):
                self._end(tag)
                continue
            self._start(tag, found, html[at - 2] == "/")
            if tag in RAW:
                if tag == "script":
                    end = script_end(html, at)
                else:
                    close = _RAW_END[tag].search(html, at)
                    end = close.start() if close else size
                if tag == "xmp":
                    self.texts.append((self._stack[-1], self.block, html[at:end]))
                at = end

    def _text(self, text: str) -> None:
        self.texts.append((self._stack[-1], self.block, references.unescape(text) if "&" in text else text))

    def _last(self, tags) -> int:
        """Place in the stack of the innermost open element of ``tags``; -1 if none is open."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=-1)

    def _pop(self, place: int) -> None:
        while len(self._stack) > place:
            tag = self.tags[self._stack.pop()]
            self._open[tag].pop()
            if tag in BLOCK:
                self._blocks.pop()
                self.block += 1

    def _start(self, tag: str, found: dict[str, str], closed: bool) -> None:
        if tag == "br":
            self.texts.append((self._stack[-1], self.block, " "))
            return
        if tag in MARKUP or tag in ("html", "head", "body", "wbr"):
            return
        block = tag in BLOCK
        if block:
            if tag not in IN_PARAGRAPH:
                p = self._last(("p",))
                if p > self._last(CELLS):
                    self._pop(p)
            if tag in HEADINGS and self.tags[self._stack[-1]] in HEADINGS:
                self._pop(len(self._stack) - 1)
            if tag in CLOSES:
                ended, beyond = CLOSES[tag]
                limit = self._last(beyond)
                while (place := self._last(ended)) > limit:
                    self._pop(place)
            self.block += 1
        if tag in VOID or closed and (tag in ("svg", "math") or self._last(("svg", "math")) >= 0):
            return
        node, parent = len(self.tags), self._stack[-1]
        comment, other = labels_of(found) if found else (False, False)
        role = found.get("role", "").strip().lower()
        if tag == "article" or found.get("itemprop") == "articleBody":
            semantic = 2
        else:
            semantic = int(tag == "main" or role == "main")
        if semantic:
            comment = any(_COMMENT.match(name) for name in f"{found.get('class', '')} {found.get('id', '')}".split())
        hidden = "hidden" in found or bool(_HIDDEN.search(found.get("style", "")))
        inner_header = tag == "header" and bool(self._open.get("article"))
        self.tags.append(tag)
        self.parents.append(parent)
        self.dropped.append(hidden or comment or tag in DROPPED and not inner_header)
        self.labelled.append((other or tag == "form") and not semantic and not inner_header)
        self.headers.append(inner_header)
        self.links.append(tag == "a" and "href" in found)
        self.semantic.append(semantic)
        self.guarded.append(False)
        self._open.setdefault(tag, []).append(len(self._stack))
        if block:
            self._blocks.append(len(self._stack))
        self._stack.append(node)
        if semantic and not comment:
            while not self.guarded[node]:  # no word of a class drops what holds an article
                self.guarded[node] = True
                node = self.parents[node]

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.texts.append((self._stack[-1], self.block, " "))
            return
        if tag in MARKUP or tag in ("html", "head", "body"):
            return
        place = self._last(HEADINGS if tag in HEADINGS else (tag,))
        if tag in BLOCK:
            self.block += 1
        elif place < self._blocks[-1]:
            return
        if place > 0 and (tag in TABLE_PARTS or place > self._last(CELLS)):
            self._pop(place)

    def states(self, labels: bool) -> list[int]:
        """Per element: 0 kept, 1 in the header of an article, 2 dropped."""
        out = []
        for i, parent in enumerate(self.parents):
            above = out[parent] if i else 0
            if above == 2 or self.dropped[i] or labels and self.labelled[i] and not self.guarded[i]:
                out.append(2)
            elif self.headers[i]:
                out.append(1)
            else:
                out.append(0 if self.tags[i] in HEADINGS else above)
        return out


class Scores:
    """Points, lengths of text and of linked text, and links below every element."""

    def __init__(self, tree: Tree, states: list[int]):
        size = len(tree.tags)
        self.points, self.length, self.linked, self.links = ([0.0] * size, [0] * size, [0] * size, [0] * size)
        own, block_of, in_link = [0.0] * size, [0] * size, [False] * size
        for i in range(1, size):
            parent = tree.parents[i]
            block_of[i] = i if tree.tags[i] in BLOCK else block_of[parent]
            in_link[i] = in_link[parent] or tree.links[i]
            self.links[i] = int(tree.links[i] and states[i] == 0)
        for i, _, text in tree.texts:
            if states[i] == 0 and (n := len(text.strip())):
                self.length[i] += n
                self.linked[i] += n * in_link[i]
                own[block_of[i]] += n / CHARACTERS + sum(map(text.count, COMMAS))
        for i in range(size - 1, -1, -1):
            parent = tree.parents[i]
            if i:
                for sums in (self.length, self.linked, self.links):
                    sums[parent] += sums[i]
                if tree.tags[i] in BLOCK:
                    self.points[block_of[parent]] += own[i] + self.points[i] / 2
            if tree.tags[i] not in LEAVES:
                self.points[i] += own[i]
        self.points = [p * (1 - self.density(i)) for i, p in enumerate(self.points)]

    def density(self, i: int) -> float:
        return self.linked[i] / self.length[i] if self.length[i] else 0.0


def containers(tree: Tree, states: list[int], scores: Scores) -> set[int]:
    """The best container and those of its siblings that belong to it."""
    inside = [0]
    best = [0, 0, 0]  # the best element within any semantic element, within main or article, within an article
    for i in range(len(tree.tags)):
        if i:
            inside.append(max(inside[tree.parents[i]], tree.semantic[i]) if states[i] == 0 else 0)
        if states[i] == 0 and (i == 0 or tree.tags[i] in BLOCK):
            for level in range(inside[i] + 1):
                if scores.points[i] > (scores.points[best[level]] if best[level] or not level else 0):
                    best[level] = i
    level = next((n for n in (2, 1) if scores.points[best[n]] >= SEMANTIC_SHARE * scores.points[best[0]] and best[n]), 0)
    top = best[level]
    at = top
    while level and inside[tree.parents[at]] >= level and tree.parents[at] > 0:
        at = tree.parents[at]
    if level:
        top = at
    kept = {top}
    if top:
        parent, enough = tree.parents[top], SIBLING_SHARE * scores.points[best[level]]
        for i, up in enumerate(tree.parents):
            if up != parent or i == top or states[i] != 0 or not scores.length[i]:
                continue
            if level == 2:
                belongs = tree.semantic[i] == 2 and scores.points[i] >= enough
            elif tree.tags[i] in PLAIN_SIBLINGS:
                belongs = scores.density(i) < 0.5
            else:
                belongs = scores.points[i] >= enough or parent > 0 and scores.density(i) < 0.25
            if belongs:
                kept.add(i)
    return kept


def main_text(html: str | None) -> str:
    """The main text of a page, one block a line; empty if it has none."""
    if not html:
        return ""
    tree = Tree(html)
    for labels in (True, False):
        states = tree.states(labels)
        scores = Scores(tree, states)
        found = _kept_text(tree, states, scores)
        if found or any(tree.semantic) or not (HEADINGS & set(tree.tags) or tree.tags.count("p") > 2):
            return found
    return found


def _kept_text(tree: Tree, states: list[int], scores: Scores) -> str:
    if not scores.length[0]:
        return ""
    kept = containers(tree, states, scores)
    taken = []
    for i, parent in enumerate(tree.parents):
        menu = tree.tags[i] in MENUS and scores.links[i] >= 3 and scores.density(i) >= 0.9
        taken.append((i in kept or i > 0 and taken[parent]) and not menu)
    parts: dict[int, list[str]] = {}
    for i, block, text in tree.texts:
        if taken[i] and states[i] == 0:
            parts.setdefault(block, []).append(text)
    lines = (" ".join("".join(run).split()) for run in parts.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, the main ``text`` and ``n_chars``, its code points, of every page."""
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        pages[html_col].cast("string").alias("html"),
    )

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in blocks(batch, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": list(map(len, texts))}

    return over_batches(rows, lambda: each, "page_id long, url string, text string, n_chars long")
