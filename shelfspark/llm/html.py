"""Main text of web pages by consensus host paths.

Each page is read into containers. A container's score is the clean text in it:
characters outside links and outside what is marked as no content (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments). Words of a class or id mark
an element unless it holds the page's main or most of its articles' text, or, without any of them elsewhere,
most unlinked text or the only heading (layout wrappers such as ``content right-sidebar``). A page's own pick
is the deepest container that holds most of the page's clean text; containers inside an article,
or beside clean text of the container they are in, are not picked, so titles and leads stay. Its
generalised path (tags with their classes, numbers made alike) is the page's vote.

Votes are counted per host in Spark (one row per page before, one row per task,
host and path after partial aggregation); the paths with at least a fifth of
the host's votes win. Each page is then extracted again: from the outermost container on a
winning path around its own pick, else from all containers on winning paths, or from its own
pick where none is found.

Defined results: a null or empty page, or one without text, gives the empty text;
a null url votes under the empty host; broken markup is read as browsers do in the common
cases (open paragraphs, list items and cells end at the next one); very long
pages are whole; repeated rows each get their row (and vote); an empty table gives no rows;
only ``page_id``, ``url`` and ``html`` are read of the input's columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import id_text, with_long_id, written

MOST = 0.75  # of the page's clean text is in the container picked
SHARE = 0.2  # of the host's votes makes a path win

# Element names and class words (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img br".split())
CONTAINERS = frozenset("html body main article section div td table tbody tr center".split())
DROPPED = frozenset(
    "nav header footer aside form script style noscript template svg canvas iframe object button select option "
    "textarea input dialog menu head title audio video map".split())
NO_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments disqus reply "
    "replies respond responses cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription "
    "newsletter signup share sharing social related recommended recommendations widget widgets toolbar pagination "
    "pager login search skip".split())
# Roles that say the same.
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
READERS = frozenset("comment comments disqus reply replies respond responses".split())
SOFT, HARD = 1, 2
KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6 tbody tr".split())
# start tag -> open elements that it ends, up to the nearest of the scope
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table select body html article section div main td th blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>[^>"']*(?:"[^"<]*"[^>"']*|'[^'<]*'[^>"']*)*)>"""
    r"|</?(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _words(attrs: dict[str, str]) -> set[str]:
    """Words of the classes and the id that say no content."""
    found, before = set(), ""
    for word in _WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}"):
        word = word.lower()
        if word in NO_CONTENT and before not in ("has", "with", "no", "without"):
            found.add(word)
        before = word
    return found


def _marked(tag: str, attrs: dict[str, str]) -> int:
    """Whether an element is no content: HARD by its name, SOFT by its role, classes or id."""
    if tag in DROPPED:
        return HARD
    if tag in KEPT:
        return 0
    return SOFT if attrs.get("role", "").lower() in NO_CONTENT_ROLES or _words(attrs) else 0


class _Soft:
    """What an element marked by its role, classes or id holds."""

    def __init__(self, at: int, depth: int, comments: bool):
        self.at, self.depth, self.comments = at, depth, comments
        self.text = self.articles = 0  # unlinked characters, and those in articles inside
        self.main = self.heading = False


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A path's step: the tag and its classes, numbers made alike."""
    classes = sorted(set(attrs.get("class", "").lower().split()))
    return ".".join([tag, *(re.sub(r"\d+", "0", c) for c in classes)])


class Page:
    """Containers and text blocks of a page, in page order.

    Elements marked by role, class or id alone are read like the others before they are
    dropped; those that turn out to hold the content (``_holds``) stay, and the page is read again.
    """

    def __init__(self, html: str):
        self._kept: frozenset[int] = frozenset()
        while True:
            self._read(html)
            more = frozenset(e.at for e in self._softs if self._holds(e))
            if not more:
                return
            self._kept |= more

    def _holds(self, e: _Soft) -> bool:
        """Whether a marked element holds the page's main or most of its articles' text; or, where no article or main is
        outside of marked elements, most of all unlinked text, or the only heading. Reader comments never do where one is."""
        outside = "article" in self._outside or "main" in self._outside
        if not e.text or e.comments and outside:
            return False
        return (e.main or e.articles > 0 and 2 * e.articles >= self._articles
                or not outside and 2 * e.text > sum(self.clean) + self._soft or e.heading and not self._outside)

    def _read(self, html: str) -> None:
        self.paths: list[str] = [""]  # of each container; the first holds the whole page
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, str]] = []  # (innermost container, text)
        self.clean: list[int] = [0]  # clean characters directly in each container
        self._stack: list[tuple[str, int, int]] = []  # (tag, container, dropped)
        self._softs: list[_Soft] = []  # marked elements outside of dropped ones
        self._open_softs: list[_Soft] = []
        self._open_articles: list[int] = []  # depths, of those that no class marks
        self._soft = self._articles = 0  # unlinked characters in marked elements, and in articles
        self._outside: set[str] = set()  # of article, main, h1: seen outside of marked elements
        self._buffer: list[str] = []
        self._links = self._linked = 0
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag:
                tag = tag.lower()
                if m["end"] or html.startswith("</", m.start()):
                    self._close(tag)
                else:
                    self._open(tag, m["attrs"] or "", m.start())
        if at < len(html):
            self._text(html[at:])
        self._flush()

    def _top(self) -> tuple[int, int]:
        return (self._stack[-1][1], self._stack[-1][2]) if self._stack else (0, 0)

    def _text(self, raw: str) -> None:
        dropped = self._top()[1]
        if dropped == SOFT and not self._links:
            size = len("".join(unescape(raw).split()))
            self._soft += size
            if self._open_articles:
                self._articles += size
            for e in self._open_softs:
                e.text += size
                if self._open_articles and self._open_articles[-1] > e.depth:
                    e.articles += size
        elif not dropped:
            text = unescape(raw)
            self._buffer.append(text)
            if self._links:
                self._linked += len("".join(text.split()))

    def _flush(self) -> None:
        if self._buffer:
            words = "".join(self._buffer).split()
            if words:
                container = self._top()[0]
                self.blocks.append((container, " ".join(words)))
                size = max(0, sum(map(len, words)) - self._linked)
                self.clean[container] += size
                if self._open_articles:
                    self._articles += size
            self._buffer = []
        self._linked = 0

    def _pop_to(self, depth: int) -> None:
        for tag, _, _ in self._stack[depth:]:
            if tag == "a":
                self._links -= 1
        del self._stack[depth:]
        while self._open_softs and self._open_softs[-1].depth >= depth:
            self._open_softs.pop()
        while self._open_articles and self._open_articles[-1] >= depth:
            self._open_articles.pop()

    def _open(self, tag: str, raw: str, at: int) -> None:
        container, dropped = self._top()
        if tag == "br":
            if not dropped:
                self._buffer.append(" ")
            return
        block = tag not in INLINE
        if block:
            self._flush()
            self._imply(tag)
            container, dropped = self._top()
        if tag in VOID:
            return
        attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw else {}
        marked = _marked(tag, attrs) if dropped < HARD and at not in self._kept else 0
        if marked:
            self._flush()
            dropped = max(dropped, marked)
            if marked == SOFT:
                self._softs.append(_Soft(at, len(self._stack), bool(_words(attrs) & READERS)))
                self._open_softs.append(self._softs[-1])
        if tag in ("article", "main", "h1") and dropped < HARD and not (tag == "article" and _words(attrs)):
            if tag == "article":
                self._open_articles.append(len(self._stack))
            if not dropped:
                self._outside.add(tag)
            for e in self._open_softs:
                e.main |= tag == "main"
                e.heading |= tag == "h1"
        if tag in CONTAINERS and not dropped:
            self.parents.append(container)
            self.paths.append(f"{self.paths[container]}/{_step(tag, attrs)}")
            self.clean.append(0)
            container = len(self.paths) - 1
        if tag == "a":
            self._links += 1
        self._stack.append((tag, container, dropped))

    def _imply(self, tag: str) -> None:
        """End the open elements that a block's start tag ends."""
        for depth in range(len(self._stack) - 1, -1, -1):
            name = self._stack[depth][0]
            if name == "p" or name in ENDS.get(tag, ()):
                self._pop_to(depth)
                if tag not in ("tr", "tbody"):
                    return
            elif name in SCOPE and not (tag in ("tr", "tbody") and name in ("td", "th")):
                return

    def _close(self, tag: str) -> None:
        for depth in range(len(self._stack) - 1, -1, -1):
            if self._stack[depth][0] == tag:
                if tag not in INLINE or self._stack[depth][2] != (self._stack[depth - 1][2] if depth else 0):
                    self._flush()
                if tag in INLINE and any(t not in INLINE for t, _, _ in self._stack[depth + 1:]):
                    return  # a stray inline end doesn't end blocks
                self._pop_to(depth)
                return
            if self._stack[depth][0] in ("table", "body", "html") and tag in INLINE | {"p", "li"}:
                return

    def totals(self) -> list[int]:
        """Clean characters in each container and what it contains (children follow their parents)."""
        total = list(self.clean)
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += total[k]
        return total

    def _ends(self, k: int) -> bool:
        """Whether no container inside ``k`` stands for it: an article, or one with clean text beside its containers."""
        return self.clean[k] > 0 or self._is(k, "article")

    def _is(self, k: int, *tags: str) -> bool:
        return self.paths[k].rsplit("/", 1)[-1].split(".", 1)[0] in tags

    def pick(self) -> int:
        """The deepest container that holds most of the clean text and leaves none beside it in those around it."""
        total = self.totals()
        best = 0
        for k in range(1, len(total)):
            if total[0] and total[k] >= MOST * total[0] and self.parents[k] == best and not self._ends(best):
                best = k
        return best

    def text(self, chosen: set[int]) -> str:
        """Blocks inside the chosen containers, in page order."""
        inside = [False] * len(self.paths)
        for k in range(len(self.paths)):
            inside[k] = k in chosen or (k > 0 and inside[self.parents[k]])
        return "\n\n".join(t for k, t in self.blocks if inside[k])

    def extract(self, winners: list[str]) -> str:
        """Text of the outermost container on a winning path around the page's own pick; where there is none, of
        all containers on winning paths, each with the article it is in; where there are none, of the pick.

        The whole page (html, body) is a result only where no other path wins.
        """
        total = self.totals()
        pick = self.pick()
        found = [k for k in range(len(self.paths)) if total[k] and self.paths[k] in winners]
        found = [k for k in found if k and not self._is(k, "html", "body")] or found
        if not found:
            return self.text({pick})
        around = self._around(pick)
        enclosing = [k for k in found if k in around]
        if enclosing:
            return self.text({enclosing[0]})
        return self.text({next((a for a in reversed(self._around(k)) if self._is(a, "article")), k) for k in found})

    def _around(self, k: int) -> list[int]:
        """The container and those it is in."""
        out = [k]
        while out[-1]:
            out.append(self.parents[out[-1]])
        return out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): how many pages of a host pick a container on the path."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            picks = []
            for html in rows["html"]:
                page = Page(html)
                picks.append(page.paths[page.pick()] if page.totals()[0] else None)
            yield pd.DataFrame({"host": rows["host"], "path": pd.Series(picks, index=rows.index, dtype=object)})

    picked = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    return picked.mapInPandas(vote, "host string, path string").where("path IS NOT NULL").groupBy("host", "path").agg(
        F.count("*").alias("votes"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, winners): the paths with at least SHARE of the host's votes (five at most, by arithmetic)."""
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    enough = votes.join(total, "host").where(F.col("votes") >= SHARE * F.col("total"))
    return enough.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("winners"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page (page_id, url, html)."""

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [Page(html).extract([] if w is None else list(w)) for html, w in zip(rows["html"], rows["winners"])]
            yield pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": texts})

    # Written first, so that its size is known when the join is planned.
    winners = written(winning_paths(host_votes(pages)), "html-winners").withColumnRenamed("host", "_host")
    mine = pages.select(id_text("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    # One row per host on the right: broadcast if its size allows, so the pages stay where they are;
    # else both sides are dealt by host and a hot host's pages are split.
    joined = mine.join(winners, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "winners")
    texts = with_long_id(joined.mapInPandas(again, "page_id string, url string, text string"), "page_id")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
