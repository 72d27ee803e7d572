"""Main text of web pages by removing site templates.

Every page is read into element subtrees. A subtree's hash covers its tags and texts.
Spark counts on how many pages of a host each block subtree stands, wherever it stands;
pages of a host with the same text before any template is cut count once, so copies make no template. A subtree on
at least ``share`` of the host's pages, and on at least ``least_pages``, is template and
is cut out first. A host has at most (block elements a page / share) such
subtrees, so the list of one host is short; the lists join the pages by host, and Spark
splits a host with many pages, or sends the lists to the tasks where they are small.

An article's own blocks are known by their content: inside article and main elements a recurring subtree is template only where
at least half of its text are links, as in menus and boxes of further reading, and only where that leaves half of
the text; a lead or licence that many articles share stays. Subtrees around articles go whole, but for the
longest article of a page and for main. A page with neither keeps its recurring blocks where less than a tenth of its
text would be left: it is one of many versions of a text.

What a single page shows to be no article goes next: navigation, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments, by element, role, class
or id. A class or id counts as a whole token between spaces, never by a word in a longer one; headings and ids that
may be anchors go by no name inside article and main, and a name that would empty a page that has an article or main is passed over.

The root is chosen by the text it holds: the article elements, unless main has more text outside of them than the longest
of them holds, then main; the body if the text outside both is longer than the longest of several articles, or four
times as long as a lone article or main.

Blocks are joined by one newline in page order; white space inside a block,
also a line break element, becomes one space. Character references are decoded.

Defined cases: null or empty html gives an empty text. Pages with a null url, or
one without a host, have no site and lose no template. Unclosed and misnested elements are
closed as browsers do. What begins like a tag but has no end is text; so is the first
tag whose quotes hide its end, and after it tags end at their first ``>``. A page takes time in proportion to its length. Repeated rows count as one page and each gives a
row. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrail.session import materialize

SHARE = 0.5
LEAST_PAGES = 10

# Fixed values of the HTML standard and of common class names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript template noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul xmp".split()
)
_GONE = frozenset("nav footer aside form button select menu dialog datalist head".split())
_GONE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
_GONE_NAMES = frozenset(
    # menus
    "nav navbar navigation menu menubar main-nav main-menu nav-menu nav-bar breadcrumb breadcrumbs breadcrumb-nav skip-link"
    " share share-buttons social-share social-links"
    # headers and footers
    " masthead site-header footer site-footer page-footer"
    # sidebars
    " sidebar left-sidebar right-sidebar sidebar-left sidebar-right related-posts"
    # notices
    " notice notices cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr popup modal overlay newsletter-signup"
    # adverts
    " ad ads advert adverts advertisement advertising adsense sponsored ad-banner ad-slot ad-container"
    # reader comments
    " comment comments comments-area comment-list disqus respond replies".split()
)
# Ids that are no anchor of a heading inside an article or main.
_GONE_IDS = frozenset("comments disqus disqus_thread respond sidebar breadcrumb breadcrumbs pagination pager adsense".split())
# So many times a lone article or main must the text outside weigh to make the body the root.
_OUTWEIGHS = 4
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_WALLS = frozenset("table td th ul ol dl button object html body article section div aside nav".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# What follows a tag's name, up to its end; a quote opens a value only after an equals sign.
_REST = re.compile(r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|=(?!\s*[\"'])|[^>=])*+>")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_FREE = frozenset(["html", "body", "main", "article"])  # never template as a whole
_RAW_ENDS = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in _RAW}


def _is_gone(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of the text by its tag or by what is written on it; ``inside`` an article or main."""
    if tag in _GONE or (tag == "header" and not inside):
        return True
    if not attributes or tag in _FREE:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in _GONE_ROLES:
            return True
    return False


def _is_named_gone(tag: str, attributes: str, inside: bool) -> bool:
    """Whether a whole class or id token says that an element is no part of the text."""
    if not attributes or tag in _FREE or (inside and tag in _HEADINGS):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id"):
            tokens = (m[2] or m[3] or m[4] or "").lower().split()
            if not (_GONE_IDS if inside and name == "id" else _GONE_NAMES).isdisjoint(tokens) or ("header" in tokens and not inside):
                return True
    return False


class _Open:
    """An open element: what has been collected when it began, and what its hash is made of."""

    __slots__ = ("tag", "gone", "blocks", "shown", "chars", "linked", "parts", "seen")

    def __init__(self, tag: str, gone: bool, blocks: int, shown: int, chars: int, linked: int):
        self.tag, self.gone, self.blocks, self.shown, self.chars, self.linked = tag, gone, blocks, shown, chars, linked
        self.parts: list[bytes] = []
        self.seen = False  # holds text


class Page:
    """One pass over a page: its blocks, each with the kind of root it stands in, and its subtree keys.

    ``site_chars`` and ``shown_chars`` are the characters that went with site templates and with what the page itself shows.
    """

    def __init__(self, source: str, template: frozenset[int] = frozenset()):
        self._begin(template, True)
        self._read(source)
        if self._hidden and not self.blocks:
            self._begin(template, False)
            self._read(source)

    def _begin(self, template: frozenset[int], names: bool) -> None:
        self.blocks: list[tuple[str, bool, int]] = []  # text, whether in main, number of the outermost article or 0
        self.keys: set[int] = set()
        self._cuts: list[tuple[int, int, bool]] = []  # block ranges of templates, whether inside an article or main
        self._template = template
        self.site_chars = self.shown_chars = 0
        self._chars = self._linked = 0  # characters of words so far, and those in links
        self._open = [_Open("", False, 0, 0, 0, 0)]
        self._places: dict[str, list[int]] = {}  # where in the open elements each tag stands
        self._text: list[str] = []
        self._gone = self._articles = self._mains = self._article = 0
        self._names = names  # elements outside articles and main may go by name
        self._hidden = False  # an article or main stands in an element that is gone

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        last = source.rfind(">")
        loose = False  # tags end at their first ">"
        while at < n:
            start = source.find("<", at)
            if start < 0 or (start > last and not source.startswith("<!--", start)):
                # no tag ends after here; a comment may still begin
                start = source.find("<!--", at)
                self._add(source[at:] if start < 0 else source[at:start])
                break
            if start > at:
                self._add(source[at:start])
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            if source[start + 1 : start + 2] in ("!", "?"):
                at = source.find(">", start) + 1
                continue
            m = _TAG.match(source, start)
            if not m:
                self._add("<")
                at = start + 1
                continue
            if loose:
                at = source.index(">", m.end()) + 1
            elif rest := _REST.match(source, m.end()):
                at = rest.end()
            else:
                loose = True
                self._add("<")
                at = start + 1
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in _RAW:
                close = _RAW_ENDS[tag].search(source, at)
                at = n if close is None else (source.find(">", close.start()) + 1 or n)
            else:
                self._start(tag, source[m.end() : at - 1])
        self._flush()
        while len(self._open) > 1:
            self._pop()

    def _add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        top = self._open[-1]
        if not self._gone:
            self._text.append(text)
        if words := " ".join(text.split()):
            top.seen = True
            top.parts.append(words.encode("utf-8", "surrogatepass"))
            self._chars += len(words)
            if self._places.get("a"):
                self._linked += len(words)
            if self._gone:
                self.shown_chars += len(words)

    def _flush(self) -> None:
        if self._text:
            words = "".join(self._text).split()
            self._text = []
            if words:
                self.blocks.append((" ".join(words), self._mains > 0, self._article if self._articles else 0))

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        block = tag in _BLOCK
        if block:
            self._flush()
            if self._places.get("p") and tag not in ("html", "body"):
                self._close_to(frozenset(["p"]), _WALLS)
        if tag in _CLOSES:
            self._close_to(_CLOSES[tag], frozenset(["table", "ul", "ol", "dl", "select"]))
        if tag in _VOID:
            return
        inside = self._articles + self._mains > 0
        gone = _is_gone(tag, attributes, inside) or ((inside or self._names) and _is_named_gone(tag, attributes, inside))
        self._hidden |= self._gone > 0 and tag in ("article", "main")
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append(_Open(tag, gone, len(self.blocks), self.shown_chars, self._chars, self._linked))
        self._gone += gone
        self._article += tag == "article" and not self._articles
        self._articles += tag == "article"
        self._mains += tag == "main"

    def _close_to(self, tags: frozenset[str], walls: frozenset[str]) -> None:
        """Close up to and with the outermost open element of ``tags`` above the next wall."""
        wall = max((at[-1] for t in walls - tags if (at := self._places.get(t))), default=0)
        found = [at[k] for t in tags if (at := self._places.get(t)) and (k := bisect_right(at, wall)) < len(at)]
        if found:
            self._flush()
            self._cut_back(min(found))

    def _cut_back(self, size: int) -> None:
        while len(self._open) > size:
            self._pop()

    def _end(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        if places := self._places.get(tag):
            self._cut_back(places[-1])

    def _pop(self) -> None:
        if self._open[-1].tag in _BLOCK:
            self._flush()
        top = self._open.pop()
        self._places[top.tag].pop()
        self._gone -= top.gone
        self._articles -= top.tag == "article"
        self._mains -= top.tag == "main"
        parent = self._open[-1]
        digest = blake2b(top.tag.encode() + b"\0" + b"\1".join(top.parts), digest_size=8).digest()
        parent.parts.append(digest)
        parent.seen |= top.seen
        inside = self._articles + self._mains > 0
        links = 2 * (self._linked - top.linked) >= self._chars - top.chars
        if top.seen and top.tag in _BLOCK and top.tag not in _FREE and (links or not inside):
            key = int.from_bytes(digest, "little", signed=True)
            self.keys.add(key)
            if key in self._template:
                self.site_chars += self.shown_chars - top.shown
                self.shown_chars = top.shown
                if top.blocks < len(self.blocks):
                    self._cuts.append((top.blocks, len(self.blocks), inside))

    def _covered(self, cuts: list[tuple[int, int]]) -> list[bool]:
        """For every block whether one of the ranges holds it."""
        steps = [0] * (len(self.blocks) + 1)
        for lo, hi in cuts:
            steps[lo] += 1
            steps[hi] -= 1
        return [depth > 0 for depth in accumulate(steps[:-1])]

    def _cut(self) -> list[bool]:
        """For every block whether it goes with a site template."""
        articles: dict[int, int] = {}
        for text, _, article in self.blocks:
            if article:
                articles[article] = articles.get(article, 0) + len(text)
        longest = max(articles, key=articles.__getitem__, default=0)
        kept = [0, *accumulate(main or article > 0 and article == longest for _, main, article in self.blocks)]
        outer = self._covered([(lo, hi) for lo, hi, inside in self._cuts if not inside and kept[lo] == kept[hi]])
        inner = self._covered([(lo, hi) for lo, hi, inside in self._cuts if inside])
        sizes = [len(b[0]) for b in self.blocks]
        own = [size if main or article else 0 for size, (_, main, article) in zip(sizes, self.blocks, strict=True)]
        if 2 * sum(size for size, cut in zip(own, inner, strict=True) if cut) > sum(own):
            inner = [False] * len(inner)
        if not any(own) and 10 * sum(size for size, cut in zip(sizes, outer, strict=True) if not cut) < sum(sizes):
            outer = [False] * len(outer)
        return [a or b for a, b in zip(outer, inner, strict=True)]

    def text(self) -> str:
        kept = self.blocks
        if self._cuts:
            cut = self._cut()
            self.site_chars += sum(len(b[0]) for b, gone in zip(self.blocks, cut, strict=True) if gone)
            kept = [b for b, gone in zip(self.blocks, cut, strict=True) if not gone]
        articles: dict[int, int] = {}
        for text, _, article in kept:
            if article:
                articles[article] = articles.get(article, 0) + len(text)
        longest = max(articles, key=articles.__getitem__, default=0)
        own = sum(len(text) for text, main, article in kept if main and not article)
        outside = sum(len(text) for text, main, article in kept if not main and not article)
        root, size, several = [b for b in kept if b[2]], articles.get(longest, 0), len(articles) > 1
        if own > size:
            root = [b for b in kept if b[1]]
            size, several = sum(len(b[0]) for b in root), False
        if outside > size * (1 if several else _OUTWEIGHS):
            root = kept
        return "\n".join(b[0] for b in root)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, content) of every subtree, and of every page with a null key."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            hosts, keys, contents = [], [], []
            for host, source in zip(*(batch.column(i).slice(lo, 512).to_pylist() for i in range(2)), strict=True):
                page = Page(source)
                digest = blake2b(page.text().encode("utf-8", "surrogatepass"), digest_size=8).digest()
                found = [None, *page.keys]
                hosts += [host] * len(found)
                keys += found
                contents += [int.from_bytes(digest, "little", signed=True)] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(contents, pa.int64())], ["host", "key", "content"]
            )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            template = part.column(3).to_pylist()
            texts, site, shown = [], [], []
            for source, cut in zip(part.column(2).to_pylist(), template, strict=True):
                page = Page(source or "", frozenset(cut or ()))
                texts.append(page.text())
                site.append(page.site_chars)
                shown.append(page.shown_chars)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(c or ()) for c in template], pa.int32()), pa.array(site, pa.int64()), pa.array(shown, pa.int64())],
                ["id", "url", "text", "n_chars", "site_templates", "site_chars", "shown_chars"],
            )


def host_of(url: Column) -> Column:
    """Lower-case host of a url; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    return F.when(F.length(host) > 0, host)


def site_templates(
    pages: DataFrame, url_column: str, html_column: str, share: float = SHARE, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """(host, template): the keys of the recurring subtrees of each host that has any."""
    named = pages.select(host_of(F.col(url_column)).alias("host"), F.col(html_column).alias("html"))
    named = named.where("host IS NOT NULL AND length(html) > 0")
    found = named.mapInArrow(_keys, "host string, key long, content long").distinct()
    counted = found.groupBy("host", "key").count().where((F.col("count") >= least_pages) | F.col("key").isNull())
    counted = materialize(counted, "subtrees")
    sizes = counted.where("key IS NULL").select("host", F.col("count").alias("pages"))
    often = counted.where("key IS NOT NULL").join(sizes, "host").where(F.col("count") >= share * F.col("pages"))
    return materialize(often.groupBy("host").agg(F.collect_list("key").alias("template")), "templates")


def main_text(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    share: float = SHARE,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """(id, url, text, n_chars, site_templates, site_chars, shown_chars) of every row; the last are the characters each step took."""
    templates = site_templates(pages, url_column, html_column, share, least_pages)
    taken = pages.select(
        F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"),
        host_of(F.col(url_column)).alias("host"),
    )
    joined = taken.join(templates, "host", "left").select("id", "url", "html", "template")
    kind = joined.schema["id"].dataType.simpleString()
    schema = f"id {kind}, url string, text string, n_chars long, site_templates int, site_chars long, shown_chars long"
    out = joined.mapInArrow(_extracted, schema)
    return out.withColumnRenamed("id", id_column).withColumnRenamed("url", url_column)
