"""Main-text extraction by consensus host paths.

Pass 1 scans each page, scores its containers (text of the blocks they hold, weighed by how little of it
is links, half of it passed on to the next container out) and votes for the best by its path: tags and
classes from the body, digits taken out, so that one template gives one path on all its pages. Spark
counts the votes by host. Pass 2 scans each page again and takes the containers on the path its host
voted for, or the page's own best container where the page has none on that path.

Inside a container everything counts but what tag, role, class or id mark as menu, header, footer,
sidebar, notice, advert, form, script, style or reader comment. A class or id names its element by its last word: ``site-footer`` is
a footer, ``header-image`` an image. Where such a word only stands before another one, the element is in doubt, and it goes if it is mostly links,
if it has no running text (``RUNNING`` words in a block), or if its host votes it down: hosts vote on elements in doubt too, and
one whose text, at its path, is that of over half of the host's different pages is template. Three short links or more that are a whole block by themselves are a menu without
a name. Blocks are decoded, their white space becomes one space, and they are joined in page order.

Defined results: null or empty html gives an empty text; html without tags is one block; elements left
open end with their parent or the page; a null URL is the host ''. A quote in a tag that never closes ends with the tag,
at the next '>'; a tag that never ends takes the rest of the page. Repeated rows give repeated results. The scan is
linear in the page, whatever its markup: every search goes on where the last one ended.
Host votes are joined by the host; how (broadcast or shuffle) follows from the size of the voted table.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha1
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store
from .tokens import small_batches

#: Element names of HTML by what they mean for text.
RAW = frozenset("script style title textarea noscript template iframe svg object canvas audio video select".split())
#: Those of them that markup may be in: without a closing tag they take nothing.
FALLBACK = frozenset("svg object canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body div main article section center table tbody td blockquote details".split())
BLOCKS = CONTAINERS | frozenset("html head p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre tr th thead tfoot caption figure figcaption address hgroup header footer nav aside form fieldset hr summary menu dialog legend button label option".split())
DROPPED = frozenset("head nav footer aside form fieldset button dialog menu header".split())
CLOSES_P = BLOCKS - {"label", "button", "option"}
#: Class and id words, and roles, of what isn't the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer form gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related share sharing "
    "sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words that name an element wherever they stand in its class.
CERTAIN = frozenset("ad ads adv advert adverts advertisement advertisements advertising breadcrumb breadcrumbs gdpr navbar pagination sidebar".split())
NOT_MARKED = frozenset("with has no without is".split())

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: What ends a tag, or opens an attribute's quoted value.
STOP = re.compile(r">|=\s*([\"'])")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
#: Words of a block of running text; characters of a menu's links, in the mean.
RUNNING, SHORT_LINK = 10, 30
KEPT, DOUBT, GONE = 0, 1, 2
#: Paths longer than this go on from their hash, so nesting costs no more than its depth.
LONG_PATH = 2000
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


def decode(text: str) -> str:
    """Character references of HTML5; numbers of any length."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub("&#", text))
    return unescape(text)


def tags(html: str):
    """(start, end, name, attributes) of all tags, comments and declarations in order; the name of the last two is ''.

    An end tag's name begins with '/'. ``send`` a place to go on from there.
    """
    at = 0
    while (start := html.find("<", at)) >= 0:
        m = NAME.match(html, start + 1)
        if m:
            end = m.end()
            while stop := STOP.search(html, end):
                end = stop.end()
                if not stop[1]:
                    break
                close = html.find(stop[1], end)
                if close < 0:  # it never closes: the tag ends at the next '>'
                    stop = end = html.find(">", end) + 1
                    break
                end = close + 1
            end = end if stop else len(html)
            found = (start, end, m[0].lower(), html[m.end() : end - 1])
        elif html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            found = (start, end + 3 if end >= 0 else len(html), "", "")
        elif html[start + 1 : start + 2] in ("!", "?", "/"):
            end = html.find(">", start)
            found = (start, end + 1 if end >= 0 else len(html), "", "")
        else:
            at = start + 1
            continue
        at = (yield found) or found[1]


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(raw):
        out.setdefault(name.lower(), decode(a or b or c))
    return out


def _mark(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """Whether an element stays, is in doubt or goes, by its tag and attributes."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return GONE
    if not attrs or tag in ("html", "body"):
        return KEPT
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return GONE
    found = KEPT
    for name in attrs.get("class", "").split() + attrs.get("id", "").split():
        words = [w.lower() for w in WORDS.findall(name)]
        if NOT_MARKED.intersection(words[:-1]):
            continue
        if COMMENTS.intersection(words):
            return GONE
        if tag in ("main", "article") or (in_article and words[-1:] == ["header"]):
            continue
        if CERTAIN.intersection(words) or BOILERPLATE.intersection(words[-1:]):
            return GONE
        if BOILERPLATE.intersection(words):
            found = DOUBT
    return found


class Page:
    """Containers and blocks of a page in one scan.

    containers: [path, parent, score]; blocks: (container, text, element in doubt or -1).
    doubts: elements in doubt as [path, the one around it, characters, of links, words of the longest block, texts].
    """

    def __init__(self, html: str):
        self.containers: list[list] = [["", -1, 0.0]]
        self.blocks: list[tuple[int, str, int]] = []
        self.doubts: list[list] = []
        self._text: list[str] = []
        self._length = self._linked = self._anchors = 0
        self._doubt = -1
        # open elements that matter: (tag, container before, is container, dropped, doubt before)
        self._open: list[tuple[str, int, bool, bool, int]] = []
        self._count: Counter = Counter()  # of open elements by tag
        self._at, self._dropped, self._articles, self._links = 0, 0, 0, 0
        place = 0
        unclosed: set[str] = set()
        scan = tags(html)
        found = next(scan, None)
        while found:
            start, end, tag, raw = found
            self._chars(html[place:start])
            place = end
            if tag[:1] == "/":
                self._end(tag[1:])
            elif tag in RAW:
                if not (tag in FALLBACK and (SELF_CLOSED.search(raw) or tag in unclosed)):
                    close = re.compile(rf"</{tag}(?=[\\s/>])", re.I).search(html, end)
                    if not close and tag in FALLBACK:
                        unclosed.add(tag)
                    else:
                        place = html.find(">", close.end()) + 1 if close else 0
                        place = place or len(html)
                self._text.append(" ")
            elif tag:
                self._start(tag, raw)
            try:
                found = scan.send(place)
            except StopIteration:
                found = None
        self._chars(html[place:])
        self._flush()

    def _chars(self, text: str) -> None:
        if text and not self._dropped:
            self._text.append(text)
            self._length += len(text)
            if self._links:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(decode("".join(self._text)).split())
            if text and not self._is_menu(text):
                self.blocks.append((self._at, text, self._doubt))
                d = self._doubt
                while d >= 0:
                    own = self.doubts[d]
                    own[2:5] = own[2] + self._length, own[3] + self._linked, max(own[4], text.count(" ") + 1)
                    own[5].append(text)
                    d = own[1]
                score = len(text) * max(0.0, 1 - 1.5 * self._linked / max(1, self._length))
                at, share = self._at, score
                while at >= 0 and share >= 1:
                    self.containers[at][2] += share
                    at, share = self.containers[at][1], share / 2
            self._text, self._length, self._linked = [], 0, 0
        self._anchors = 0

    def _is_menu(self, text: str) -> bool:
        """Whether the block is nothing but links, three or more and short ones, outside paragraphs."""
        return self._anchors > 2 and self._linked >= 0.9 * len(text.replace(" ", "")) and self._linked <= SHORT_LINK * self._anchors and not (self._open and self._open[-1][0] == "p")

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self._text.append(" ")
            return
        if tag == "a":
            self._links += 1
            self._anchors += not self._dropped
            return
        if tag in BLOCKS:
            self._flush()
            if self._open and self._open[-1][0] == "p" and tag in CLOSES_P:
                self._pop()
            if self._open and tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self._open[-1][0] == tag:
                self._pop()
            self._links = 0
        elif not raw or tag in VOID:
            return
        attrs = _attributes(raw) if raw and not raw.isspace() else {}
        mark = _mark(tag, attrs, self._articles > 0)
        dropped, doubt = mark == GONE, mark == DOUBT and tag in BLOCKS and not self._dropped
        container = tag in CONTAINERS and not dropped and not self._dropped
        if tag in VOID or not (container or dropped or doubt or tag == "p" or tag in DROPPED or (self._dropped and tag in CONTAINERS)):
            return
        self._open.append((tag, self._at, container, dropped, self._doubt))
        self._count[tag] += 1
        self._dropped += dropped
        if container or doubt:
            names = ".".join(sorted({re.sub(r"\d+", "", c) for c in attrs.get("class", "").split()} - {""}))
            above = self.containers[self._at][0]
            above = above if len(above) <= LONG_PATH else "#" + sha1(above.encode("utf-8", "surrogatepass")).hexdigest()
            path = f"{above}>{tag}{'.' + names if names else ''}"
        if container:
            self._articles += tag in ("article", "main")
            self.containers.append([path, self._at, 0.0])
            self._at = len(self.containers) - 1
        if doubt:
            self.doubts.append([path, self._doubt, 0, 0, 0, []])
            self._doubt = len(self.doubts) - 1

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self._links = 0
        elif tag == "a":
            self._links = max(0, self._links - 1)
        if not self._count[tag]:
            return
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                while len(self._open) > i:
                    self._pop()
                return
            if tag == "p" and self._open[i][0] in BLOCKS:
                return

    def _pop(self) -> None:
        self._flush()
        tag, before, container, dropped, self._doubt = self._open.pop()
        self._count[tag] -= 1
        self._dropped -= dropped
        if container:
            self._articles -= tag in ("article", "main")
            self._at = before

    def best(self) -> str:
        """The path of the best container, or of the article or main element around it."""
        k = max(range(len(self.containers)), key=lambda i: (self.containers[i][2], -i))
        at = k
        while at > 0:
            if re.search(r">(article|main)(\.[^>]*)?$", self.containers[at][0]):
                return self.containers[at][0]
            at = self.containers[at][1]
        return self.containers[k][0]

    def votes(self) -> list[tuple[str, str]]:
        """(path, text's hash) of each element in doubt that has running text: the others need no vote."""
        return sorted({(d[0], sha1("\n".join(d[5]).encode("utf-8", "surrogatepass")).hexdigest()) for d in self.doubts if d[4] >= RUNNING})

    def text(self, path: str, templates: frozenset[str] = frozenset()) -> str | None:
        """Blocks inside containers on ``path``; None if there is none. templates: paths of elements in doubt that their host votes down."""
        inside = [c[0] == path for c in self.containers]
        if not any(inside):
            return None
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.containers[i][1]]
        gone = [False]  # of no doubt, at the end
        for own, around, length, linked, longest, _ in self.doubts:
            gone.insert(-1, gone[around] or longest < RUNNING or 2 * linked > length or own in templates)
        return " ".join(t for at, t, doubt in self.blocks if inside[at] and not gone[doubt])


def _votes(batches):
    """(host, path, hash, page, votes): a page with text has one vote, without a hash, for its best container's path, and one for each element in doubt."""
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    for batch in (b for big in batches for b in small_batches(big, "html")):
        rows = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(html)
            if page.blocks:
                rows.append((host, page.best(), None, 0, 1))
                own = int.from_bytes(sha1(html.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)
                rows += [(host, path, h, own, 1) for path, h in [*page.votes(), ("", "")]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], ["host", "path", "hash", "page", "votes"])


def _extract(batches):
    import pyarrow as pa

    for batch in (b for big in batches for b in small_batches(big, "html")):
        texts = []
        for html, path, templates in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
            page = Page(html)
            down = frozenset(templates or ())
            text = page.text(path, down) if path is not None else None
            texts.append(text or page.text(page.best(), down) or "")  # a path without text here: the page's own best
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)], ["page_id", "url", "text", "n_chars", "path"])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


#: Different pages of a host from which its votes on elements in doubt count.
LEAST_PAGES = 3


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, templates): the path with most votes of each host, ties to the first; paths of elements in doubt that are template.

    A template's text stands on over half of the host's different pages (copies of a page count once), so a host has
    no more of them than two pages have elements.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    schema = "host string, path string, hash string, page long, votes long"
    # one row a page for most pages: written down, as both counts read it
    cast = store(rows.mapInArrow(_votes, schema).groupBy("host", "path", "hash", "page").agg(F.sum("votes").alias("votes")), "host-votes", 8)
    votes = cast.where("hash is null").select("host", "path", "votes")
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    won = votes.withColumn("n", first).where("n = 1").select("host", "path")
    doubts = cast.where("hash is not null").groupBy("host", "path", "hash").agg(F.count(F.lit(1)).alias("k"))
    all_pages = doubts.where("hash = ''").select("host", F.col("k").alias("pages"))
    down = doubts.where("hash <> ''").join(all_pages, "host").where((F.col("pages") >= LEAST_PAGES) & (2 * F.col("k") > F.col("pages")))
    return won.join(down.groupBy("host").agg(F.collect_set("path").alias("templates")), "host", "left")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, path) for every row; path: what its host voted for."""
    won = store(host_paths(pages, url_col, html_col), "host-paths", 64)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(won, "host", "left").select("page_id", "url", "html", "path", "templates")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, path string")
