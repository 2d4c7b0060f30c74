"""Main-text extraction from HTML with site template removal.

Every element subtree of a page is hashed from the hashes of what it holds, twice:
exactly (tag, class, id, texts) and by shape (tag, class, id, role, the shapes of
its parts, no text, repeated parts once). Spark counts both per host over differing
pages, and a second pass deletes subtrees that recur on ``min_pages`` or more: by
exact hash any, by shape those that hold at most half of the page's text, no
article, and either are links for the most part or are marked as something else
than the article (by tag, role, class or id). So a menu, a footer line or an
advert goes that looks alike on a site's pages though it never says the same.

Host counts decide first. At a host with ``min_pages`` differing pages the text is
what does not recur, wherever it lies. Unless ``marks`` is false, two rules then
clear up what is not on enough pages: elements whose tag or role is something else
than the article (``nav``, ``footer``, ``aside``, ...) go, and so does on a page with an
article what lies outside of it and is marked by class or id. Only at hosts with
fewer pages do tags, classes and ids decide alone: a page with ``article`` elements
gives their text, else its ``main`` element's, else what is left of its body; whole
words in classes or ids take elements away, but not an article, and where no other
article has text not what holds one or most of the page's text; inside an article
weak words do not take away paragraphs, nor containers with more text than ``PROSE``
letters that is not links.

Pages count as differing by their whole text, so copies of one page do not turn
its article into a template; and paragraphs, headings, list items and the like
inside an article are never templates, only containers there are, by exact hash
or, if marked, by shape. Counts are (host, subtree) aggregates with map-side
combine, so a host with a third of all pages is no single task. Reading is
linear in the page's length.

Blocks: character references decoded, white space collapsed to one space,
trimmed, empty ones left out, joined by one line end in page order. A small
``article`` of links beside more other text is a card and gives none.

Defined cases: null and empty html give an empty text; unclosed elements end
with their parent, unmatched end tags are ignored; a tag that never ends is text
up to the end of the page; end tags and implied ends look at most ``DEEP`` elements
up; a null or odd url has its own empty host; repeated rows are extracted each;
only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, rows_to_batches, sized, slices

DEEP = 512
PROSE = 100  # letters from which a weakly named container inside an article reads like the article
# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
NO_TEXT = frozenset("script style noscript iframe template textarea title head button select svg canvas object audio video".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CONTAINERS = frozenset("div section ul ol dl table figure details fieldset center".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Names of what is no article; the second line's may also name a part of one.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies cookie cookies consent gdpr popup modal newsletter pagination pager login signup toolbar masthead topbar copyright".split()
)
PROMO = frozenset("sponsor sponsored promo promotion".split())
WEAK = PROMO | frozenset("notice notices subscribe subscription share sharing social related widget widgets search toc skip".split())
SIMPLE = re.compile(r"""<(/?)([A-Za-z][^\s/>"'<]*+)((?:[^<>"']++|"[^"<>]*+")*+)>""")  # reads no further than to the next tag
NAME = re.compile(r"[^\s/>]*")
ENDS = re.compile(r"""[>"']""")
ATTR = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"']+)""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
DIGITS = re.compile(r"[0-9]+")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(raw)} if raw.strip(" /") else {}


def _hidden(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NO_TEXT:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(HIDDEN.search(attrs.get("style", "")))


def _aside(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether tag or role says that this is not the article."""
    return tag in ASIDE or tag == "header" and not in_article or tag not in ("html", "body", "main") and attrs.get("role", "").lower() in ROLES


def _named(tag: str, attrs: dict[str, str], in_article: bool) -> str:
    """``strong``, ``weak`` or ``promo`` (a weak one) if class or id have a word for something else than the article; an article inside another one may."""
    if not attrs or tag in ("html", "body", "main") or tag == "article" and not in_article:
        return ""
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    if not WORDS.isdisjoint(names) or not in_article and "header" in names:
        return "strong"
    return "" if WEAK.isdisjoint(names) else "weak" if PROMO.isdisjoint(names) else "promo"


class _Open:
    """An open element: what it is, where its text begins, and the hashes of what it holds."""

    __slots__ = ("tag", "dropped", "region", "first", "name", "number", "named", "marked", "aside", "parts", "shapes", "letters", "links", "plain", "article", "inner")

    def __init__(self, tag, dropped, region, first, name, number, named, marked, aside, letters, links, plain, article):
        self.tag, self.dropped, self.region, self.first, self.name, self.number, self.named = tag, dropped, region, first, name, number, named
        self.marked, self.aside = marked, aside  # it or what holds it is marked as no article; it is by its own tag or role
        self.letters, self.links, self.plain, self.article = letters, links, plain, article
        self.parts: list[int] = []
        self.shapes: list[int] = []
        self.inner = 0


class Page:
    """The text blocks of one page.

    ``counted``: host counts decide, that is ``gone``, the subtrees to delete, hashed
    with their host; ``letters`` is the page's size as an earlier reading found it.
    Otherwise names decide. ``marks``: tags and roles decide, too, where counts do not.
    """

    def __init__(self, html: str, gone: frozenset[int] = frozenset(), letters: int = 0, site: str = "", counted: bool = False, marks: bool = True) -> None:
        self.gone, self.size, self.site, self.counted, self.marks = gone, letters, site, counted, marks
        self.kept: set[int] = set()  # numbers of named elements that give text all the same
        self._start()
        self._read(html)
        if not counted and (kept := self._wrongly_named()):
            self.kept = kept
            self._start()
            self._read(html)

    def _start(self) -> None:
        self.blocks: list[tuple[int, str, bool]] = []  # 2: in an article, 1: in main, 0: elsewhere; the text; whether it is marked
        self.cards: list[tuple[int, int, int]] = []  # articles of links: their blocks and letters
        self.exact: set[int] = set()
        self.alike: list[tuple[int, int]] = []  # shapes and letters
        self.held: list[str] = []
        self.stack: list[_Open] = []
        self.open: dict[str, int] = {}  # how many elements of each name are open
        self.opened = 0
        # named elements closed: number, letters but for those dropped by tag or role, letters in articles, whether it reads like the article
        self.weak: list[tuple[int, int, int, bool]] = []
        self.strong: list[tuple[int, int, int, bool]] = []
        self.letters = self.links = self.plain = self.in_article = self.of_articles = self.templates = 0

    def _wrongly_named(self) -> set[int]:
        """Named elements that hold an article or most of the text, without other article text; weakly named ones that hold most of an article."""
        if not self.in_article:
            return {i for i, n, a, _ in self.weak + self.strong if a or 2 * n > self.plain}
        return {i for i, _, a, prose in self.weak if 2 * a > self.of_articles or a and prose}

    def _flush(self) -> None:
        if self.held:
            text = " ".join(unescape("".join(self.held)).split())
            self.held.clear()
            if text:
                self.blocks.append((self.stack[-1].region, text, self.stack[-1].marked) if self.stack else (0, text, False))
                if self.stack:
                    self.stack[-1].parts.append(_hash(text))

    def _close(self, upto: int) -> None:
        while len(self.stack) > upto:
            e = self.stack[-1]
            block = e.tag in BLOCK
            if block:
                self._flush()
            self.stack.pop()
            self.open[e.tag] -= 1
            up = self.stack[-1] if self.stack else None
            if not block and not e.parts and not e.named and (e.tag != "a" or e.region == 2):
                if up:
                    up.inner += e.inner
                else:
                    self.templates += e.inner
                continue
            letters, inside = self.letters - e.letters, self.of_articles - e.article
            linked = 2 * (self.links - e.links) > letters
            if e.named:
                prose = e.named == "weak" and not linked and (e.tag not in CONTAINERS or letters > PROSE)
                (self.strong if e.named == "strong" else self.weak).append((e.number, self.plain - e.plain, inside, prose))
            if e.tag == "article" and letters and linked:
                self.cards.append((e.first, len(self.blocks), letters))
            exact = _hash(f"{e.tag}\0{e.name}\0{e.parts}") if e.parts else 0
            shape = 0
            if e.region < 2 or e.marked:  # of other parts of articles shapes do not matter
                once = [s for i, s in enumerate(e.shapes) if not i or s != e.shapes[i - 1]]
                shape = _hash(f"{e.tag}\1{e.name}\1{once}")
            if block and e.tag not in ("html", "body", "main", "article") and letters and not e.dropped:
                container = e.region < 2 or e.tag in CONTAINERS
                if container:
                    self.exact.add(exact)
                if e.region < 2:
                    alike = not inside and (bool(e.marked) or linked and e.region == 0)
                else:
                    alike = e.aside or bool(e.named) and e.tag in CONTAINERS and (e.named == "strong" or linked)
                if alike:
                    self.alike.append((shape, letters))
                if self.gone and (container and self._goes(exact) or alike and 2 * letters <= self.size and self._goes(shape)):
                    self._delete(e.first)
                    e.inner = 1
                elif self.counted and self.marks and e.aside:
                    self._delete(e.first)
            if up:
                up.inner += e.inner
                if e.parts:
                    up.parts.append(exact)
                if shape and (block or e.tag == "a"):
                    up.shapes.append(shape)
            else:
                self.templates += e.inner

    def _delete(self, first: int) -> None:
        del self.blocks[first:]
        self.cards = [c for c in self.cards if c[0] < first]

    def _goes(self, subtree: int) -> bool:
        return _hash(f"{self.site}\0{subtree}") in self.gone

    def _text(self, text: str) -> None:
        if not text:
            return
        e = self.stack[-1] if self.stack else None
        if not e or not e.dropped:
            self.held.append(text)
        n = len("".join(text.split()))
        if not n or e and e.dropped == 3:
            return
        self.letters += n
        self.plain += n * (not e or e.dropped < 2)
        if self.open.get("a"):
            self.links += n
        if e:
            if e.dropped:
                e.parts.append(_hash(" ".join(text.split())))
            if e.region == 2 and e.dropped < 2:
                self.of_articles += n
                self.in_article += n * (not e.dropped)

    def _tag_end(self, html: str, at: int, last: dict[str, int]) -> int:
        """The place of the ``>`` that ends a tag, outside quoted values, or -1; a quote that is never closed is a character."""
        while m := ENDS.search(html, at):
            sign = m[0]
            if sign == ">":
                return m.start()
            at = html.index(sign, m.end()) + 1 if last[sign] >= m.end() else m.end()
        return -1

    def _read(self, html: str) -> None:
        at, seen, last = 0, 0, {q: html.rfind(q) for q in "\"'>"}
        while (lt := html.find("<", seen)) >= 0:
            nxt = html[lt + 1 : lt + 3]
            if nxt[:1] in ("!", "?"):
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 4)
                    stop = len(html) if end < 0 else end + 3
                else:
                    end = html.find(">", lt)
                    stop = len(html) if end < 0 else end + 1
                self._text(html[at:lt])
                at = seen = stop
                continue
            if simple := SIMPLE.match(html, lt):
                closing, tag, raw, stop = bool(simple[1]), simple[2].lower(), simple[3], simple.end()
            else:
                closing = nxt[:1] == "/"
                first = nxt[1:] if closing else nxt[:1]
                if not (first.isascii() and first.isalpha()):
                    seen = lt + 1
                    continue
                name = NAME.match(html, lt + 1 + closing)
                end = self._tag_end(html, name.end(), last) if last[">"] >= name.end() else -1
                if end < 0:  # no further tag ends
                    break
                tag, raw, stop = name[0].lower(), html[name.end() : end], end + 1
            self._text(html[at:lt])
            at = seen = stop
            if closing:
                if self.open.get(tag):
                    for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 1 - DEEP), -1):
                        if self.stack[i].tag == tag:
                            self._close(i)
                            break
            elif tag == "br":
                self._text(" ")
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
            elif tag in RAW:
                found = RAW_END[tag].search(html, at)
                at = seen = found.end() if found else len(html)
            else:
                self._open(tag, raw)
        self._text(html[at:])
        self._close(0)
        self._flush()

    def _open(self, tag: str, raw: str) -> None:
        if tag in BLOCK:
            self._imply(tag)
            self._flush()
        up = self.stack[-1] if self.stack else None
        inside, held = (up.region, up.dropped) if up else (0, 0)
        attrs = _attributes(raw)
        region = 2 if tag == "article" else max(inside, 1) if tag == "main" or attrs.get("role") == "main" else inside
        if raw.endswith("/") and tag not in BLOCK:
            return
        self.opened += 1
        # 1: by name, 2: hidden, or by tag or role, 3: no text at all
        dropped, named, aside = held, "", False
        if held < 3:
            if tag in ("head", "template"):
                dropped = 3
            elif held == 2 or _hidden(tag, attrs):
                dropped = 2
            elif (aside := _aside(tag, attrs, inside == 2)) and not self.counted:
                dropped = 2
            elif (named := _named(tag, attrs, inside == 2)) and (tag not in BLOCK and named == "strong" if self.counted else self.opened not in self.kept):
                dropped = max(held, 1)
        marked = aside or bool(named) or bool(up and up.marked)
        name = DIGITS.sub("0", f"{attrs.get('class', '')}#{attrs.get('id', '')}#{attrs.get('role', '')}") if attrs else "##"
        self.stack.append(_Open(tag, dropped, region, len(self.blocks), name, self.opened, named, marked, aside, self.letters, self.links, self.plain, self.of_articles))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _imply(self, tag: str) -> None:
        """End tags that the standard lets a page leave out."""
        ends = ("p",) if tag in CLOSES_P else ()
        ends += {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
        if not any(self.open.get(x) for x in ends):
            return
        for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 1 - DEEP), -1):
            name = self.stack[i].tag
            if name in ends:
                self._close(i)
            elif name in BLOCK and name not in ends and name not in ("p", "li", "td", "th", "dt", "dd", "tr"):
                return

    def subtrees(self) -> set[int]:
        """Hashes of the subtrees that a template might be."""
        return self.exact | {s for s, n in self.alike if 2 * n <= self.letters}

    def text(self) -> str:
        blocks = self.blocks
        if self.cards:
            card = {i for a, b, _ in self.cards for i in range(a, min(b, len(blocks)))}
            other = [x for i, x in enumerate(blocks) if i not in card]
            if 2 * sum(n for _, _, n in self.cards) < sum(len(t) for _, t, _ in other):
                blocks = other
        best = max((r for r, _, _ in blocks), default=0)
        if not self.counted:
            blocks = [x for x in blocks if x[0] == best]
        elif self.marks and best == 2:
            blocks = [x for x in blocks if x[0] == 2 or not x[2]]
        return "\n".join(t for _, t, _ in blocks)


def host(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """``(page_id, row, host, letters, context, subtrees)``: each page's size, text digest and subtrees that a template might be, hashed with its host."""
    schema = pa.schema([("page_id", pa.int64()), ("row", pa.int64()), ("host", pa.string()), ("letters", pa.int64()), ("context", pa.int64()), ("subtrees", pa.list_(pa.int64()))])

    def run(batches):
        def rows():
            for b in (part for whole in batches for part in slices(whole, 200)):
                for page_id, row, site, html in zip(*(c.to_pylist() for c in b.columns)):
                    page = Page(html, counted=True)
                    yield page_id, row, site, page.letters, _hash(Page(html).text()), [_hash(f"{site}\0{h}") for h in sorted(page.subtrees())]

        return rows_to_batches(rows(), schema)

    return _keyed(pages).select("page_id", "row", "host", "html").mapInArrow(run, "page_id long, row long, host string, letters long, context long, subtrees array<long>")


def _keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.coalesce("page_id", F.lit(-(2**63))).alias("_id"), "page_id", "url", html.alias("html"), host().alias("host"), F.xxhash64(html).alias("row"))


def extract(pages: DataFrame, min_pages: int = 5, marks: bool = True) -> DataFrame:
    """``(page_id, url, text, n_chars, n_templates)`` of each page; ``n_templates`` subtrees were deleted as templates."""
    found = checkpointed(page_subtrees(pages))
    spread = found.select(F.coalesce("page_id", F.lit(-(2**63))).alias("_id"), "row", "letters", "context", F.explode("subtrees").alias("subtree"))
    often = spread.select("subtree", "context").distinct().groupBy("subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("subtree")
    often = checkpointed(often)
    gone = spread.join(sized(often, often.count()), "subtree").groupBy("_id", "row").agg(F.collect_set("subtree").alias("gone"), F.max("letters").alias("letters"))
    hosts = checkpointed(found.select("host", "context").distinct().groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", F.lit(True).alias("counted")))
    both = _keyed(pages).join(gone, ["_id", "row"], "left").join(sized(hosts, hosts.count()), "host", "left").select("page_id", "url", "html", "host", "gone", "letters", "counted")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_templates", pa.int64())])

    def run(batches):
        def rows():
            for b in (part for whole in batches for part in slices(whole, 200)):
                for page_id, url, html, site, drop, letters, counted in zip(*(c.to_pylist() for c in b.columns)):
                    page = Page(html, frozenset(drop or ()), letters or 0, site, bool(counted), marks)
                    text = page.text()
                    yield page_id, url, text, len(text), page.templates

        return rows_to_batches(rows(), schema, 1_000)

    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_templates long")
