"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their blocks outside links and boilerplate; the best one's path of
generalised tags and classes is a vote of its host, after a climb to the ancestor that holds what its siblings add.
Spark counts the votes per host, and every page is extracted again from the containers on its host's winning path with
the same climb, or from its own best container where that path has less than half of that one's text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, read_table, staged

#: Winning paths are broadcast up to so many hosts; beyond, only those of hot hosts are and the rest is joined.
BROADCAST_HOSTS = 20_000
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+|[^>]*)>""", re.S)
#: Their text holds no tags and is dropped. It goes on to the end tag, or to the end of the page.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Dropped with what they hold; one that closes itself, or that no end tag follows, holds nothing.
EMBEDDED = frozenset("svg object select iframe noscript template annotation annotation-xml".split())
END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW | EMBEDDED}
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body article main section div td center dd figure".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt th tr table thead tbody tfoot blockquote pre figcaption header footer nav aside form address hr details summary fieldset head hgroup menu dialog caption option".split())
DROPPED = frozenset("nav header footer aside form head menu dialog button label fieldset option".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead notice notices cookie cookies consent gdpr popup modal overlay subscribe subscription newsletter signup login form search share sharing social comment comments disqus reply replies respond discussion related recommended recommendations widget pager pagination toolbar skip copyright legal alert".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A start tag ends open elements of the second kind, up to the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
IN_P = BLOCKS - frozenset("option head caption".split())
NAME = re.compile(r"[a-z]+")
#: What a class or id says after such a word is of the page's layout, not of the element.
MODIFIED = re.compile(r"(?<![a-z])(?:has|with|without|no)[-_]\S*")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters outside links from which a block that isn't a heading makes the container of its siblings grow.
CONTENT = 25


class Element:
    """dropped: for its tag, role or state; named: its nearest element, itself included, with a name of boilerplate."""

    __slots__ = ("tag", "path", "dropped", "link", "parent", "score", "number", "named", "plain", "holds", "kept")

    def __init__(self, tag: str, path: str, dropped: bool, link: bool, parent: Element | None, number: int, named: bool = False) -> None:
        self.tag, self.path, self.dropped, self.link, self.parent, self.score, self.number = tag, path, dropped, link, parent, 0.0, number
        self.named = self if named else parent.named if parent else None
        self.plain, self.holds, self.kept = 0, False, False


class Block:
    __slots__ = ("home", "text", "plain", "heading")

    def __init__(self, home: Element, text: str, plain: int, heading: str) -> None:
        self.home, self.text, self.plain, self.heading = home, text, plain, heading

    @property
    def content(self) -> bool:
        """Whether it is a heading or some text, and not mostly links."""
        return self.plain * 2 >= len(self.text) and (bool(self.heading) or self.plain >= CONTENT)


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks of text outside boilerplate in page order, each with its container, and the containers."""
    root = Element("", "", False, False, None, 0)
    stack, containers = [root], [root]
    pending: list[tuple[Element, list[tuple[str, Element]], str]] = []
    marks: list[Element] = []
    text: list[tuple[str, Element]] = []
    at = 0
    last_ends: dict[str, int] = {}

    def end_block() -> None:
        if text:
            home = stack[-1]
            while home.tag not in CONTAINERS and home.parent is not None:
                home = home.parent
            pending.append((home, text.copy(), next((e.tag for e in reversed(stack) if e.tag in HEADINGS), "")))
            text.clear()

    def add(chunk: str) -> None:
        if not stack[-1].dropped:
            if "&" in chunk:
                chunk = html.unescape(chunk)
            text.append((chunk, stack[-1]))

    def ends_after(tag: str, start: int) -> bool:
        if tag not in last_ends:
            last_ends[tag] = max((e.start() for e in END[tag].finditer(page)), default=-1)
        return last_ends[tag] >= start

    while m := TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            if m.group(0).startswith("<![CDATA["):
                add(m.group(0)[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        empty = not m.group(1) and m.group(3).endswith("/")
        if tag in RAW and not m.group(1):
            if empty and (any(e.tag in ("svg", "math") for e in stack) or not ends_after(tag, at)):
                continue
            end = END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            end_block()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and tag not in EMBEDDED and stack[i].tag in BLOCKS:
                    break
            continue
        if tag in BLOCKS:
            _close(stack, {"svg", "option"}, {"foreignobject"})
        if tag in IN_P:
            _close(stack, {"p"}, BLOCKS - {"p"})
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        if tag in VOID or (tag in EMBEDDED or tag == "math") and empty or tag in EMBEDDED and not ends_after(tag, at):
            continue
        top = stack[-1]
        names, named, dropped = "", False, top.dropped or tag in DROPPED or tag in EMBEDDED
        if tag in BLOCKS or m.group(3):
            names, named, bad = _names(m.group(3))
            dropped = dropped or (bad and tag not in ("html", "body"))
            named = named and tag not in ("html", "body")
        path = f"{top.path}/{tag}{names}" if tag in BLOCKS else top.path
        new = Element(tag, path, dropped, top.link or tag == "a", top, len(containers), named)
        stack.append(new)
        if tag in ("article", "main", "h1") and not dropped:
            marks.append(new)
        if tag in CONTAINERS and not dropped:
            containers.append(new)
    if at < len(page):
        add(page[at:])
    end_block()
    _judge_names(pending, marks)
    blocks = _blocks(pending)
    if not blocks:  # without the rules of names
        for _, chunks, _ in pending:
            for _, e in chunks:
                for x in _named(e):
                    x.kept = True
        blocks = _blocks(pending)
    return blocks, [e for e in containers if not _unwanted(e)]


def _named(e: Element) -> Iterator[Element]:
    """The elements with a name of boilerplate that hold e, itself included."""
    x = e.named
    while x is not None:
        yield x
        x = x.parent.named if x.parent else None


def _unwanted(e: Element) -> bool:
    """Whether e is in an element that its name drops."""
    return e.named is not None and any(not x.kept for x in _named(e))


def _ids(e: Element | None) -> set[int]:
    """The ids of e and of the elements that hold it."""
    found = set()
    while e is not None:
        found.add(id(e))
        e = e.parent
    return found


def _judge_names(pending: list[tuple[Element, list[tuple[str, Element]], str]], marks: list[Element]) -> None:
    """Keeps elements with a name of boilerplate that hold main, h1, the largest article, or over half of the text outside links.

    Half of the text is no reason beside an article or main without such names that has text: an ad may outgrow a short article.
    """
    total = 0
    articles = {id(e): e for e in marks if e.tag != "h1"}
    for _, chunks, _ in pending:
        for chunk, e in chunks:
            size = 0 if e.link else len(chunk.strip())
            total += size
            x: Element | None = e if size else None
            while x is not None:
                if x.named is x or id(x) in articles:
                    x.plain += size
                x = x.parent
    unnamed = [e for e in articles.values() if e.tag == "article" and e.named is not e]
    plain_ones = {id(e) for e in articles.values() if e.named is None and e.plain}
    largest = max(unnamed, key=lambda e: e.plain, default=None)
    for mark in marks:
        if mark.tag != "article" or mark is largest:
            x = mark
            while x is not None:
                x.holds = True
                x = x.parent
    for _, chunks, _ in pending:
        for _, e in chunks:
            for x in _named(e):
                x.kept = x.holds or 2 * x.plain > total and plain_ones <= _ids(x)


def _blocks(pending: list[tuple[Element, list[tuple[str, Element]], str]]) -> list[Block]:
    """The blocks of wanted text; their containers get scores."""
    blocks = []
    for home, chunks, heading in pending:
        chunks = [(chunk, e) for chunk, e in chunks if not _unwanted(e)]
        joined = " ".join("".join(chunk for chunk, _ in chunks).split())
        if joined:
            linked = sum(len(chunk) for chunk, e in chunks if e.link)
            blocks.append(Block(home, joined, max(0, len(joined) - linked), heading))
            gain = max(0.0, len(joined) - 1.5 * linked)
            if home.tag in ("article", "main"):
                gain *= 1.25
            x: Element | None = home
            while x is not None and gain > 0:
                x.score += gain
                gain, x = gain / 2, x.parent
                while x is not None and x.tag not in CONTAINERS and x.parent is not None:
                    x = x.parent
    return blocks


def _close(stack: list[Element], ended: set[str], until: set[str] | frozenset[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in ended:
            del stack[i:]
            _close(stack, ended, until)
            return
        if stack[i].tag in until:
            return


def _names(attributes: str) -> tuple[str, bool, bool]:
    """Generalised classes of a start tag, whether its names mark boilerplate, and whether its role or state does."""
    if not attributes or not attributes.strip(" /"):
        return "", False, False
    found = {}
    for k, v in ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), v.strip("\"'"))
    words = set(NAME.findall(MODIFIED.sub("", re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower())))
    bad = found.get("role", "").lower() in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    classes = sorted({re.sub(r"\d+", "0", c.lower()) for c in found.get("class", "").split()})
    return "".join("." + c for c in classes), bool(words & DROPPED_NAMES), bad


def best_container(containers: list[Element]) -> Element:
    """The container of the highest score; of even ones the first, which is the outer one."""
    return max(containers, key=lambda e: (e.score, -e.number))


def within(block: Block, homes: dict[int, int]) -> int | None:
    """The value in homes of the block's nearest element there."""
    e: Element | None = block.home
    while e is not None:
        if id(e) in homes:
            return homes[id(e)]
        e = e.parent
    return None


def climb(e: Element, blocks: list[Block]) -> Element:
    """The least container of e that holds all content blocks of its outermost article or main, or of the page if it has none."""
    chain, top = [], 0
    x: Element | None = e
    while x is not None:
        if x.tag in CONTAINERS or x.parent is None:
            chain.append(x)
            if x.tag in ("article", "main"):
                top = len(chain)
        x = x.parent
    chain = chain[: top or None]
    place = {id(x): i for i, x in enumerate(chain)}
    return chain[max((i for b in blocks if b.content and (i := within(b, place)) is not None), default=0)]


def whole(starts: list[Element], blocks: list[Block]) -> list[Block]:
    """Blocks of the containers that starts climb to; of other articles too if these are in one, and a title beside it."""
    homes = {id(top): 0 for top in (climb(e, blocks) for e in starts)}
    chosen = [within(b, homes) is not None for b in blocks]
    tags = [ancestors(b.home) for b in blocks]
    inside = [t for t, c in zip(tags, chosen) if c]
    if inside and all("article" in t and "main" not in t for t in inside):
        titled = any(b.heading == "h1" for b, c in zip(blocks, chosen) if c)
        chosen = [c or "article" in t or (b.heading == "h1" and b.content and not titled) for b, c, t in zip(blocks, chosen, tags)]
    return [b for b, c in zip(blocks, chosen) if c]


def ancestors(e: Element | None) -> set[str]:
    """The tags of e and of the elements that hold it."""
    found = set()
    while e is not None:
        found.add(e.tag)
        e = e.parent
    return found


def extract(page: str, path: str | None) -> str:
    """Blocks of the containers on path, or of the page's best container, joined by one newline."""
    blocks, containers = parse(page)
    if not blocks:
        return ""
    found = whole([best_container(containers)], blocks)
    if path is not None:
        voted = [e for e in containers if e.path == path]
        homes = dict.fromkeys(map(id, voted), 0)
        if voted and 2 * sum(b.plain for b in blocks if within(b, homes) is not None) >= sum(b.plain for b in found):
            found = whole(voted, blocks)
    return "\n".join(b.text for b in found)


def vote(pages: DataFrame) -> DataFrame:
    """(host, path, votes): the path that most of a host's pages vote for; ties go to the higher score, then by path."""

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            rows = []
            for host, page in zip(df["host"], df["html"]):
                blocks, containers = parse(page or "")
                best = best_container(containers)
                if best.score > 0:
                    rows.append((host, climb(best, blocks).path, best.score))
            yield pd.DataFrame(rows, columns=["host", "path", "score"])

    found = pages.select("host", "html").mapInPandas(score, "host string, path string, score double")
    counts = found.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    best = F.max(F.struct("votes", F.round("score").alias("score"), "path"))
    return counts.groupBy("host").agg(best.alias("b")).select("host", "b.path", "b.votes")


def extract_pages(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(page_id, url, text, n_chars) of each page, from its whole html.

    Null html counts as empty and gives an empty text; a null or odd url has the host "". Repeated rows stay; other
    columns aren't read. A host with a third of all pages is counted before any shuffle and its path is broadcast.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    paths = staged(vote(rows), "paths")
    if paths.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:
        joined = lookup_join(rows, paths, ["host"], "votes", rows.count(), "left")
    kind = dict(pages.dtypes)["page_id"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            texts = [extract(page, path if isinstance(path, str) else None) for page, path in zip(df["html"], df["path"])]
            yield pd.DataFrame({"page_id": df["page_id"], "url": df["url"], "text": texts, "n_chars": pd.Series([len(t) for t in texts], dtype="int64")})

    return joined.select("page_id", "url", "html", "path").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
