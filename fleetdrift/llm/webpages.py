"""Main text of web pages by removal of site templates.

Every element outside the article, and every container within it, is hashed with
its whole subtree, from the hashes of its children.  Spark counts on how many
different pages of a host each hash occurs; subtrees on at least ``SHARE`` of them
or on ``MOST_PAGES``, and on ``LEAST_PAGES`` at least, are the site's template and
are deleted: what recurs often enough is template however large the host is.
Elements whose role is plain by name, class or ARIA role (menus, forms, scripts,
comments ...) go too, as they may differ from page to page; within the article a
class has to name such a part and nothing else.  Paragraphs of the article never
count as template: passages may be shared by many articles.

Defined cases: null and empty pages give an empty text; copies of a page count
once; pages without a host lose nothing by template; without an article or main
element, or with one that holds a small part of the text only (a teaser), the
whole body is the article, whose paragraphs, headings and quotations are no
template unless a container of them is; broken mark-up is read as browsers do, as
far as nesting matters here; text after an unfinished tag is dropped.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.llm.storage import stored

SHARE, LEAST_PAGES, MOST_PAGES = 0.2, 3, 50
#: The body is the article where it holds so many times the text of the article elements.
TEASER_TIMES = 4

# Element names of the HTML standard by their part in the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset(
    "head script style noscript template iframe nav header footer aside form button select textarea dialog menu "
    "svg math canvas object audio video noembed noframes title".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CONTENT = frozenset(["article", "main"])
CONTAINERS = frozenset("div section ul ol dl table figure details fieldset center".split())
CLOSED_BY = {  # open element -> starts that close it, and the elements that shield it
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "tbody", "tfoot", "thead"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]), frozenset(["table"])),
    "th": (frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]), frozenset(["table"])),
    "option": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
_P_CLOSERS = BLOCKS - frozenset("br body html caption dd dt li legend optgroup option tbody td tfoot th thead tr".split())
_P_SHIELDS = frozenset("article aside body caption div footer header html li main nav section table td th".split())

# Words of class and id names, and ARIA roles, that mark what is no article.
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search status".split())
CLASS_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs "
    "comment comments disqus replies consent cookie cookies gdpr footer header menu nav navbar navigation newsletter "
    "notice popup modal overlay related recommended share sharing sidebar skip social subscribe subscription toolbar "
    "masthead pager pagination".split()
)

# Words that may follow such a word within an article and leave its meaning.
PART_WORDS = frozenset(
    "area bar block blocks box boxes button buttons container content form inner item items label link links list panel "
    "section slot thread unit widget wrap wrapper".split()
)

# Attributes as browsers read them: values in quotes, or up to the next blank.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)?)*+)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"\s(?:hidden|aria-hidden\s*=\s*[\"']?true)(?=[\s>/=\"']|\Z)", re.I)


def _names_a_part(value: str) -> bool:
    """Whether one class or id of the value says nothing but what part of a page this is."""
    for token in value.split():
        words = _WORD.findall(token)
        if words and words[0] in CLASS_WORDS and all(w in CLASS_WORDS or w in PART_WORDS for w in words):
            return True
    return False


def _plain_role(name: str, attributes: str, within: bool) -> bool:
    """Whether an element is no part of an article by its name or attributes."""
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if key.lower() == "role":
            if value in ROLES:
                return True
        elif name not in CONTENT and (_names_a_part(value) if within else not CLASS_WORDS.isdisjoint(_WORD.findall(value))):
            return True
        elif name in CONTENT and not {"comment", "comments", "related", "ad", "promo"}.isdisjoint(_WORD.findall(value)):
            return True
    return bool(_HIDDEN.search(f" {attributes}"))


class _Element:
    """An open element: its place, whether it is dropped or within the article, and the hash of its subtree so far."""

    __slots__ = ("name", "first", "dropped", "within", "hash", "has_text")

    def __init__(self, name: str, first: int, dropped: bool, within: bool):
        self.name, self.first, self.dropped, self.within = name, first, dropped, within
        self.hash = hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8)
        self.has_text = False

    def add(self, child: _Element) -> None:
        self.hash.update(b"\1" + child.hash.digest())
        self.has_text |= child.has_text


class Page:
    """One pass over a page: its blocks of text, and the hashed subtrees that may be template."""

    def __init__(self, source: str, template: frozenset[int] = frozenset()):
        self.template = template
        self.blocks: list[tuple[int, bool, str]] = []  # (place, within the article, text)
        self.found: set[int] = set()
        self.prose: set[int] = set()  # of these, paragraphs and the like outside of article elements
        self.deleted: list[tuple[int, int]] = []
        self.places = 0
        self.stack: list[_Element] = [_Element("", 0, False, False)]
        self.open: Counter[str] = Counter()
        self.has_article = False
        self.run: list[str] = []
        self._read(source)

    def _break(self) -> None:
        if self.run:
            text = " ".join(html.unescape("".join(self.run)).split())
            self.run.clear()
            if text:
                top = self.stack[-1]
                top.hash.update(b"\0" + text.encode("utf-8", "replace"))
                top.has_text = True
                self.places += 1
                if not top.dropped:
                    self.blocks.append((self.places, top.within, text))

    def _close(self, depth: int) -> None:
        """Pop the stack down to ``depth`` elements."""
        while len(self.stack) > depth:
            name = self.stack[-1].name
            if name in BLOCKS:
                self._break()
            own = self.stack.pop()
            self.open[name] -= 1
            self.stack[-1].add(own)
            inside = own.within and name not in CONTENT
            if name in ("html", "body") or name not in BLOCKS or (inside and name not in CONTAINERS) or name in CONTENT:
                continue
            if not own.has_text:
                continue
            code = int.from_bytes(own.hash.digest(), "little", signed=True)
            self.found.add(code)
            if name not in CONTAINERS and name not in DROPPED:
                self.prose.add(code)
            if code in self.template:
                self.deleted.append((own.first, self.places))

    def _open(self, name: str, attributes: str) -> None:
        if name in _P_CLOSERS and self.open["p"]:
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth].name == "p":
                    self._close(depth)
                    break
                if self.stack[depth].name in _P_SHIELDS:
                    break
        if name in _CLOSERS:
            for depth in range(len(self.stack) - 1, 0, -1):
                closers, _ = CLOSED_BY.get(self.stack[depth].name, (frozenset(), frozenset()))
                if name in closers:
                    self._close(depth)
                    break
                if self.stack[depth].name in ("table", "ul", "ol", "dl", "select", "menu"):
                    break
        if name in BLOCKS:
            self._break()
        if name in VOID:
            return
        top = self.stack[-1]
        role = _plain_role(name, attributes, top.within)
        if role and name not in BLOCKS:
            self._break()  # an inline element that is dropped must not take the block's text along
        if name in CONTENT:
            self.has_article = True
        self.open[name] += 1
        self.stack.append(_Element(name, self.places, top.dropped or role, top.within or name in CONTENT))

    def _end(self, name: str) -> None:
        if not self.open[name]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].name == name:
                if name in BLOCKS or depth == len(self.stack) - 1:
                    if self.stack[depth].dropped:
                        self._break()
                    self._close(depth)
                elif self.stack[depth].dropped and not self.stack[depth - 1].dropped:
                    self._break()
                    self._close(depth)
                else:
                    self.stack[depth - 1].add(self.stack[depth])
                    self.open[name] -= 1
                    del self.stack[depth]  # misnested inline element
                return

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _MARKUP.search(source, at)
            if m is None:
                self.run.append(source[at:])
                break
            if m.start() > at:
                self.run.append(source[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
            else:
                self._open(name, m[3])
                if name in RAW:
                    stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    self.run.append(source[at : stop.start()] if stop else source[at:])
                    self._break()
                    at = stop.end() if stop else n
                    self._end(name)
        self._break()
        self._close(1)

    def candidates(self) -> set[int]:
        """Subtrees that count as template where they recur; a body that is the article has its prose left out."""
        return self.found if self.has_article else self.found - self.prose

    def text(self) -> str:
        cuts, kept = sorted(self.deleted), []
        at = end = 0
        for place, within, text in self.blocks:
            while at < len(cuts) and cuts[at][0] < place:
                end = max(end, cuts[at][1])
                at += 1
            if place > end:
                kept.append((within, text))
        inside = sum(len(t) for within, t in kept if within)
        outside = sum(len(t) for within, t in kept if not within)
        if inside and outside < TEASER_TIMES * inside:
            kept = [x for x in kept if x[0]]
        return " ".join(t for _, t in kept)


_CLOSERS = frozenset().union(*(starts for starts, _ in CLOSED_BY.values()))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page a hash of its text and those of its subtrees that may be template."""
    for batch in batches:
        pages, codes = [], []
        for i in range(len(batch)):
            page = Page(batch.column("html")[i].as_py() or "")
            own = hashlib.blake2b("\0".join(t for _, _, t in page.blocks).encode("utf-8", "replace"), digest_size=8).digest()
            pages.append(int.from_bytes(own, "little", signed=True))
            codes.append(list(page.candidates()))
        columns = [batch.column("host"), batch.column("source"), pa.array(pages, pa.int64()), pa.array(codes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "source", "page", "codes"])


def _texts(fields: list[str]) -> Callable:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i in range(len(batch)):
                template = batch.column("_template")[i].as_py()
                texts.append(Page(batch.column("_html")[i].as_py() or "", frozenset(template or ())).text())
            columns = [batch.column(c) for c in fields]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            clean = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, clean, sizes], [*fields, "text", "n_chars"])

    return extract


def host_of(url: Column) -> Column:
    """Host of a URL in lower case without port, empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def site_templates(
    pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES, most_pages: int = MOST_PAGES
) -> DataFrame:
    """host, source (hash of the html) and template: which of its own subtrees are on many pages of the host.

    The rows are counted with partial sums before they are shuffled, so a host
    with a third of all pages costs no task more than others; a page gets its own
    subtrees back, never all of its host's.
    """
    described = stored(
        pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("source"), "html")
        .where((F.col("host") != "") & F.col("html").isNotNull())
        .mapInArrow(_subtrees, "host string, source long, page long, codes array<long>")
    )
    seen = described.select("host", "page", F.explode("codes").alias("code")).distinct()
    sizes = described.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = seen.groupBy("host", "code").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(
        counts.join(sizes, "host")
        .where((F.col("n") >= least_pages) & (F.col("n") >= F.least(F.col("pages") * share, F.lit(float(most_pages)))))
        .select("host", "code")
    )
    own = described.select("host", "source", F.explode("codes").alias("code")).distinct()
    return stored(own.join(repeated, ["host", "code"]).groupBy("host", "source").agg(F.collect_list("code").alias("template")))


def extract_texts(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every page with its main text and the text's code points."""
    templates = site_templates(pages).select(
        F.col("host").alias("_host"), F.col("source").alias("_source"), F.col("template").alias("_template")
    )
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema.fields)
    # The same join at every size; Spark splits the partitions of hot pages.
    return (
        pages.select(*keep, F.col("html").alias("_html"), host_of(F.col("url")).alias("_host"), F.xxhash64("html").alias("_source"))
        .join(templates.hint("shuffle_hash"), ["_host", "_source"], "left")
        .select(*keep, "_html", "_template")
        .mapInArrow(_texts(keep), fields + "text string, n_chars long")
    )
