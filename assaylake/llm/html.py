"""HTML extraction: equivalence classes of tokens make a host's template, and the text of its content slots is extracted."""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _slices, apart, keep, read, small_batches, trim

#: Share of a host's distinct pages that a class of template tokens is on at least, the least number of such pages, and the
#: share of the text in slots that a content element holds at least where no element is marked as the article.
SUPPORT, MIN_PAGES, MAIN_SHARE = 0.5, 4, 0.6

# fixed values: element names by what they do
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes", "template", "svg"}
#: Of these, the ones that stand inside a line of text.
QUIET = {"script", "style", "textarea", "noscript", "iframe", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
BOILERPLATE = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "object", "embed", "applet", "audio", "video", "canvas", "map", "datalist", "fieldset"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "toolbar"}
MARKED = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "footer", "comment",
    "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "disclaimer", "copyright", "skip",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main",
    "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
}
#: Words of a class or id that say nothing about what is marked, and words before a mark that take it back.
NEUTRAL = {"area", "bar", "block", "body", "box", "button", "container", "content", "form", "inner", "item", "items", "link", "links", "list", "panel", "post", "posts", "section", "site", "slot", "text", "thread", "top", "unit", "wrap", "wrapper"}
TAKEN_BACK = {"has", "is", "no", "not", "with", "without"}
#: Elements that hold a piece of a text and never all of it.
PIECES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "pre", "blockquote", "figcaption", "summary", "address"} | INLINE
#: What an opening tag ends, and the elements that it is not looked for beyond.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAMES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")



def marks(value: str) -> bool:
    """Whether a name in a class or id says boilerplate: its words are of MARKED, but for neutral ones; "related-work" and
    "has-sidebar" don't say it."""
    for name in value.split():
        parts = [x.lower() for x in NAMES.findall(name)]
        if any(x in MARKED for x in parts) and all(x in MARKED or x in NEUTRAL for x in parts) and parts[0] not in TAKEN_BACK:
            return True
    return False


def label(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """An element's name in a path (the tag with its role, classes and id), whether its tag or role says boilerplate, whether
    only its classes or id do, and whether it is marked as the article."""
    name, off, marked, art = tag, tag in BOILERPLATE, False, tag in ("article", "main")
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in ATTRIBUTE.finditer(attributes):
            what, value = m[1].lower(), (m[2] or "").strip("\"'")
            if what == "role":
                off |= value.lower() in ROLES
                art |= value.lower() == "main"
                name += f"[{value.lower()}]"
            elif what in ("hidden", "aria-hidden"):
                off |= what == "hidden" or value.lower() == "true"
            else:
                name += f".{value}" if what == "class" else f"#{re.sub(r'[0-9]+', '0', value)}"
                # an article's own class may say anything; it is the article still
                marked |= tag not in ("article", "main", "body", "html") and marks(value)
    return name, off, marked, art and not off


def hashed(*parts: object) -> int:
    h = xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Page:
    """A page's elements in order, and its text.

    Of element i: up[i] is the one around it (of 0, the page itself, none), path[i] a hash of the names from the page to it,
    depth[i], piece[i] whether its tag is one of PIECES, off[i] whether it is boilerplate, art[i] whether it is the outermost one that is marked as the article, and
    size[i] and linked[i] how much of its text is outside boilerplate, and how much of that is in links. flow is the text: (element, in
    a link, text), or None where a block ends. Elements that are left open end as HTML has them end.

    by_name says whether names of elements, roles, classes and ids take part; scripts and styles are no text in any case. A
    class or id alone makes an element boilerplate only if it isn't around an article or most of the page's text."""

    def __init__(self, html: str, by_name: bool = True):
        self.up, self.path, self.depth, self.off, self.art, self.in_art, self.piece, marked = [-1], [0], [0], [False], [False], [False], [False], [False]
        self.flow: list[tuple[int, bool, str] | None] = []
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, in a link
        opened: dict[str, int] = {}
        at, n, flow = 0, len(html), self.flow

        def close(names, barriers):
            if not any(opened.get(x) for x in names):
                return False
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    for x in stack[i:]:
                        opened[x[0]] -= 1
                    del stack[i:]
                    return True
                if stack[i][0] in barriers:
                    return False
            return False

        while at < n:
            m = MARKUP.search(html, at)
            if (m.start() if m else n) > at:
                flow.append((stack[-1][1], stack[-1][2], html[at : m.start() if m else n]))
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            inline = tag in INLINE or opened.get("math", 0) > 0 or tag == "math"
            if m[1] or m[4]:
                if tag == "p" and not opened.get("p"):
                    flow.append(None)
                elif tag not in VOID and close({tag}, {"article", "main", "td", "th", "table"} - {tag} if inline else {"article", "main"} - {tag} if tag not in ("body", "html") else ()) and not inline:
                    flow.append(None)
                continue
            if not inline and tag not in QUIET:
                flow.append(None)
            elif tag == "br":
                flow.append((stack[-1][1], stack[-1][2], " "))
            if tag in CLOSES_P:
                close({"p"}, {"article", "main", "div", "section", "td", "th", "li", "body", "button", "blockquote", "aside", "nav", "header", "footer", "form"})
            if tag in ENDS:
                close(*ENDS[tag])
            if tag == "body":
                close({"head"}, ())
            if tag in VOID:
                continue
            attributes = m[3] or m[6] or ""
            name, off, mark, art = label(tag, attributes)
            if not by_name:
                off, mark, art = tag in RAW, False, False
            _, above, link = stack[-1]
            me = len(self.up)
            self.up.append(above)
            self.path.append(hashed(self.path[above], name))
            self.depth.append(self.depth[above] + 1)
            self.off.append(off or self.off[above])
            marked.append(mark)
            self.piece.append(tag in PIECES)
            self.art.append(art and not self.in_art[above] and not self.off[-1])
            self.in_art.append(self.in_art[above] or self.art[-1])
            if tag in RAW:  # everything up to the end tag is its text
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
                if tag not in QUIET:
                    flow.append(None)
            elif not attributes.endswith("/") or inline or tag in CLOSES_P:
                stack.append((tag, me, link or tag == "a"))
                opened[tag] = opened.get(tag, 0) + 1
        self._keys: list[int | None] | None = None
        self._sizes()
        whole = self.size[0]
        around = self.art.copy()
        for i in range(len(self.up) - 1, 0, -1):
            around[self.up[i]] |= around[i]
        gone = False
        for i in range(1, len(self.up)):
            if marked[i] and not around[i] and 2 * self.size[i] <= whole or self.off[self.up[i]]:
                gone |= not self.off[i]
                self.off[i] = True
                self.art[i] = False
        if gone:
            self._sizes()

    def _sizes(self) -> None:
        self.size, self.linked = [0] * len(self.up), [0] * len(self.up)
        for x in self.flow:
            if x and not self.off[x[0]]:
                k = len(x[2].strip())
                self.size[x[0]] += k
                self.linked[x[0]] += k * x[1]
        for i in range(len(self.up) - 1, 0, -1):
            self.size[self.up[i]] += self.size[i]
            self.linked[self.up[i]] += self.linked[i]

    def keys(self) -> list[int | None]:
        """For each item of flow the token of its text, by path and words; None for block ends and outside of what counts."""
        if self._keys is None:
            self._keys = [hashed(self.path[x[0]], text) if x and not self.off[x[0]] and (text := " ".join(x[2].split())) else None for x in self.flow]
        return self._keys

    def tokens(self) -> list[tuple[int, bool, int]]:
        """(token, whether it is text, element's path) in the order of the page: its elements by their paths, and its runs of
        text outside boilerplate by path and words."""
        out, seen = [], 0
        for x, key in zip(self.flow, self.keys(), strict=True):
            if x is None:
                continue
            while seen <= x[0]:
                out.append((self.path[seen], False, self.path[seen]))
                seen += 1
            if key is not None:
                out.append((key, True, self.path[x[0]]))
        out += [(p, False, p) for p in self.path[seen:]]
        return out


def host_of(url: Column) -> Column:
    """The host of an address in lower case, '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1)), F.lit(""))


def page_tokens(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """(host, token, text, path, n, page): each token of each page, how often it is there, and a hash of the page."""

    def batches(it):
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64()]
        for whole in it:
            for a, k in _slices(whole.column(1)):
                cols: list[list] = [[] for _ in kinds]
                for group, html in zip(whole.column(0).slice(a, k).to_pylist(), whole.column(1).slice(a, k).to_pylist(), strict=True):
                    page, found = hashed(html or ""), {}
                    for t in Page(html or "", by_name).tokens():
                        found[t] = found.get(t, 0) + 1
                    for (token, text, path), n in found.items():
                        for c, v in zip(cols, (group, token, text, path, n, page), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "token", "text", "path", "n", "page"])
        trim()

    return small_batches(pages).select(host_of(F.col("url")).alias("host"), "html").mapInArrow(batches, "host string, token long, text boolean, path long, n int, page long")


def classes(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """(host, token, text, path, class): the tokens of a host that are in an equivalence class of enough support.

    A token's occurrence vector says how often it stands on each of the host's pages; copies of a page are one page. Vectors
    are never built: two tokens have equal ones if the combined hashes of their (page, count) agree, and those come out of
    one aggregation. Tokens of equal vectors are a class, if they are on MIN_PAGES pages and SUPPORT of the host's or more,
    and at least one of them is an element: text alone makes no template."""
    at = F.xxhash64("page", "n")
    seen = keep(page_tokens(pages, by_name).withColumn("at", at).groupBy("host", "token", "text", "path").agg(F.count_distinct("at").alias("pages"), F.expr("bit_xor(DISTINCT at)").alias("vector")).where("pages > 1 OR token = 0"))
    of = seen.where("token = 0 AND NOT text").select("host", F.col("pages").alias("of"))
    often = seen.join(of, "host").where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= F.col("of") * SUPPORT))
    named = often.select("host", "token", "text", "path", F.xxhash64("pages", "vector").alias("class"))
    real = named.where("NOT text").select("host", "class").distinct()
    return keep(named.join(real, ["host", "class"]))


def order_of(places: list[int]) -> int | None:
    """A hash of the tokens of a class as they follow each other on a page, once if they repeat as a whole; None if
    they do not."""
    n = len(set(places))
    if len(places) % n or any(places[i] != places[i % n] for i in range(len(places))):
        return None
    return hashed(*places[:n])


def page_classes(page: Page, known: dict[int, int], root: int) -> tuple[dict[int, tuple[int, int, int]], dict[int, tuple[int, int]]]:
    """How the classes lie on a page: for each class a hash of its order (0 if it isn't in one), and the first and last slot of
    the root class that its tokens are in; and for each element of the template (by path) the text in slots inside it, and how much of
    that is in links."""
    seq: dict[int, list[int]] = {}
    slots: dict[int, tuple[int, int]] = {}
    slot = 0
    for token, _, _ in page.tokens():
        c = known.get(token)
        if c is None:
            continue
        slot += c == root
        seq.setdefault(c, []).append(token)
        low, high = slots.get(c, (slot, slot))
        slots[c] = min(low, slot), max(high, slot)
    size, linked = [0] * len(page.up), [0] * len(page.up)
    for x, key in zip(page.flow, page.keys(), strict=True):
        if x and not page.off[x[0]] and key not in known:
            k = len(x[2].strip())
            size[x[0]] += k
            linked[x[0]] += k * x[1]
    held: dict[int, tuple[int, int]] = {}
    for i in range(len(page.up) - 1, -1, -1):
        if i:
            size[page.up[i]] += size[i]
            linked[page.up[i]] += linked[i]
        if page.path[i] in known:
            a, b = held.get(page.path[i], (0, 0))
            held[page.path[i]] = a + size[i], b + linked[i]
    return {c: (order_of(ts) or 0, *(slots[c] if c != root else (0, 0))) for c, ts in seq.items()}, held


def templates(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """(host, tokens, fixed, roots, menus): for each host with a template the tokens of its valid classes, those of them that are
    text, the paths of its content elements, and those of elements whose slots hold links for the most part.

    The root class is that of the page itself, once on every page. Its tokens part a page into slots. A class is valid if its
    tokens follow each other in one order on all pages (as often as they repeat), and if it is nested: all of it is
    in the same slot of the root class on every page. Elements nest by their paths within a slot. What is not of a valid class
    is slot content. A host's row holds at most 1 / SUPPORT times the tokens of a mean page, whatever its pages."""
    found = classes(pages, by_name)
    maps = found.groupBy("host").agg(F.collect_list(F.struct("token", "class", "text", "path")).alias("tokens"))
    joined = pages.select(host_of(F.col("url")).alias("host"), "html").join(maps, "host").select("host", "html", "tokens")

    def laid(it):
        names, kinds = ["host", "class", "path", "order", "low", "high", "size", "linked", "off", "art", "depth", "piece"], [pa.string(), *[pa.int64()] * 7, pa.bool_(), pa.bool_(), pa.int64(), pa.bool_()]
        last: tuple = (None, None, None)
        for whole in it:
            for a, k in _slices(whole.column(1)):
                cols: list[list] = [[] for _ in kinds]
                for i in range(a, a + k):
                    group = whole.column(0)[i].as_py()
                    if last[0] != group:
                        known = {t["token"]: t["class"] for t in whole.column(2)[i].as_py()}
                        last = (group, known, known.get(0))
                    page = Page(whole.column(1)[i].as_py() or "", by_name)
                    lie, held = page_classes(page, last[1], last[2])
                    at = {p: j for j, p in reversed(list(enumerate(page.path)))}
                    rows = [(group, c, None, *x, 0, 0, False, False, 0, False) for c, x in lie.items()]
                    rows += [(group, last[1][p], p, 0, 0, 0, *x, page.off[at[p]], page.art[at[p]], page.depth[at[p]], page.piece[at[p]]) for p, x in held.items()]
                    for row in rows:
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
        trim()

    lie = joined.mapInArrow(laid, "host string, class long, path long, order long, low long, high long, size long, linked long, off boolean, art boolean, depth long, piece boolean")
    lie = keep(lie.groupBy("host", "class", "path").agg(*[f(c).alias(f"{g}_{c}") for c in ("order", "low", "high") for g, f in (("min", F.min), ("max", F.max))], F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.bool_and("off").alias("off"), F.bool_or("art").alias("art"), F.min("depth").alias("depth"), F.bool_or("piece").alias("piece")))
    valid = lie.where("path IS NULL AND min_order = max_order AND min_order <> 0 AND min_low = max_high").select("host", "class")
    kept = found.join(valid, ["host", "class"])
    tokens = kept.groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list(F.when(F.col("text"), F.col("token"))).alias("fixed"))
    elements = lie.where("path IS NOT NULL").join(valid, ["host", "class"]).groupBy("host").agg(F.collect_list(F.struct("path", "size", "linked", "off", "art", "depth", "piece")).alias("elements"))

    def decided(it):
        for batch in it:
            rows = batch.column(3).to_pylist()
            chosen = [content([(e["path"], e["size"], e["linked"], e["off"], e["art"], e["depth"], e["piece"]) for e in x or []]) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array([c[i] for c in chosen], pa.list_(pa.int64())) for i in (0, 1))], ["host", "tokens", "fixed", "roots", "menus"])

    return keep(tokens.join(elements, "host", "left").mapInArrow(decided, "host string, tokens array<long>, fixed array<long>, roots array<long>, menus array<long>"))


def content(elements: Iterable[tuple[int, int, int, bool, bool, int, bool]]) -> tuple[list[int], list[int]]:
    """Of elements (path, text in slots, that in links, boilerplate, article, depth, piece): those whose slots hold the content, and
    those of menus.

    The elements marked as the article, if there are. Else the innermost element, no piece of a text, that still holds MAIN_SHARE of the text in
    slots, and less of it in links than outside; and elements with more of it in links than outside are menus."""
    live = [e for e in elements if not e[3]]
    if arts := sorted({e[0] for e in live if e[4]}):
        return arts, []
    whole = max((e[1] for e in live), default=0)
    deep = [e for e in live if e[1] >= MAIN_SHARE * whole and 2 * e[2] <= e[1] and whole and not e[6]]
    menus = sorted({e[0] for e in live if 2 * e[2] > e[1]})
    return ([max(deep, key=lambda e: (e[5], e[1], e[0]))[0]] if deep else [0]), menus


def extract_page(html: str | None, fixed: list[int] | None, roots: list[int] | None, menus: list[int] | None, by_name: bool = True) -> str:
    """The blocks of text in the content slots. A page that lacks its host's content elements is its own template."""
    if not html:
        return ""
    page = Page(html, by_name)
    paths = set(page.path)
    own = [r for r in roots or () if r in paths]
    # an article of its own counts where the host's template has none
    if not own or any(page.art) and not any(a and p in own for a, p in zip(page.art, page.path, strict=True)):
        own, menus = content(zip(page.path, page.size, page.linked, page.off, page.art, page.depth, page.piece, strict=True))
    wanted, unwanted, constant = set(own), set(menus or ()), set(fixed or ())
    inside = [False] * len(page.up)
    for i in range(len(page.up)):
        above = page.up[i]
        inside[i] = (page.path[i] in wanted or above >= 0 and inside[above]) and (page.path[i] not in unwanted or page.path[i] in wanted)
    live = [x is not None and inside[x[0]] and not page.off[x[0]] for x in page.flow]
    gone = [y and key in constant for y, key in zip(live, page.keys(), strict=True)] if constant else [False] * len(live)
    # where most of the content would go, the host's pages repeat one article: that is no template
    if 2 * sum(len(x[2].strip()) for x, y in zip(page.flow, gone, strict=True) if y) > sum(len(x[2].strip()) for x, y in zip(page.flow, live, strict=True) if y):
        gone = [False] * len(gone)
    blocks, block = [], []
    for x, y, z in zip(page.flow, live, gone, strict=True):
        if x is None:
            if block:
                blocks.append(block)
                block = []
        elif y and not z:
            block.append(x[2])
    blocks.append(block)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(x for x in lines if x)


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), by_name: bool = True) -> DataFrame:
    """The columns in carry, text and n_chars of every page (columns url and html).

    Kept is the text in the content slots of the host's template, see templates and content: not the texts of valid classes, on
    which all such pages agree (unless they are most of a page's content: then the host repeats one article), and not what names of elements or roles, or as a last resort classes and ids, mark as menus,
    headers, footers, side bars, notices, adverts, forms and comments. Hosts of fewer than MIN_PAGES distinct pages have
    no template, and their pages go by their own elements. Character references are decoded, white space in a block is one
    space, blocks are joined by an empty line. Null and empty html give an empty text; pages with a null or broken url share the
    host ''. Repeated pages give a row each and count once in a template. Pages are read whole and to any depth; an
    empty table gives no row. A carried column named text or n_chars gets an underscore behind its name.

    Templates meet the pages in a join by host; adaptive execution splits a large host's pages or broadcasts the templates where they are small."""
    known = templates(pages, by_name)
    held = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    own = pages.select(*held, F.col("html").alias("_html"), host_of(F.col("url")).alias("host"))
    joined = own.join(known.drop("tokens"), "host", "left").select(*(f"_c{i}" for i in range(len(carry))), "_html", "fixed", "roots", "menus")

    def batches(it):
        k = len(carry)
        for whole in it:
            for a, n in _slices(whole.column(k)):
                part = whole.slice(a, n)
                texts = [extract_page(*x, by_name) for x in zip(*(part.column(i).to_pylist() for i in range(k, k + 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(k)), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], [*(f"_c{i}" for i in range(k)), "text", "n_chars"])
        trim()

    types = dict(pages.dtypes)
    head = "".join(f"_c{i} {types[c]}, " for i, c in enumerate(carry))
    return small_batches(joined).mapInArrow(batches, f"{head}text string, n_chars long").toDF(*apart(carry, ["text", "n_chars"]), "text", "n_chars")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
