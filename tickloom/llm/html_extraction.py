"""HTML extraction by template deduction over the pages of a host.

A page's tokens are its elements, told apart by their paths, and its blocks of text, told apart by path and
text. A token's occurrence vector says how often it stands in each page of its host. Grouped aggregation
sums hashes of (page, count), so tokens have equal sums if they have equal vectors, and no host's pages
meet in one task.

Tokens of one vector form an equivalence class. A class is valid if it has enough support, its tokens stand
once in each of its pages, and it nests: all its tokens lie in one slot of the classes placed before it,
which have more pages; the slots of a class are the insides of its elements. The valid classes are the
host's template. A block of text is the template's own, and no data, only if it is in one class with the innermost
element of the template around it, so that it stands once wherever that element does, on at least ``TEXT_PAGES``
pages, and not inside an article or main element: what some pages share, however many of a small host, is their text.
What is left in the slots are the data, and the deepest slot with most of the host's data outside menus and other
furniture is the main one. If the template had more text of its own there than data, its pages are copies of each
other and all their text is data. Pages of a host too small for that use their own tree, and so do pages without the main slot.

The main slot's blocks, without the furniture inside it, are the text: character references are
decoded, white space inside a block becomes one space, blocks are trimmed and joined by an empty line.

Defined results: null html and pages without text give an empty text; a null or odd url belongs to the
host ""; repeated rows each get their row; an empty table gives an empty result; other columns stay as
they are, except ``main_text``, which is set.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import staged, text_of, tidied, unused

#: Template tables of at most so many bytes are sent to the tasks; larger ones are joined by shuffling.
FEW_BYTES = 8 << 20
#: Tokens of the template stand in this share of a host's pages, texts of it also on so many.
SUPPORT = 0.3
TEXT_PAGES = 6
#: The main slot has this share of the host's text.
SHARE = 0.6

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements of HTML by how they behave.
RAW = frozenset("script style title textarea noscript iframe template svg math object select option datalist canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
FURNITURE = frozenset("nav footer aside form button menu dialog head fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
MAIN = frozenset("article main".split())
#: Elements of text, which are parts of a main slot and never all of it.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl li dt dd figure figcaption".split())
#: Elements that end an open paragraph when they begin.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements that end an open one of their own group when they begin.
GROUPS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of class and id attributes that name furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert sponsor promo banner sidebar side aside menu nav breadcrumb breadcrumbs footer foot header masthead topbar toolbar "
    "comment comments commentlist respond replies reply disqus notice notification cookie cookies consent gdpr alert popup modal overlay newsletter "
    "subscribe signup login search share sharing social related recommended recirc widget pagination pager copyright legal disclaimer skip".split()
)
#: Words that furniture words may begin with, whatever follows.
FURNITURE_STEMS = ("advert", "sponsor", "promo", "menu", "nav", "notice", "notification", "recirc", "widget")
#: Those that also name sections of an article; there they count only for elements that are mostly links.
SECTION_WORDS = frozenset(
    "header foot legal related recommended alert social notice notification disclaimer copyright side aside search signup login widget menu masthead skip".split()
)
#: First words of names that tell what an element holds or lacks, not what it is.
LAYOUT_WORDS = frozenset("has no with without".split())
PARTS = re.compile(r"[-_]+")
DIGITS = re.compile(r"\d+")


def furniture_words(label: str) -> set[str]:
    """The furniture words in class and id names; names like has-sidebar describe the layout and give none."""
    out = set()
    for name in label.lower().split():
        parts = [w for w in PARTS.split(name) if w]
        if len(parts) < 2 or parts[0] not in LAYOUT_WORDS:
            for w in parts:
                stem = next((x for x in FURNITURE_STEMS if w.startswith(x)), None)
                if stem or w in FURNITURE_WORDS:
                    out.add(stem or w)
    return out


class Element:
    """What decides if an element is furniture: its own marks, and the text and links below it."""

    __slots__ = ("above", "chars", "inside", "linked", "main", "named", "sections", "strict")

    def __init__(self, above: int, strict: bool, named: bool, sections: bool, main: bool, inside: bool):
        self.above, self.strict, self.named, self.sections, self.main, self.inside = above, strict, named, sections, main, inside
        self.chars = self.linked = 0


class Page:
    """A page as blocks of text: (path, furniture, characters in links, text), and how often each path stands in it."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, int, str]] = []
        self.counts: dict[str, int] = defaultdict(int)
        self._stack: list[tuple[str, str, int]] = []
        self._elements = [Element(-1, False, False, False, False, False)]
        self._owners: list[int] = []
        self._parts: list[str] = []
        self._linked = 0
        at = 0
        while True:
            token = TOKEN.search(source, at)
            if token is None:
                self._text(source[at:])
                break
            self._text(source[at : token.start()])
            at = token.end()
            name = token["name"]
            if name is None:
                continue
            name = name.lower()
            if token["close"]:
                self._end(name)
            elif name in RAW:
                if not token["rest"].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                    at = len(source) if end is None else source.find(">", end.start()) + 1 or len(source)
                if name not in INLINE:
                    self._close()
            else:
                self._start(name, token["rest"])
        self._close()
        self._decide()

    def _text(self, raw: str) -> None:
        if raw:
            self._parts.append(raw)
            if any(n == "a" for n, _, _ in self._stack):
                self._linked += len(raw.strip())

    def _close(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                path = next((p for n, p, _ in reversed(self._stack) if n not in INLINE), "")
                self.blocks.append((path, False, self._linked, text))
                self._owners.append(self._stack[-1][2] if self._stack else 0)
        self._parts, self._linked = [], 0

    def _decide(self) -> None:
        """Marks the blocks in furniture, once the text below each element is known.

        A name or a form around the main article, or around most of the text of a page without one, marks nothing.
        """
        every = self._elements
        strict = [False] * len(every)
        for k, e in enumerate(every[1:], 1):
            strict[k] = strict[e.above] or e.strict
        for (_, _, linked, text), k in zip(self.blocks, self._owners, strict=True):
            if not strict[k]:
                every[k].chars += len(text)
                every[k].linked += min(linked, len(text))
        for e in reversed(every[1:]):
            every[e.above].chars += e.chars
            every[e.above].linked += e.linked
        own = [e.chars - e.linked for e in every]
        around: set[int] = set()
        mains = [k for k, e in enumerate(every) if e.main and not e.inside and own[k]]
        if mains:
            k = max(mains, key=lambda k: own[k])  # the first of the largest; comments may be articles too
            while k >= 0:
                around.add(k)
                k = every[k].above
        furniture = strict
        for k, e in enumerate(every[1:], 1):
            holds = k in around if mains else own[k] > 0 and own[k] >= SHARE * own[0]
            marked = e.named or (e.sections and (not e.inside or 2 * e.linked >= e.chars))
            furniture[k] = furniture[k] or furniture[e.above] or (marked and not holds)
        self.blocks = [(p, furniture[k], n, t) for (p, _, n, t), k in zip(self.blocks, self._owners, strict=True)]

    def _pop_to(self, names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            n = self._stack[k][0]
            if n in names:
                del self._stack[k:]
                return
            if n in stop:
                return

    def _start(self, name: str, rest: str) -> None:
        if name == "br":
            self._parts.append(" ")
        if name not in INLINE:
            self._close()
        if name in ENDS_PARAGRAPH:
            self._pop_to({"p"}, frozenset({"table", "td", "th", "li", "button", "article", "section", "div"}))
        if name in GROUPS:
            self._pop_to(GROUPS[name], frozenset({"ul", "ol", "dl", "table"}))
        if name in VOID:
            return
        above = self._stack[-1] if self._stack else ("", "", 0)
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
        label = attributes.get("class", "") + " " + attributes.get("id", "")
        owner = self._elements[above[2]]
        inside = owner.inside or owner.main
        strict = (
            (name in FURNITURE and name != "form")
            or (name == "header" and not inside)
            or attributes.get("role", "").lower() in FURNITURE_ROLES
            or "hidden" in attributes
            or attributes.get("aria-hidden") == "true"
            or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        )
        words = furniture_words(label) if name not in MAIN and name not in ("html", "body") and label != " " else set()
        element = above[2]
        if strict or words or name in MAIN or name == "form":
            element = len(self._elements)
            self._elements.append(Element(above[2], strict, name == "form" or bool(words - SECTION_WORDS), bool(words), name in MAIN, inside))
        path = above[1]
        if name not in INLINE:
            kind = DIGITS.sub("", ".".join(sorted(attributes.get("class", "").split())[:3]))
            path = f"{path}/{name}.{kind}" if kind else f"{path}/{name}"
            self.counts[path] += 1
        self._stack.append((name, path, element))

    def _end(self, name: str) -> None:
        if name == "p" and not any(n == "p" for n, _, _ in self._stack):
            self._close()
            return
        if name not in INLINE:
            self._close()
            self._pop_to({name}, frozenset())
        else:
            self._pop_to({name}, ENDS_PARAGRAPH | {"li", "td", "th", "body"})

    def masses(self) -> dict[str, int]:
        """Characters of text outside furniture and links, by path and all paths above it."""
        out: dict[str, int] = defaultdict(int)
        for path, furniture, linked, text in self.blocks:
            n = 0 if furniture else max(0, len(text) - linked)
            while n and path:
                out[path] += n
                path = path.rpartition("/")[0]
        return out


def text_name(path: str, text: str) -> int:
    """A 63-bit name of a block of text."""
    return xxhash.xxh64_intdigest(f"{path}\n{text}") >> 1


def nested_classes(tokens: list[dict]) -> list[list[dict]]:
    """The valid classes of a host's supported tokens (path, text, s1, s2, pages, total, chars), outer ones first.

    ``text`` names a block of text and is null for an element.
    """
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for t in tokens:
        if t["total"] == t["pages"]:  # what stands several times a page is an item of a list
            classes[t["pages"], t["s1"], t["s2"]].append(t)
    placed: list[list[dict]] = []
    slots: set[str] = set()
    for _, members in sorted(classes.items(), key=lambda c: (-c[0][0], min((t["path"].count("/"), t["path"]) for t in c[1]), c[0])):
        inside = set()
        for t in members:
            above = t["path"] if t["text"] is not None else t["path"].rpartition("/")[0]
            while above and above not in slots:
                above = above.rpartition("/")[0]
            inside.add(above)
        if len(inside) == 1 or not placed:
            placed.append(members)
            slots.update(t["path"] for t in members if t["text"] is None)
    return placed


def own_texts(valid: list[list[dict]]) -> list[dict]:
    """The blocks of text of valid classes that are in one class with the innermost element of the template around them."""
    of = {t["path"]: k for k, members in enumerate(valid) for t in members if t["text"] is None}
    out = []
    for k, members in enumerate(valid):
        for t in members:
            path = t["path"]
            if t["text"] is None or t["pages"] < TEXT_PAGES or any(part.partition(".")[0] in MAIN for part in path.split("/")):
                continue
            while path and path not in of:
                path = path.rpartition("/")[0]
            if path and of[path] == k:
                out.append(t)
    return out


def main_slot(elements: list[dict], data: dict[str, int]) -> str:
    """Of the template's elements, from the outermost in, the deepest that has the wanted share of the data; an article or main element ends the search."""
    every = max(data.values(), default=0)
    best = ""
    for path in sorted((t["path"] for t in elements), key=lambda p: (p.count("/"), p)):
        name = path.rpartition("/")[2].partition(".")[0]
        inside = not best or path.startswith(best + "/")
        if inside and name not in TEXTS and data[path] >= SHARE * every and every > 0:
            best = path
            if name in MAIN:
                break
    return best


def template(tokens: list[dict]) -> tuple[str, list[int]]:
    """The main slot's path, and the names of the texts that are a host's own."""
    valid = nested_classes(tokens)
    elements = [t for members in valid for t in members if t["text"] is None]
    texts = own_texts(valid)
    all_of = {t["path"]: t["chars"] for t in tokens if t["text"] is None}
    data = dict(all_of)
    for t in texts:
        path = t["path"]
        while path:
            data[path] = data.get(path, 0) - t["chars"]
            path = path.rpartition("/")[0]
    slot = main_slot(elements, data)
    if sum(t["chars"] for t in texts if _within(t["path"], slot)) > data.get(slot, 0):
        return main_slot(elements, all_of), []
    return slot, sorted(t["text"] for t in texts)


def _within(path: str, slot: str) -> bool:
    return not slot or path == slot or path.startswith(slot + "/")


def main_text(page: Page, slot: str | None, fixed: frozenset[int] = frozenset()) -> str:
    """The data in a page's main slot; without one of that path, of the one its own tree gives."""
    masses = page.masses()
    if slot is None or (slot and slot not in page.counts) or not masses.get(slot, 1 if not slot else 0):
        own = [{"path": p, "text": None, "s1": n, "s2": 0, "pages": 1, "total": n, "chars": masses.get(p, 0)} for p, n in page.counts.items()]
        slot, _ = template(own)
    articles = [p for p in page.counts if _within(p, slot) and p.rpartition("/")[2].partition(".")[0] in MAIN and masses.get(p, 0)]
    shortest = [p for p in articles if not any(q != p and _within(p, q) for q in articles)]
    kept = []
    for path, furniture, linked, text in page.blocks:
        if furniture or not _within(path, slot) or (shortest and not any(_within(path, a) for a in shortest)):
            continue
        if not shortest and linked >= len(text) and "/li" in path:  # a menu that nothing names
            continue
        if not fixed or text_name(path, text) not in fixed:
            kept.append(text)
    return "\n\n".join(kept)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, slot, fixed): the main slot and the names of the template's texts of every host of more than one page."""

    names = ("host", "path", "text", "s1", "s2", "pages", "total", "chars")

    @tidied
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 2 + [pa.int64()] * 6
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for host, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py()
                page = Page(text_of(body))
                key = xxhash.xxh64_intdigest(body).to_bytes(8, "little")
                found: dict[tuple, list[int]] = {("", None): [1, 0]}
                for path, chars in page.masses().items():
                    found[path, None] = [0, chars]
                for path, n in page.counts.items():
                    found.setdefault((path, None), [0, 0])[0] = n
                for path, furniture, linked, text in page.blocks:
                    row = found.setdefault((path, text_name(path, text)), [0, 0])
                    row[0] += 1
                    row[1] += 0 if furniture else max(0, len(text) - linked)
                for (path, text), (n, chars) in found.items():
                    h = xxhash.xxh64_intdigest(key + n.to_bytes(4, "little"))
                    row = sums.setdefault((host, path, text), [0] * 5)
                    for i, x in enumerate((h & 0xFFFFFFFF, h >> 32, 1, n, chars)):
                        row[i] += x
            columns = list(zip(*((*k, *v) for k, v in sums.items()), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    body = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(host_of(F.col(url_col)).alias("host"), body.alias("body"))
    summed = ("s1", "s2", "pages", "total", "chars")
    schema = "host string, path string, text long, " + ", ".join(f"{c} long" for c in summed)
    found = rows.mapInArrow(tokens, schema).groupBy("host", "path", "text").agg(*(F.sum(c).alias(c) for c in summed))
    found = staged(found.where("pages > 1"), "tokens")
    sizes = found.where("path = '' and text is null").select("host", F.col("pages").alias("of"))
    enough = F.col("text").isNull() | (F.col("pages") >= TEXT_PAGES)
    supported = found.where("path != ''").where(enough).join(sizes, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    listed = supported.groupBy("host").agg(F.collect_list(F.struct("path", "text", *summed)).alias("tokens"))  # as many as a few pages have

    @F.arrow_udf("struct<slot:string,fixed:array<bigint>>")
    def deduce(column: pa.Array) -> pa.Array:
        slots, fixed = zip(*map(template, column.to_pylist()), strict=True) if len(column) else ((), ())
        return pa.StructArray.from_arrays([pa.array(slots, pa.string()), pa.array(fixed, pa.list_(pa.int64()))], ["slot", "fixed"])

    return staged(listed.select("host", deduce("tokens").alias("t")).select("host", "t.slot", "t.fixed"), "templates")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``main_text``; all other columns and rows as they are."""
    found = templates(pages, url_col, html_col)
    host, slot, fixed = (unused(n, pages) for n in ("host", "slot", "fixed"))
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("slot") + 8 * F.size("fixed"))).first()[0] or 0
    side = F.broadcast(found) if size <= FEW_BYTES else found

    @F.arrow_udf("string")
    @tidied
    def text(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, slots, texts in columns:
            out = []
            for b, s, t in zip(bodies, slots.to_pylist(), texts, strict=True):
                known = frozenset(t.values.to_pylist()) if t.is_valid and len(t) else frozenset()
                out.append(main_text(Page(text_of(b.as_py())), s, known))
            yield pa.array(out, pa.string())

    own = side.select(F.col("host").alias(host), F.col("slot").alias(slot), F.col("fixed").alias(fixed))
    joined = pages.join(own, host_of(F.col(url_col)) == F.col(host), "left")
    body = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    kept = [c for c in pages.columns if c != "main_text"]
    return joined.select(*kept, text(body, F.col(slot), F.col(fixed)).alias("main_text"))
