"""Pages of acts: a tree of each page, selection by simple selectors, and the row of fields that a page gives.

Pages are handed over as Arrow batches and parsed one by one; the tree keeps what the mark-up says, without the repairs of a browser:
an end tag closes the nearest open element of its name, or nothing. Selectors are names, ``#id`` and ``.class``, put together
by a blank (anywhere below) or ``>`` (directly below).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.staging import arrow

VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
#: Elements whose text is no text of the page.
SILENT = frozenset(("script", "style", "template"))
RAW_TEXT = frozenset(("script", "style"))

# Where the parts of a page stand, and the labels of its details by field.
DETAILS = "#article-details-scroll > table.detailsTable > tbody"
TITLE = "#sticky > h2"
BODY = "#html-content-frame > div.sl-content > div.doc > div.article-column"
FIELDS = {
    "dio": "Dio NN:", "vrsta": "Vrsta dokumenta:", "brojDokumenta": "Broj dokumenta u izdanju:", "stranica": "Stranica tiskanog izdanja:",
    "donositelj": "Donositelj:", "datum": "Datum tiskanog izdanja:",
}
LINKS = {"izdanje": "Izdanje:", "eli": "ELI:"}
NAMES = ("dio", "vrsta", "izdanje", "izdanjeUrl", "brojDokumenta", "stranica", "donositelj", "datum", "eli", "eliUrl", "naslov", "doc")
#: Why a page gives no row.
REFUSALS = ("no details", "link without address", "no title", "no identifier")


class Element:
    """An element of a page; children are elements, texts, or pairs of a kind and the text of comments and declarations."""

    __slots__ = ("name", "attributes", "parent", "children")

    def __init__(self, name: str, attributes: dict[str, str], parent: Element | None):
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []

    def below(self) -> Iterator[Element]:
        """All elements below this one, in the order of the page."""
        rest = [c for c in reversed(self.children) if isinstance(c, Element)]
        while rest:
            found = rest.pop()
            yield found
            rest += [c for c in reversed(found.children) if isinstance(c, Element)]

    def texts(self) -> Iterator[str]:
        rest: list = [iter(self.children)]
        while rest:
            child = next(rest[-1], None)
            if child is None:
                rest.pop()
            elif isinstance(child, str):
                yield child
            elif isinstance(child, Element) and child.name not in SILENT:
                rest.append(iter(child.children))

    def text(self) -> str:
        return "".join(self.texts())

    def stripped(self) -> str:
        """The texts without white space at their ends, put together."""
        return "".join(t.strip() for t in self.texts())

    def markup(self) -> str:
        """The element as mark-up: texts and values with the three reserved characters as references."""
        out: list[str] = []
        rest: list = [self]
        while rest:
            now = rest.pop()
            if isinstance(now, tuple) and now[0] == "raw":
                out.append(now[1])
            elif isinstance(now, tuple):
                out.append(f"<!--{now[1]}-->" if now[0] == "comment" else f"<!{now[1]}>")
            elif isinstance(now, str):
                out.append(_escaped(now))
            else:
                start = "".join([f"<{now.name}", *[f" {k}={_quoted(v)}" for k, v in now.attributes.items()]])
                if now.name in VOID:
                    out.append(start + "/>")
                    continue
                out.append(start + ">")
                rest.append(("raw", f"</{now.name}>"))
                rest += [("raw", c) if isinstance(c, str) and now.name in RAW_TEXT else c for c in reversed(now.children)]
        return "".join(out)


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _quoted(value: str) -> str:
    value = _escaped(value)
    if '"' not in value:
        return f'"{value}"'
    return f"'{value}'" if "'" not in value else '"' + value.replace('"', "&quot;") + '"'


class _Builder(HTMLParser):
    def __init__(self, mark: str | None = None):
        """With a mark, what it stands for in the page is an ampersand that begins no reference."""
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.open: dict[str, int] = {}
        self.mark = mark

    def _read(self, text: str) -> str:
        return text.replace(self.mark, "&") if self.mark else text

    def handle_starttag(self, tag, attrs):
        own = {self._read(k): self._read(v or "") for k, v in attrs}
        if "class" in own:
            own["class"] = " ".join(own["class"].split())
        new = Element(self._read(tag), own, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new
            self.open[new.name] = self.open.get(new.name, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        tag = self._read(tag)
        if not self.open.get(tag):
            return
        while True:
            name, self.at = self.at.name, self.at.parent
            self.open[name] -= 1
            if name == tag:
                return

    def handle_data(self, data):
        data, own = self._read(data), self.at.children
        if own and isinstance(own[-1], str):
            own[-1] += data
        else:
            own.append(data)

    def handle_comment(self, data):
        self.at.children.append(("comment", self._read(data)))

    def handle_decl(self, decl):
        self.at.children.append(("declaration", self._read(decl)))


#: An ampersand that begins no reference with a semicolon at its end.
_OPEN = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


def tree(page: str, closed: bool = False) -> Element:
    """The root of a page; its children are what stands outermost. Browsers read some references without a semicolon as well (``&amp`` as ``&``);
    closed: only those that end in one are references, and others stay as they stand."""
    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in page) if closed and _OPEN.search(page) else None
    builder = _Builder(mark)
    builder.feed(_OPEN.sub(mark, page) if mark else page)
    builder.close()
    return builder.root


def _fits(element: Element, simple: str) -> bool:
    for mark, word in re.findall(r"([#.]?)([^#.]+)", simple):
        if mark == "#" and element.attributes.get("id") != word or mark == "." and word not in element.attributes.get("class", "").split(" ") or not mark and element.name != word:
            return False
    return True


def _reached(element: Element | None, steps: list[str], root: Element) -> bool:
    """Does the element end the steps (simple selectors, and ``>`` where a step goes one level)?"""
    if element is None or element is root or not _fits(element, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    if steps[-2] == ">":
        return _reached(element.parent, steps[:-2], root)
    above = element.parent
    while above is not None and above is not root:
        if _reached(above, steps[:-1], root):
            return True
        above = above.parent
    return False


def select(root: Element, selector: str) -> Iterator[Element]:
    """The elements below root that the selector names, in the order of the page."""
    steps = selector.replace(">", " > ").split()
    return (e for e in root.below() if _reached(e, steps, root))


def first(root: Element, selector: str) -> Element | None:
    return next(select(root, selector), None)


def _plain(text: str) -> str:
    return text.replace("\xa0", " ")


def _cell(details: Element, label: str) -> Element | None:
    """The first cell of the first row whose first cell holds the label; no-break spaces count as blanks there."""
    for row in select(details, "tr"):
        cell = first(row, "td")
        if cell is not None and label in _plain(cell.text()):
            return cell
    return None


def _without(label: str, text: str) -> str:
    return re.sub(re.escape(label).replace(r"\ ", "[ \xa0]"), "", text)


def field_of(details: Element, label: str) -> str | None:
    """What the label's cell says beside the label; null without such a cell."""
    cell = _cell(details, label)
    return None if cell is None else _without(label, cell.stripped()).strip()


def link_of(details: Element, label: str) -> tuple[str | None, str | None]:
    """(text, address) of the first link in the label's cell; without a link the cell's text, or null where it is blank.
    A link without an address is an error (KeyError)."""
    cell = _cell(details, label)
    if cell is None:
        return None, None
    anchor = first(cell, "a")
    if anchor is not None:
        return anchor.stripped(), anchor.attributes["href"]
    return _plain(_without(label, cell.stripped())).strip() or None, None


def row_of(page: str | None) -> dict[str, str | None]:
    """The fields of one page by name, or under `refused` why it gives none."""
    root = tree(page or "")
    details = first(root, DETAILS)
    if details is None:
        return {"refused": REFUSALS[0]}
    out: dict[str, str | None] = {name: field_of(details, label) for name, label in FIELDS.items()}
    for name, label in LINKS.items():
        try:
            out[name], out[name + "Url"] = link_of(details, label)
        except KeyError:
            return {"refused": REFUSALS[1]}
    title = first(root, TITLE)
    if title is None:
        return {"refused": REFUSALS[2]}
    if not out["eli"] and not out["eliUrl"]:
        return {"refused": REFUSALS[3]}
    body = first(root, BODY)
    return out | {"naslov": title.stripped(), "doc": None if body is None else body.markup()}


def fields(html: Column) -> Column:
    """A struct of the twelve fields of a page and `refused`, which says why it gives none (null for a row)."""
    names = [*NAMES, "refused"]

    @arrow(", ".join(f"{n}: string" for n in names).join(("struct<", ">")))
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([row_of(p) for p in pages.to_pylist()], pa.struct([(n, pa.string()) for n in names]))

    return run(html)


def field(html: Column, label: str, table: str = DETAILS) -> Column:
    """What the label's cell of a table says beside the label; null without a table or a cell."""

    @arrow("string")
    def run(pages: pa.Array) -> pa.Array:
        found = (first(tree(p or ""), table) for p in pages.to_pylist())
        return pa.array([None if e is None else field_of(e, label) for e in found], pa.string())

    return run(html)


def outcomes(df: DataFrame, html: str = "html") -> DataFrame:
    """df with the fields of each page and `refused`. Pages are parsed once."""
    rest = [c for c in df.columns if c not in (*NAMES, "refused", html)]
    return df.withColumn("__row", fields(F.col(html))).select(*rest, "__row.*")


def rows(df: DataFrame, html: str = "html") -> DataFrame:
    """df with the fields of each page, for pages that give a row."""
    return outcomes(df, html).where("refused is null").drop("refused")


def markup_of(html: Column, selector: str, closed: bool = False) -> Column:
    """The mark-up of the first element that the selector names; null without one. closed: as in tree()."""

    @arrow("string")
    def run(pages: pa.Array) -> pa.Array:
        found = (first(tree(p or "", closed), selector) for p in pages.to_pylist())
        return pa.array([None if e is None else e.markup() for e in found], pa.string())

    return run(html)


def text_of(html: Column, selector: str, closed: bool = False) -> Column:
    """The text of the first element that the selector names, each piece without white space at its ends; null without one. closed: as in tree()."""

    @arrow("string")
    def run(pages: pa.Array) -> pa.Array:
        found = (first(tree(p or "", closed), selector) for p in pages.to_pylist())
        return pa.array([None if e is None else e.stripped() for e in found], pa.string())

    return run(html)
