"""One small Python helper: HTML to a flat array of elements. All structure is worked out in Spark from it."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENT = "struct<tag:string,text:string,attrs:map<string,string>,heading:string,near:string,label:string,kept:boolean,begin:int,until:int,parent:int,depth:int,fields:array<int>>"
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FIELDS = {"input", "select", "textarea", "button"}
_WANTED = _HEADINGS | _FIELDS | set("p ul ol li table tr th td form label a title meta body".split())
_DROPPED = set("script style nav header footer noscript".split())
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: A new element of the first kind ends an open one of the second.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS = set("ul ol table form div section article h1 h2 h3 h4 h5 h6".split())
_SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Elements that hold others in a span: lists their items, tables their rows, rows their cells.
_HOLDS = {"ul": "li", "ol": "li", "table": "tr", "tr": "cell"}
_COUNTED = {"li": "li", "tr": "tr", "td": "cell", "th": "cell"}
#: A box of fields that is no form is looked for among so many ancestors.
_UP = 5
#: Elements, and characters of their texts, that a task holds before it hands them to Spark; a larger page is held alone.
HELD, HELD_CHARS = 20_000, 8_000_000


#: Elements whose own text is used, and those that are told the heading and the text before them.
_TEXTS = _HEADINGS | {"p", "li", "th", "td", "a", "label", "title", "body"}
_PLACED = {"ul", "ol", "table"}
#: The open elements that a new one may end, and elements that tell what is inside of them.
_ENDS, _INSIDE = {t: {"p"} for t in _BLOCKS} | _CLOSES, {"form", "label", "head"}
#: Pages of text and plain tags only, which one pattern cuts as HTMLParser does; others, as those with elements whose content is no HTML, go to HTMLParser.
_TOKEN = re.compile(r'([^<&]*+)(?:<(/?)([a-z][a-z0-9]*+)([^<>]*+)>)?+')
_PLAIN = re.compile(r'(?:[^<&]++|</[a-z][a-z0-9]*+>|<title>[^<&]*+</title>|<(?!(?:title|script|style|textarea|iframe|noembed|noframes|noscript|xmp|plaintext)[ >])[a-z][a-z0-9]*+(?: [a-z][a-z0-9-]*+="[^"<>&]*+")*+>)*+')
_ATTRS = re.compile(r' ([a-z][a-z0-9-]*+)="([^"]*+)"')


class _Row:
    """An element; what is set only for some kinds of elements has its value for the others here."""

    attrs: dict[str, str] = {}
    parent = depth = None
    json = False
    begin = until = 0
    #: The form, the box and the label around what it holds, and whether that is in the head; `over` is the same around itself.
    inside: tuple = (None, None, None, False)


class _Elements(HTMLParser):
    """Keeps the open elements as a stack and the text once, as parts that elements refer to by place."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[_Row] = []
        self.open: list[_Row] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.said: list[str] = []
        self.raw: list[str] = []
        self.seen: Counter = Counter()
        self.trail: list[tuple[int, int]] = []
        self.count, self.heading, self.near, self.dropped = 0, "", "", 0

    def read(self, page: str) -> list[tuple]:
        """The elements of a page, in the order of ELEMENT's fields."""
        if not _PLAIN.fullmatch(page):
            self.feed(page)
            return self.finish()
        for data, end, tag, attrs in _TOKEN.findall(page):
            if data:
                self.handle_data(data)
            if end:
                self.handle_endtag(tag)
            elif tag:
                self.handle_starttag(tag, _ATTRS.findall(attrs) if attrs else [])
        return self.finish()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS:
            scope = -1
            for s in _SCOPES.get(tag, ()):
                if self.places[s] and self.places[s][-1] > scope:
                    scope = self.places[s][-1]
            ended = [at[k] for e in _ENDS[tag] if (at := self.places[e]) and (k := bisect_right(at, scope)) < len(at)]
            if ended:
                self._close(min(ended))
        over = self.open[-1].inside if self.open else _Row.inside
        kept = not self.dropped and tag not in _DROPPED
        row = _Row()
        row.ord, row.tag, row.kept, row.over, row.inside, row.said, row.raw = self.count, tag, kept, over, over, len(self.said), len(self.raw)
        boxed = False
        if attrs:
            row.attrs = values = {k: v or "" for k, v in attrs}
            row.json = values.get("type") == "application/ld+json"
            boxed = tag in ("div", "section") and "form" in values.get("class", "") + (values.get("id", "") if tag == "div" else "")
        if boxed or tag in _INSIDE:
            form, box, label, head = over
            boxed = boxed or tag == "form"
            row.inside = (self.count if tag == "form" else form, self.count if boxed else box, self.count if tag == "label" else label, head or tag == "head")
        if tag in _PLACED or tag in _FIELDS:
            row.heading, row.near = self.heading, self.near
        if tag in _FIELDS:
            row.ups = [e.ord for e in self.open[: -_UP - 1 : -1]]
        if tag in _HOLDS:
            row.begin = self.seen[_HOLDS[tag]]
        self.count += 1
        if kept and tag in _COUNTED:
            self.seen[_COUNTED[tag]] += 1
        if kept and tag in _HEADINGS:
            while self.trail and self.trail[-1][0] >= int(tag[1]):
                self.trail.pop()
            row.parent, row.depth = self.trail[-1][1] if self.trail else None, len(self.trail) + 1
            self.trail.append((int(tag[1]), self.seen["heading"]))
            self.seen["heading"] += 1
        if tag in _WANTED or row.json or boxed:
            self.rows.append(row)
        if tag in _VOID:
            self._end(row)
        else:
            self.places[tag].append(len(self.open))
            self.open.append(row)
            self.dropped += tag in _DROPPED

    def handle_endtag(self, tag: str) -> None:
        if self.places[tag]:
            self._close(self.places[tag][-1])

    def _end(self, row: _Row) -> None:
        if row.tag in _HOLDS:
            row.until = self.seen[_HOLDS[row.tag]]
        row.said_end, row.raw_end = len(self.said), len(self.raw)

    def _close(self, i: int) -> None:
        while len(self.open) > i:
            row = self.open.pop()
            self.places[row.tag].pop()
            self._end(row)
            self.dropped -= row.tag in _DROPPED
            if row.tag in _HEADINGS and row.kept:
                self.heading = self._text(row) or self.heading

    def _text(self, row: _Row) -> str:
        parts = self.raw[row.raw : row.raw_end] if row.json or row.tag == "title" else self.said[row.said : row.said_end]
        return "".join(parts).strip()

    def handle_data(self, data: str) -> None:
        self.raw.append(data)
        if not self.dropped:
            self.said.append(data)
            if data.strip():
                self.near = data.strip()[:500]

    def finish(self) -> list[tuple]:
        self.close()
        self._close(0)
        labels = [(r, self._text(r)) for r in self.rows if r.tag == "label"]
        around = {r.ord: text for r, text in labels}
        pointed = {r.attrs["for"]: text for r, text in reversed(labels) if r.kept and "for" in r.attrs}
        out = []
        for r in self.rows:
            label = pointed.get(r.attrs.get("id"), around.get(r.over[2])) if r.tag in _FIELDS else None
            tag = "json" if r.json else ("head " + r.tag if r.tag in ("title", "meta") and r.over[3] else r.tag)
            heading, near = (r.heading, r.near) if r.tag in _PLACED else (None, None)
            text = self._text(r) if r.json or r.tag in _TEXTS else ""
            out.append((tag, text, r.attrs, heading, near, label, r.kept, r.begin, r.until, r.parent, r.depth, None))
        return out + self._boxes()

    def _boxes(self) -> list[tuple]:
        """One element `fields` for each box, in the order of their first fields, with the places of its fields among all of them."""
        fields = [r for r in self.rows if r.tag in _FIELDS and r.kept and not r.json and (r.tag != "button" or r.attrs.get("type") == "submit")]
        near = Counter(u for f in fields for u in f.ups)
        inside: dict[int, list[int]] = defaultdict(list)
        for i, f in enumerate(fields):
            form, boxed = f.over[:2]
            around = boxed if form is None else form
            box = around if around is not None else next((u for u in f.ups if near[u] >= 2), None)
            if box is not None:
                inside[box].append(i)
        attrs = {r.ord: r.attrs for r in self.rows}
        first = lambda own: fields[own[0]]
        return [("fields", "", attrs.get(box, {}), first(own).heading, first(own).near, None, True, 0, 0, None, None, own) for box, own in inside.items()]


_ARROW = pa.list_(pa.struct([
    ("tag", pa.string()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("heading", pa.string()), ("near", pa.string()), ("label", pa.string()),
    ("kept", pa.bool_()), ("begin", pa.int32()), ("until", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("fields", pa.list_(pa.int32())),
]))
ELEMENT_NAMES = [f.name for f in _ARROW.value_type]


def _ends(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())


def _array(held: list[list[tuple]]) -> pa.Array:
    """The elements of some pages, column by column."""
    rows = [row for page in held for row in page]
    columns = dict(zip(ELEMENT_NAMES, zip(*rows))) if rows else dict.fromkeys(ELEMENT_NAMES, ())
    attrs = columns.pop("attrs")
    made = {name: pa.array(columns[name], _ARROW.value_type.field(name).type) for name in columns}
    made["attrs"] = pa.MapArray.from_arrays(_ends([len(x) for x in attrs]), pa.array([k for x in attrs for k in x], pa.string()), pa.array([v for x in attrs for v in x.values()], pa.string()))
    return pa.ListArray.from_arrays(_ends([len(page) for page in held]), pa.StructArray.from_arrays([made[name] for name in ELEMENT_NAMES], fields=list(_ARROW.value_type)))


def _lots(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The elements of each page, in lots of about HELD elements."""
    for pages in batches:
        held, n, chars = [], 0, 0
        for page in pages:
            held.append(_Elements().read(page.as_py() or ""))
            n, chars = n + len(held[-1]), chars + sum([len(e[1]) for e in held[-1]])
            if n >= HELD or chars >= HELD_CHARS:
                yield _array(held)
                held, n, chars = [], 0, 0
        if held:
            yield _array(held)


def elements(html: Column | str) -> Column:
    """The elements of interest of each page, in order, then one element `fields` for each box of form fields.

    kept is false inside script, style, nav, header, footer and noscript, whose text counts nowhere. heading is
    the nearest heading before a list, table or box, near the nearest text before it; the text is that of headings, paragraphs, items, cells, links, labels, titles, JSON and the body. begin and until tell which of the
    page's kept items (of a list), rows (of a table) or cells (of a row) lie inside; parent and depth are a
    heading's among all kept headings. Null html has no elements. The time is linear in the page and the texts that come out;
    elements leave in lots of about HELD, so that a task's memory follows the largest page, not the number of pages in a batch.
    """

    @F.arrow_udf(f"array<{ELEMENT}>")
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _lots(batches)

    return parse(F.col(html) if isinstance(html, str) else html)
