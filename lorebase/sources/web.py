"""Structure of web pages: main text, title, description and links.

Tags are read by the standard tokenizer in Arrow batches, one pass over a page; what
belongs to an element is told by the depth of tags of its name, so that pages with
tags left open or closed twice have a defined result.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from lorebase.functions.patterns import in_slices

#: Elements whose text is not shown, and elements that are lines of their own (fixed values of the HTML standard).
HIDDEN = frozenset("script style noscript template head title textarea select iframe object svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Parts of a page in the order in which they are asked for the main text.
PARTS = ("article", "main", "role", "body")
MAIN_CHARS = 500


class _Page(HTMLParser):
    """Text parts of a page, and for the first element of each of ``PARTS`` where it starts and ends among them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.spans: dict[str, list] = {}
        self.open: dict[str, tuple[str, int]] = {}
        self.depth: dict[str, int] = {}
        self.hidden: list[str] = []
        self.titles: list[str] = []
        self.in_title = False
        self.title: str | None = None
        self.description: str | None = None
        self.links: list[tuple[str, int, int]] = []
        self.anchor: tuple[str, int] | None = None

    def _end_anchor(self):
        if self.anchor:
            self.links.append((self.anchor[0], self.anchor[1], len(self.parts)))
            self.anchor = None

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in reversed(attrs)}  # of equal attributes the first counts
        if tag == "meta" and self.description is None and own.get("name") == "description":
            self.description = own.get("content", "")
        if tag == "body":
            self.hidden.clear()
        if tag == "title" and self.title is None and "svg" not in self.hidden:
            self.in_title = True
        if self.hidden:
            if tag in HIDDEN:
                self.hidden.append(tag)
            return
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag in HIDDEN:
            self.hidden.append(tag)
            return
        for part in PARTS:
            if part not in self.spans and (own.get("role") == "main" if part == "role" else tag == part):
                self.spans[part] = [len(self.parts), None]
                if tag not in VOID:
                    self.open[part] = tag, self.depth.get(tag, 0)
                else:
                    self.spans[part][1] = len(self.parts)
        if tag not in VOID:
            self.depth[tag] = self.depth.get(tag, 0) + 1
        if tag == "a":
            self._end_anchor()  # anchors don't nest
            if "href" in own:
                self.anchor = own["href"].strip(), len(self.parts)

    def handle_endtag(self, tag):
        if tag == "title" and self.in_title:
            self.in_title, self.title = False, "".join(self.titles)
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
            return
        if self.hidden:
            return
        if tag in BLOCKS:
            self.parts.append("\n")
        if self.depth.get(tag, 0):
            self.depth[tag] -= 1
            for part in [p for p, (name, depth) in self.open.items() if name == tag and depth == self.depth[tag]]:
                self.spans[part][1] = len(self.parts)
                del self.open[part]
        if tag == "a":
            self._end_anchor()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash says nothing about elements that have content

    def handle_data(self, data):
        if self.in_title:
            self.titles.append(data)
        elif not self.hidden:
            # Line ends of the source are blanks.
            self.parts.append(" ".join(f"|{data}|".split())[1:-1])

    def shown(self, start: int, end: int | None) -> str:
        lines = (" ".join(line.split()) for line in "".join(self.parts[start:end]).split("\n"))
        return "\n".join(line for line in lines if line)


def outline_of(html: str | None) -> dict:
    """What ``outline`` gives for one page."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page._end_anchor()
    title = " ".join((page.title if page.title is not None else "".join(page.titles)).split())
    description = (page.description or "").strip()
    body = page.shown(*page.spans["body"]) if "body" in page.spans else page.shown(0, None)
    part, content = "body", body
    for p in PARTS[:-1]:
        if p in page.spans and len(text := page.shown(*page.spans[p])) > MAIN_CHARS:
            part, content = p, text
            break
    return {
        "title": title,
        "description": description,
        "part": part,
        "content": content,
        "text": "\n\n".join(x for x in (title, description, content) if x),
        "links": [{"url": u, "text": page.shown(a, b).replace("\n", " ")} for u, a, b in page.links if u],
    }


_LINK = pa.struct([("url", pa.string()), ("text", pa.string())])
_OUTLINE = pa.struct([("title", pa.string()), ("description", pa.string()), ("part", pa.string()), ("content", pa.string()), ("text", pa.string()), ("links", pa.list_(_LINK))])


def outline(html: Column, *fields: str) -> Column:
    """A struct of ``title, description, part, content, text, links`` of a page, or of those of them that are asked for.

    * ``content`` is the shown text of the first ``article``, ``main`` or element of role
      ``main``, in this order, with more than 500 characters, else that of ``body``;
      ``part`` tells which (``role`` for the third). Without a ``body`` tag the whole page is one.
    * Shown text has no scripts, styles, head or comments, a line for each block or
      row, single blanks, and no empty lines. An element ends where the end tags of its name
      make up for the start tags since its own, or with the page.
    * ``text`` is title, description and content, those that aren't empty, with an empty line between.
    * ``links`` are the anchors with an address, in order, repeats included; an anchor ends at the next one.
    * Null and empty pages have empty texts and no links. A page is held whole in its task.
    """

    kinds = {f.name: f.type for f in _OUTLINE if not fields or f.name in fields}
    kind = pa.struct(list(kinds.items()))

    @F.arrow_udf(from_arrow_type(kind))
    def read(pages: pa.Array) -> pa.Array:
        return in_slices(pages, lambda own: pa.array([{k: v for k, v in outline_of(x).items() if k in kinds} for x in own], kind))

    return read(html)
