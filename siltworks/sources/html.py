"""A flat view of an HTML page: its elements in document order, each with the range of elements and texts inside it."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

# Elements without content, and start tags that end an open element of the given kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",)),
}
#: An implied end does not reach beyond one of these.
SCOPES = frozenset("html body article section div table ul ol dl header main td th a button".split())


@dataclass
class Element:
    page: Page
    tag: str
    attrs: dict[str, str]
    at: int
    parent: Element | None
    first_text: int
    end: int = -1
    end_text: int = -1

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    @property
    def text(self) -> str:
        return "".join(self.page.texts[self.first_text : self.end_text])

    def inside(self) -> list[Element]:
        return self.page.elements[self.at + 1 : self.end]

    def all(self, tag: str | None = None, test=None) -> list[Element]:
        return [e for e in self.inside() if (tag is None or e.tag == tag) and (test is None or test(e))]

    def first(self, tag: str | None = None, test=None) -> Element | None:
        return next((e for e in self.inside() if (tag is None or e.tag == tag) and (test is None or test(e))), None)

    def up(self, test) -> Element | None:
        """The element itself or its nearest ancestor that passes."""
        e: Element | None = self
        while e is not None and not test(e):
            e = e.parent
        return e

    def is_last_child(self) -> bool:
        return self.parent is not None and self.end == self.parent.end

    def link(self, name: str) -> str:
        """An attribute that is a URL, resolved; empty if missing or empty."""
        value = (self.attrs.get(name) or "").strip()
        return urljoin(self.page.url, value) if value else ""


@dataclass
class Page:
    url: str
    elements: list[Element] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def all(self, tag: str | None = None, test=None) -> list[Element]:
        return [e for e in self.elements if (tag is None or e.tag == tag) and (test is None or test(e))]


class _Builder(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.page, self.open = Page(url), []

    def _close(self, upto: int) -> None:
        for e in self.open[upto:]:
            e.end, e.end_text = len(self.page.elements), len(self.page.texts)
        del self.open[upto:]

    def handle_starttag(self, tag, attrs):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in ENDS.get(tag, ()):
                self._close(i)
                break
            if self.open[i].tag in SCOPES:
                break
        page = self.page
        e = Element(page, tag, {k: v or "" for k, v in reversed(attrs)}, len(page.elements), self.open[-1] if self.open else None, len(page.texts))
        page.elements.append(e)
        self.open.append(e)
        if tag in VOID:
            self._close(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return

    def handle_data(self, data):
        self.page.texts.append(data)


def parse(html: str | None, url: str | None) -> Page:
    builder = _Builder(url or "")
    builder.feed(html or "")
    builder.close()
    builder._close(0)
    return builder.page
