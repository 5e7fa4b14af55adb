"""Text of HTML fragments: a small tree on html.parser, and selectors."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Opening one of these closes an open element of the others named.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)

    def elements(self):
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if not isinstance(x, str):
                yield x
                todo.extend(reversed(x.children))


class _Builder(HTMLParser):
    def __init__(self, mark: str = "&") -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#fragment", {}, None)
        self.mark = mark  # stands for "&" where it begins no reference

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, {"p"} if tag in _BLOCKS else set())
        if self.at.tag in closes:
            self.at = self.at.parent
        if tag in ("html", "head", "body"):  # a fragment has none
            return
        e = Element(tag, {k: (v or "").replace(self.mark, "&") for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data.replace(self.mark, "&"))


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def parse(html: str, bare_references: bool = True) -> Element:
    """Without bare_references, those that no semicolon ends (&amp, as where a text was cut) stay as they are; HTML reads them too."""
    b = _Builder()
    if not bare_references and "&" in html:
        b = _Builder(next(c for c in map(chr, range(0xF0000, 0x10FFFE)) if c not in html))
        html = _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else b.mark + m[0][1:], html)
    b.feed(html)
    b.close()
    return b.root


_PART = re.compile(r"(\*|[\w-]+)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*)?\]")


class Selector:
    """A list of selectors: tags, *, #id, .class, [attribute] with =, ~=, ^=, $=, *=, |=, descendant and child steps."""

    def __init__(self, source: str) -> None:
        self.any = [self._steps(s.strip()) for s in source.split(",") if s.strip()]
        if not self.any:
            raise ValueError(f"no selector in {source!r}")

    @staticmethod
    def _steps(source: str):
        steps, child = [], False
        for word in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", source):
            if word == ">":
                child = True
                continue
            at, tests = 0, []
            while at < len(word):
                m = _PART.match(word, at)
                if not m:
                    raise ValueError(f"selector not understood: {source!r}")
                tests.append(m.groups())
                at = m.end()
            steps.append((child, tests))
            child = False
        return steps

    @staticmethod
    def _fits(e: Element, tests) -> bool:
        for tag, id, cls, name, op, *values in tests:
            if tag and tag != "*" and e.tag != tag.lower() or id and e.attrs.get("id") != id or cls and cls not in e.attrs.get("class", "").split():
                return False
            if name:
                have = e.attrs.get(name.lower())
                want = next((v for v in values if v is not None), "")
                if have is None or op and not {"=": have == want, "~=": want in have.split(), "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have, "|=": have == want or have.startswith(want + "-")}[op]:
                    return False
        return True

    def matches(self, e: Element) -> bool:
        return any(self._match(e, steps, len(steps) - 1) for steps in self.any)

    def _match(self, e: Element, steps, k: int) -> bool:
        child, tests = steps[k]
        if not self._fits(e, tests):
            return False
        if k == 0:
            return True
        p = e.parent
        while p is not None and p.parent is not None:
            if self._match(p, steps, k - 1):
                return True
            if child:
                return False
            p = p.parent
        return False


def _drop(root: Element, gone) -> None:
    for e in [e for e in root.elements() if gone(e)]:
        e.parent.children[:] = [c for c in e.parent.children if c is not e]


def stripper(anchor_patterns=(), anchor_selector: str = "a, img", dom=(), case_sensitive: bool = True, bare_references: bool = True):
    """A function from HTML to its text, without what the selectors of dom pick and without anchors whose text holds a pattern."""
    anchors, doms = Selector(anchor_selector), [Selector(s) for s in dom]
    patterns = [p if case_sensitive else p.lower() for p in anchor_patterns]

    def strip(html: str) -> str:
        if "<" not in html and "&" not in html:
            return html
        root = parse(html, bare_references)
        if patterns:
            _drop(root, lambda e: anchors.matches(e) and any(p in (e.text() if case_sensitive else e.text().lower()) for p in patterns))
        for s in doms:
            _drop(root, s.matches)
        return root.text()

    return strip
