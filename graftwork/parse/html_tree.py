"""HTML to a tree: element, tag_name, attribute, text, comment. An extension, for pages.

Paragraphs, list items, cells, rows and options without an end tag end where the next begins, so that they don't nest.
"""

from __future__ import annotations

from html.parser import HTMLParser

from graftwork.parse.node import Node

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What a start tag ends, if it is open inside of nothing that holds it apart.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}} | {b: {"p"} for b in _BLOCKS}
_HOLDERS = frozenset("ul ol dl table select body html button".split())


class _Builder(HTMLParser):
    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=False)
        self.root = Node("document", 0, len(source))
        self.stack = [self.root]
        self.lines = [0]
        for i, c in enumerate(source):
            if c == "\n":
                self.lines.append(i + 1)

    def at(self) -> int:
        row, col = self.getpos()
        return self.lines[row - 1] + col

    def leaf(self, kind: str, text: str) -> None:
        a = self.at()
        self.stack[-1].children.append(Node(kind, a, a + len(text), text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = self.at()
        ended = _ENDS.get(tag, ())
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i].children[0].text
            if name in _HOLDERS or not ended:
                break
            if name in ended:
                for n in self.stack[i:]:
                    n.end = a
                del self.stack[i:]
        b = a + len(self.get_starttag_text() or "")
        n = Node("element", a, b, "", [Node("tag_name", a + 1, a + 1 + len(tag), tag)])
        for k, v in attrs:
            n.children.append(Node("attribute", a, b, "", [Node("attribute_name", a, b, k), *([Node("attribute_value", a, b, v)] if v else [])]))
        self.stack[-1].children.append(n)
        if tag not in _VOID:
            self.stack.append(n)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        depth = len(self.stack)
        self.handle_starttag(tag, attrs)
        del self.stack[depth:]

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].children[0].text == tag:
                for n in self.stack[i:]:
                    n.end = self.at() + len(tag) + 3
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.leaf("text", data)

    def handle_comment(self, data: str) -> None:
        self.leaf("comment", data)

    def handle_decl(self, decl: str) -> None:
        self.leaf("doctype", decl)


def parse_html(source: str) -> Node:
    b = _Builder(source)
    b.feed(source)
    b.close()
    for n in b.root.walk():
        n.end = min(max(n.start, n.end), len(source))
    return b.root
