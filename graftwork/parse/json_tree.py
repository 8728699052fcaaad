"""JSON with comments to a tree: document, object, array, pair, string, number, true, false, null."""

from __future__ import annotations

import re

from graftwork.parse.node import Node

_TOKEN = re.compile(r'\s+|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>true|false|null)\b|(?P<mark>[\[\]{},:])|(?P<bad>[^\s\[\]{},:"]+|.)', re.S)


def parse_json(source: str) -> Node:
    root = Node("document", 0, len(source))
    stack = [root]

    def close(end: int) -> None:
        while stack[-1].kind == "pair":
            stack.pop().end = end

    last = 0
    for m in _TOKEN.finditer(source):
        kind, text, a, b = m.lastgroup, m[0], m.start(), m.end()
        top = stack[-1]
        if kind is None:
            continue
        if kind == "comment":
            top.children.append(Node("comment", a, b, text))
        elif kind == "mark":
            if text in "{[":
                n = Node("object" if text == "{" else "array", a, b)
                top.children.append(n)
                stack.append(n)
            elif text == ",":
                close(last)
            elif text == ":":
                if top.kind == "object" and top.children and top.children[-1].kind == "string":
                    key = top.children.pop()
                    pair = Node("pair", key.start, b, "", [key])
                    top.children.append(pair)
                    stack.append(pair)
                else:
                    top.children.append(Node("ERROR", a, b, text))
            else:
                close(last)
                if len(stack) > 1 and stack[-1].kind == ("object" if text == "}" else "array"):
                    stack.pop().end = b
                else:
                    stack[-1].children.append(Node("ERROR", a, b, text))
        elif kind == "string":
            top.children.append(Node("string", a, b, "" if b - a > 2 else text, [Node("string_content", a + 1, b - 1, text[1:-1])] if b - a > 2 else []))
        else:
            top.children.append(Node({"number": "number", "word": text, "bad": "ERROR"}[kind], a, b, text))
        last = b
    close(last)
    if len(stack) > 1:
        for n in stack[1:]:
            n.end = last
        stack[-1].children.append(Node("MISSING", last, last))
    return root
