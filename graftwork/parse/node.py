"""Nodes of syntax trees: kinds, spans, leaf texts and the four hashes."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

OPERATORS = frozenset("= += -= *= /= %= &= |= ^= <<= >>= == != < <= > >= -> => && || ! ~ + - * / % mut async yield".split())
COMMENTS = frozenset("block_comment comment doc_comment documentation_comment line_comment multiline_comment".split())
IDENTIFIERS = frozenset(
    "attribute_name class_name constant decorator field_identifier function_name generic_type identifier key method_name name namespace_identifier package_identifier "
    "primitive_type property_identifier property_name scoped_identifier scoped_type_identifier shorthand_field_identifier shorthand_property_identifier symbol type_identifier type_parameter variable_name".split()
)
SCOPES = frozenset(
    "class_declaration class_definition enum_item function_declaration function_definition function_item impl_item interface_declaration method_declaration method_definition mod_item module namespace_definition struct_item trait_item".split()
)


class Node:
    """A node; ids are given in pre-order, before the children's. Text is kept for leaves only."""

    __slots__ = ("kind", "start", "end", "start_row", "start_col", "end_row", "end_col", "text", "named", "children", "id", "size", "structural", "content", "identity", "context")

    def __init__(self, kind: str, start: int = 0, end: int = 0, text: str = "", children: list[Node] | None = None, named: bool = True) -> None:
        self.kind, self.start, self.end, self.text, self.named = kind, start, end, text, named
        self.children = [c for c in children if c is not None] if children else []
        self.start_row = self.start_col = self.end_row = self.end_col = self.id = 0
        self.size = 1
        self.structural = self.content = self.identity = self.context = b""

    def walk(self) -> Iterator[Node]:
        """All nodes of the subtree in pre-order, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))


class Limits:
    """Guards of a parse; what exceeds them raises ParseLimit."""

    def __init__(self, max_bytes: int = 5 * 1024 * 1024, max_nodes: int = 200_000, max_depth: int = 2048, timeout_ms: int = 2000) -> None:
        self.max_bytes, self.max_nodes, self.max_depth, self.timeout_ms = max_bytes, max_nodes, max_depth, timeout_ms

    def key(self) -> str:
        """The four limits as part of a cache key."""
        return hashlib.sha256(repr((self.max_bytes, self.max_nodes, self.max_depth, self.timeout_ms)).encode()).hexdigest()[:16]


class ParseLimit(ValueError):
    pass


def finish(root: Node, source: str, logic_only: bool, limits: Limits) -> Node:
    """Turns character spans into bytes, rows and byte columns, drops comments if asked, numbers the nodes, counts and hashes."""
    lines = [0]
    if source.isascii():
        at = lambda i: i
    else:
        offsets, total = [0], 0
        for c in source:
            o = ord(c)
            total += 1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4
            offsets.append(total)
        at = offsets.__getitem__
    for i, c in enumerate(source):
        if c == "\n":
            lines.append(at(i + 1))
    count = 0
    order: list[Node] = []
    stack = [(root, 0)]
    while stack:
        n, depth = stack.pop()
        if depth > limits.max_depth:
            raise ParseLimit(f"deeper than {limits.max_depth}")
        n.id, count = count, count + 1
        if count > limits.max_nodes:
            raise ParseLimit(f"more than {limits.max_nodes} nodes")
        n.start, n.end = at(n.start), at(n.end)
        n.start_row = bisect_right(lines, n.start) - 1
        n.start_col = n.start - lines[n.start_row]
        n.end_row = bisect_right(lines, n.end) - 1
        n.end_col = n.end - lines[n.end_row]
        if n.end_col == 0 and n.end_row > n.start_row:
            n.end_row -= 1
            n.end_col = lines[n.end_row + 1] - lines[n.end_row]
        if logic_only:
            n.children = [c for c in n.children if c.kind not in COMMENTS]
        order.append(n)
        stack.extend((c, depth + 1) for c in reversed(n.children))
    hash_tree(root, order)
    return root


def _h(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\x00".join(parts), digest_size=16).digest()


def hash_tree(root: Node, order: list[Node] | None = None) -> None:
    """Shape, content and identity hashes from the leaves up, then contexts from the root down."""
    order = order or list(root.walk())
    for n in reversed(order):
        kind = n.kind.encode()
        if n.children:
            n.size = 1 + sum(c.size for c in n.children)
            n.structural = _h(kind, *[c.structural for c in n.children])
            n.content = _h(*[c.content for c in n.children])
            n.identity = _h(kind, *[c.identity for c in n.children])
        else:
            n.structural = _h(kind)
            n.content = _h(n.text.encode())
            n.identity = _h(kind, b"<IDENTIFIER>" if n.kind in IDENTIFIERS else n.text.encode())
    stack = [(root, b"", b"", "", 0, 0)]
    while stack:
        n, scope, above, above_kind, index, depth = stack.pop()
        n.context = _h(scope, above, above_kind.encode(), str(index).encode(), str(depth).encode())
        inner = _h(n.kind.encode(), n.structural) if n.kind in SCOPES else scope
        stack.extend((c, inner, n.structural, n.kind, i, depth + 1) for i, c in enumerate(n.children))
