"""Merge of three versions by entities, and edits between two texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from graftwork.engine.diff import diff, name_of
from graftwork.engine.facts import quoted
from graftwork.parse import ParseLimit, parse
from graftwork.parse.node import Node


def _find(root: Node, kind: str, name: str) -> Node | None:
    return next((n for n in root.walk() if n.kind == kind and name_of(n) == name), None)


def broken(root: Node) -> bool:
    return any(n.kind in ("ERROR", "MISSING") or "error" in n.kind for n in root.walk())


def parsed(text: str, lang: str) -> Node | None:
    try:
        return parse(text, lang)
    except (ParseLimit, ValueError):
        return None


def merge(base: str, ours: str, theirs: str, path: str, lang: str | None, tree: Callable[[str, str], Node | None] = parsed, compare: Callable[[str, str, str], list[dict]] | None = None) -> tuple[str, int]:
    """The merged text and 0, or both versions between markers and 1. Changes of distinct entities combine if the result still parses.

    tree and compare give the tree of a text and the operations between two texts of a language, as callers keep them.
    """
    if ours == theirs or base == theirs:
        return ours, 0
    if base == ours:
        return theirs, 0
    if lang:
        if compare is None:
            tree = lru_cache(4)(tree)
        compare = compare or (lambda a, b, lang: diff(tree(a, lang), tree(b, lang)))
        a, b = compare(base, ours, lang), compare(base, theirs, lang)
        if not {o["details"] for o in a} & {o["details"] for o in b}:
            if not a:
                return theirs, 0
            if not b:
                return ours, 0
            merged = _splice(ours, theirs, tree(ours, lang), tree(theirs, lang), b, lang)
            if merged is not None:
                return merged, 0
    line = lambda s: s if s.endswith("\n") else s + "\n"
    return f"<<<<<<< Ours: {path}\n{line(ours)}=======\n{line(theirs)}>>>>>>> Theirs: {path}\n", 1


def _splice(ours: str, theirs: str, x: Node | None, y: Node | None, ops: list[dict], lang: str) -> str | None:
    if x is None or y is None:
        return None
    mine, other = ours.encode(), theirs.encode()
    edits: list[tuple[int, int, bytes]] = []
    for o in ops:
        kind, name = o["details"].split("'", 1)[0].strip(), quoted(o["details"]) or ""
        a, b = _find(x, kind, name), _find(y, kind, name)
        if o["op_type"] == "MODIFY" and a and b:
            edits.append((a.start, a.end, other[b.start : b.end]))
        elif o["op_type"] == "DELETE" and a:
            edits.append((a.start, a.end, b""))
        elif o["op_type"] == "INSERT" and b:
            edits.append((len(mine), len(mine), b"\n" + other[b.start : b.end]))
    if not edits:
        return None
    for start, end, text in sorted(edits, key=lambda e: -e[0]):
        if not start <= end <= len(mine):
            return None
        mine = mine[:start] + text + mine[end:]
    try:
        merged = mine.decode()
        return None if broken(parse(merged, lang)) else merged
    except (ParseLimit, ValueError):
        return None


def edit(old: str, new: str) -> tuple[int, int, int]:
    """(start, old end, new end) in bytes of the least span that differs."""
    a, b = old.encode(), new.encode()
    low = min(len(a), len(b))
    start = next((i for i in range(low) if a[i] != b[i]), low)
    tail = 0
    while tail < low - start and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    return start, len(a) - tail, len(b) - tail


def point(text: str, offset: int) -> tuple[int, int]:
    """Row and byte column of a byte offset."""
    before = text.encode()[:offset]
    return before.count(b"\n"), len(before) - (before.rfind(b"\n") + 1)


def char_column(line: str, offset: int) -> int:
    """Characters before a byte offset of a line; inside a character, those before it."""
    return len(line.encode()[:offset].decode("utf-8", "ignore"))


def overlaps(start: int, end: int, ranges: list[tuple[int, int]]) -> bool:
    return any(start < hi and end > lo for lo, hi in ranges)


def reused(old: Node, new: Node, span: tuple[int, int, int]) -> dict:
    """How many nodes of a new tree lie outside an edit and keep their hashes: what an incremental parse would reuse."""
    start, _, end = span
    kept = {(n.kind, n.content) for n in old.walk()}
    n = [x for x in new.walk() if not overlaps(x.start, x.end, [(start, max(end, start + 1))])]
    return {"nodes": new.size, "outside": len(n), "reused": sum((x.kind, x.content) in kept for x in n)}
