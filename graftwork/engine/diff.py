"""Operations that turn one tree into another: exact, shape, name, identity and similarity matching, in this order."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

from graftwork.engine.similarity import MODIFY_AT, RENAME_AT, composite, only_identifiers, score
from graftwork.parse.node import COMMENTS, Node

FUNCTIONS = frozenset("arrow_function closure_expression function_declaration function_definition function_item lambda method_declaration method_definition".split())
CLASSES = frozenset("class_declaration class_definition enum_item impl_item interface_declaration struct_item trait_item".split())
VARIABLES = frozenset("assignment_statement const_declaration const_item let_declaration lexical_declaration pair static_item variable_declaration variable_declarator".split())
SIGNIFICANT = FUNCTIONS | CLASSES | VARIABLES | frozenset("annotation decorator export_statement import_declaration import_statement mod_item module type_alias type_item use_declaration".split())
NAMING = frozenset("field_identifier identifier name property_identifier shorthand_field_identifier type_identifier".split())
WINDOW_BYTES = 1 << 20


def name_of(n: Node, kinds: frozenset = NAMING) -> str:
    """Text of the first naming child, else grandchild, else the line."""
    for level in (n.children, [g for c in n.children for g in c.children]):
        for c in level:
            if c.kind in kinds and c.text:
                return c.text
    return f"anon@L{n.start_row + 1}"


def entity(kind: str) -> str:
    return "function" if kind in FUNCTIONS else "class" if kind in CLASSES else "variable" if kind in VARIABLES else "block" if kind in ("block", "statement_block") else "other"


def location(n: Node) -> str:
    return f"L{n.start_row + 1}" if n.start_row == n.end_row else f"L{n.start_row + 1}-L{n.end_row + 1}"


class Item:
    """A significant node with its name and the path of those around it."""

    __slots__ = ("node", "name", "path")

    def __init__(self, node: Node, name: str, path: tuple[str, ...]) -> None:
        self.node, self.name, self.path = node, name, path


def significant(root: Node | None, windows: list[tuple[int, int]] | None = None, size: int = 0) -> list[Item]:
    """Significant nodes in pre-order; of files above a megabyte only those that overlap a window of rows, if there are any."""
    out: list[Item] = []
    if root is None:
        return out
    prune = windows if size > WINDOW_BYTES else None
    stack = [(root, ())]
    while stack:
        n, path = stack.pop()
        if prune and not any(n.start_row <= hi and n.end_row >= lo for lo, hi in prune):
            continue
        if n.kind in SIGNIFICANT:
            name = name_of(n)
            path = (*path, f"{n.kind}:{name}")
            out.append(Item(n, name, path))
        stack.extend((c, path) for c in reversed(n.children))
    return out


def op(kind: str, a: Item | None, b: Item | None, details: str, similarity: dict | None) -> dict:
    one = a or b
    return {
        "op_type": kind, "entity_type": entity(one.node.kind), "old_location": a and location(a.node), "new_location": b and location(b.node), "details": details, "similarity": similarity, "is_logic_op": one.node.kind not in COMMENTS,
        "kind": one.node.kind, "old_name": a.name if a else None, "new_name": b.name if b else None,
    }


def _paired(kind: str, a: Item, b: Item) -> dict:
    text = f"{a.node.kind} renamed from '{a.name}' to '{b.name}'" if kind == "RENAME" else f"{a.node.kind} '{a.name}' {'moved' if kind == 'MOVE' else 'modified'}"
    return op(kind, a, b, text, score(a.node, b.node))


def diff(a: Node | None, b: Node | None, windows: list[tuple[int, int]] | None = None, size: int = 0) -> list[dict]:
    """Operations between two trees, either of which may be missing."""
    if a is None or b is None:
        return [op("DELETE", x, None, f"{x.node.kind} '{x.name}' deleted", None) for x in significant(a)] + [op("INSERT", None, x, f"{x.node.kind} '{x.name}' inserted", None) for x in significant(b)]
    if a.structural == b.structural and a.content == b.content:
        return []
    old, new = significant(a, windows, size), significant(b, windows, size)
    if a.structural == b.structural and len(old) == len(new):
        out = []
        for x, y in zip(old, new):
            if x.node.content != y.node.content and x.node.kind == y.node.kind:
                out.append(_paired("RENAME" if x.name != y.name and only_identifiers(x.node, y.node) else "MODIFY", x, y))
        return out

    def buckets(key: Callable) -> dict:
        d = defaultdict(list)
        for j, y in enumerate(new):
            d[key(y)].append(j)
        return d

    by_shape, by_name = buckets(lambda y: y.node.structural), buckets(lambda y: (y.node.kind, y.name))
    by_identity, by_kind = buckets(lambda y: y.node.identity), buckets(lambda y: y.node.kind)
    free_a, free_b = dict.fromkeys(range(len(old))), set(range(len(new)))
    found: list[tuple[str, int, int]] = []

    def take(i: int, j: int, kind: str | None) -> None:
        del free_a[i]
        free_b.discard(j)
        if kind:
            found.append((kind, i, j))

    def choose(x: Item, fits: Callable[[Item], bool], among: Iterable[int]) -> int | None:
        """The first that fits, one of the same context or name before others."""
        second = None
        for j in among:
            y = new[j]
            if j in free_b and fits(y):
                if x.node.context == y.node.context or x.name == y.name:
                    return j
                second = j if second is None else second
        return second

    for i in list(free_a):
        x = old[i]
        j = choose(x, lambda y: x.node.content == y.node.content, by_shape.get(x.node.structural, ()))
        if j is not None:
            take(i, j, "MOVE" if x.path != new[j].path else None)
    for i in list(free_a):
        x = old[i]
        j = choose(x, lambda y: x.node.kind == y.node.kind, by_shape.get(x.node.structural, ()))
        if j is not None:
            take(i, j, "RENAME" if x.name != new[j].name and only_identifiers(x.node, new[j].node) else "MODIFY")
    for i in list(free_a):
        x = old[i]
        j = next((j for j in by_name.get((x.node.kind, x.name), ()) if j in free_b), None)
        if j is not None:
            take(i, j, "MODIFY")
    for i in list(free_a):
        x = old[i]
        j = next((j for j in by_identity.get(x.node.identity, ()) if j in free_b and new[j].node.kind == x.node.kind and composite(x.node, new[j].node) >= RENAME_AT), None)
        if j is not None:
            take(i, j, "RENAME")
    for i in list(free_a):
        x, best = old[i], None
        for j in by_kind.get(x.node.kind, ()):
            low, high = sorted((x.node.size, new[j].node.size))
            if j in free_b and low * 3 >= high:
                s = composite(x.node, new[j].node)
                if s >= MODIFY_AT and (best is None or (s, j) > best):
                    best = (s, j)
        if best:
            take(i, best[1], "MODIFY")
    out = [_paired(kind, old[i], new[j]) for kind, i, j in found]
    out += [op("DELETE", old[i], None, f"{old[i].node.kind} '{old[i].name}' deleted", None) for i in free_a]
    return out + [op("INSERT", None, new[j], f"{new[j].node.kind} '{new[j].name}' inserted", None) for j in sorted(free_b)]


class Index:
    """Significant nodes of many files by kind and name, by structure, and by identity."""

    def __init__(self, files: dict[str, Node]) -> None:
        self.by: dict[str, dict] = {"name": defaultdict(list), "structure": defaultdict(list), "identity": defaultdict(list)}
        for p in sorted(files):
            for x in significant(files[p]):
                for how, key in (("name", (x.node.kind, x.name)), ("structure", x.node.structural), ("identity", x.node.identity)):
                    self.by[how][key].append((p, x))

    def find(self, how: str, key: object, apart_from: str) -> tuple[str, Item] | None:
        """The first of that key in another file, in order of path and place."""
        return next((hit for hit in self.by[how].get(key, ()) if hit[0] != apart_from), None)


def multi_file(old: dict[str, Node], new: dict[str, Node]) -> dict[str, list[dict]]:
    """Operations by file, where a delete and an insert of the same kind and name elsewhere become a move. Files and operations go in order."""
    ops = {p: diff(old.get(p), new.get(p)) for p in sorted(old.keys() | new.keys())}
    index = Index(new)
    inserts = [(p, o) for p in ops for o in ops[p] if o["op_type"] == "INSERT"]
    used: set[str] = set()
    for p, gone in [(p, o) for p in ops for o in ops[p] if o["op_type"] == "DELETE"]:
        hit = index.find("name", (gone["kind"], gone["old_name"]), p)
        text, q, place, where = None, None, None, None
        if hit and (t := f"{hit[1].node.kind} '{hit[1].name}' inserted") not in used:
            n = hit[1].node
            text, q, place, where = t, hit[0], f"{hit[0]}:L{n.start_row + 1}-L{n.end_row + 1}", f"{hit[0]}:L{n.start_row + 1}"
        else:
            for r, o in inserts:
                if r != p and o["details"] not in used and o["entity_type"] == gone["entity_type"] and o["new_name"] == gone["old_name"]:
                    text, q, place, where = o["details"], r, f"{r}:{o['new_location']}", f"{r}:{o['new_location']}"
                    break
        if text is None:
            continue
        ops[p] = [o for o in ops[p] if o["details"] != gone["details"]]
        ops[p].append(gone | {"op_type": "MOVE", "new_location": place, "details": f"Moved to {where}", "new_name": gone["old_name"], "is_logic_op": True})
        ops[q] = [o for o in ops[q] if o["details"] != text]
        used.add(text)
    return ops
