"""Facts of a tree: functions, patterns of refactoring, symbols, calls, variables, guards, types."""

from __future__ import annotations

import re
from collections import defaultdict, deque

from graftwork.engine.diff import CLASSES, FUNCTIONS, VARIABLES, name_of
from graftwork.engine.similarity import composite, only_identifiers, structural
from graftwork.parse.node import IDENTIFIERS, Node, _h

EXTRACT_AT, MOVED_NAME_AT, SURFACE_AT = 0.80, 0.85, 0.60
SYMBOL_CLASSES = CLASSES | frozenset("class_specifier enum_specifier namespace_definition struct_specifier template_declaration type_declaration type_definition type_spec".split())
SYMBOL_VARIABLES = VARIABLES | {"short_var_declaration"}
CALLS = frozenset("call call_expression invocation_expression method_invocation".split())
DEFINITIONS = FUNCTIONS - {"closure_expression", "lambda"}


def quoted(details: str) -> str | None:
    m = re.search(r"'([^']*)'", details)
    return m and m[1]


def patterns(ops: list[dict], a: Node | None, b: Node | None) -> list[dict]:
    """Extracted methods, moved methods, renames."""
    out = []
    old, new = ([(name_of(n, IDENTIFIERS), n) for n in t.walk() if n.kind in FUNCTIONS] if t else [] for t in (a, b))
    was, now = dict(old), dict(new)
    of = lambda kind: [quoted(o["details"]) for o in ops if o["op_type"] == kind and o["entity_type"] == "function"]
    for i in of("INSERT"):
        for m in of("MODIFY"):
            if i in now and m in was and (s := structural(now[i], was[m])) > EXTRACT_AT:
                out.append({"kind": "extract_method", "description": f"Function '{i}' appears to be extracted from '{m}'", "involved_entities": [i, m], "confidence": s})
    for o in ops:
        if o["op_type"] == "MOVE" and o["entity_type"] == "function":
            name = quoted(o["details"]) or "unknown"
            out.append({"kind": "move_method", "description": f"Method '{name}' moved from {o['old_location'] or '?'} to {o['new_location'] or '?'}", "involved_entities": [name], "confidence": 1.0})
    for o in ops:
        m = re.search(r"from '([^']*)'.* to '([^']*)'", o["details"]) if o["op_type"] == "RENAME" else None
        if m:
            x, y = next((n for k, n in old if k == m[1]), None), next((n for k, n in new if k == m[2]), None)
            if x is None or y is None or only_identifiers(x, y):
                out.append({"kind": "rename_variable", "description": f"'{m[1]}' renamed to '{m[2]}'", "involved_entities": [m[1], m[2]], "confidence": 1.0})
    return out


def symbol_entity(kind: str) -> str | None:
    return "function" if kind in FUNCTIONS else "class" if kind in SYMBOL_CLASSES else "variable" if kind in SYMBOL_VARIABLES else None


def symbol_name(n: Node) -> str:
    """Nearest identifier within five levels, not inside other symbols."""
    queue = deque((c, 1) for c in n.children)
    while queue:
        x, depth = queue.popleft()
        if x.kind in IDENTIFIERS and x.text:
            return x.text
        if depth < 5:
            queue.extend((c, depth + 1) for c in x.children if symbol_entity(c.kind) is None)
    return f"anon@L{n.start_row + 1}"


def symbols(root: Node | None, path: str) -> list[dict]:
    """Symbols down to depth 64, in pre-order; parent is the position of the symbol around it, -1 for none."""
    out: list[dict] = []
    stack = [(root, -1, 0)] if root else []
    while stack:
        n, parent, depth = stack.pop()
        if depth > 64:
            continue
        if kind := symbol_entity(n.kind):
            name = symbol_name(n)
            out.append({"name": name, "file_path": path, "entity_type": kind, "structure": n.structural, "signature": _h(n.kind.encode(), name.encode(), n.structural), "parent": parent, "node": n})
            parent = len(out) - 1
        stack.extend((c, parent, depth + 1) for c in reversed(n.children))
    return out


def cross_file(pairs: list[tuple[str, Node | None, Node | None]]) -> list[dict]:
    """Where symbols went that are no longer in their file: for each old one, a move, else a rename, else a change of its surface. A new symbol serves once."""
    old = [s for p, a, _ in pairs for s in symbols(a, p)]
    new = [s for p, _, b in pairs for s in symbols(b, p)]
    keys = {"both": lambda s: (s["structure"], s["signature"]), "shape": lambda s: s["structure"], "name": lambda s: s["name"]}
    index = {k: defaultdict(list) for k in keys}
    for j, s in enumerate(new):
        for k, key in keys.items():
            index[k][key(s)].append(j)
    there = {(s["file_path"], s["name"], s["structure"]) for s in new}
    used: set[int] = set()
    out = []
    for s in old:
        if (s["file_path"], s["name"], s["structure"]) in there:
            continue
        for k, event, text in (("both", "cross_file_move", "{e} '{n}' moved from '{f}' to '{g}'"), ("shape", "cross_file_rename", "{e} '{n}' in '{f}' renamed to '{m}' in '{g}'"), ("name", "api_surface_change", "{e} '{n}' API changed when moving from '{f}' to '{g}'")):
            hit = None
            for j in index[k].get(keys[k](s), ()):
                t = new[j]
                if j in used or t["file_path"] == s["file_path"]:
                    continue
                if k == "both":
                    hit = (j, 1.0)
                elif t["entity_type"] == s["entity_type"] and (t["name"] != s["name"] if k == "shape" else t["signature"] != s["signature"]):
                    v = composite(s["node"], t["node"])
                    hit = (j, v) if v >= (MOVED_NAME_AT if k == "shape" else SURFACE_AT) else None
                if hit:
                    break
            if hit:
                used.add(hit[0])
                t = new[hit[0]]
                out.append({"event": event, "old_symbol": s["name"], "old_file": s["file_path"], "new_symbol": t["name"], "new_file": t["file_path"], "similarity_score": hit[1], "description": text.format(e=s["entity_type"], n=s["name"], m=t["name"], f=s["file_path"], g=t["file_path"])})
                break
    return out


def callee(n: Node) -> str:
    """Name that a call begins with: first identifier among its children, or in a field access among them."""
    for c in n.children:
        if c.kind in ("field_identifier", "identifier", "name", "property_identifier") and c.text.strip():
            return c.text.strip()
        if c.kind in ("field_expression", "member_expression"):
            for g in c.children:
                if g.kind in ("field_identifier", "identifier", "property_identifier") and g.text.strip():
                    return g.text.strip()
    return ""


def functions_and_calls(root: Node) -> tuple[list[tuple], list[tuple]]:
    """(name, kind, row) of definitions, the last of a name, and (caller, callee, row) of calls within them."""
    defined: dict[str, tuple] = {}
    calls: list[tuple] = []
    stack: list[tuple[Node, str | None]] = [(root, None)]
    while stack:
        n, around = stack.pop()
        if n.kind in DEFINITIONS:
            around = name_of(n)
            defined[around] = (around, n.kind, n.start_row)
        if n.kind in CALLS and around is not None and (to := callee(n)) and to != around:
            calls.append((around, to, n.start_row))
        stack.extend((c, around) for c in reversed(n.children))
    return list(defined.values()), calls


DECLARING = frozenset("assignment_statement formal_parameter let_declaration lexical_declaration parameter short_var_decl variable_declaration variable_declarator".split())
MARKS = frozenset("= += -= *= /= %= == != < > <= >=".split())


def declared(n: Node) -> list[str]:
    return list(dict.fromkeys(t for x in n.walk() if x.kind in DECLARING for c in x.children if c.kind in ("identifier", "name", "pattern") and (t := c.text.strip())))


def returned(n: Node) -> list[str]:
    return [" ".join(c.text for c in x.children if c.kind not in ("return", ";")).strip() for x in n.walk() if x.kind in ("return_statement", "return_expression")]


def marks(n: Node) -> list[str]:
    return [c.kind for x in n.walk() if x.kind in ("assignment_expression", "augmented_assignment_expression", "binary_expression") for c in x.children if c.kind in MARKS]


def data_flow(a: Node, b: Node) -> dict:
    """Whether a function's data flow changed, and how."""
    va, vb = declared(a), declared(b)
    changed = returned(a) != returned(b)
    only = only_identifiers(a, b)
    tag, sure = "DATA_FLOW_MUTATED", 0.90
    if a.content == b.content:
        tag, sure, changed = "UNCHANGED", 1.0, False
    else:
        to = dict(zip(va, vb))
        x, y = ([n.text for n in t.walk() if not n.children] for t in (a, b))
        if only and va and len(va) == len(vb) and len(x) == len(y) and all(to.get(s, s) == t for s, t in zip(x, y)):
            tag, sure = "COSMETIC_LOCAL_RENAME", 0.95
        elif va == vb and not changed and not only and marks(a) == marks(b):
            tag, sure = "PURE_CONTROL_FLOW", 0.85
    return {"tag": tag, "declared_vars_old": va, "declared_vars_new": vb, "return_expr_changed": changed, "confidence": sure}


def text_of(n: Node) -> str:
    """A node's text, or its leaves' joined by spaces."""
    return n.text or " ".join(x.text for x in n.walk() if x.text and not x.children)


_CHECKS = ("!= null", "!= nil", "== nil", "is None", "is not None", "null")
_BOUNDS = ("< count", "< len", "< length", "< size", ">= 0")
_LOCKS = (".acquire", ".lock", "lock(", "pthread_mutex_lock", "synchronized")
_CLOSES = (".close", ".dispose", ".drop", "free")


def guards(root: Node) -> list[tuple[str, str, int]]:
    """(kind, text, row) of checks, bounds, locks and clean-ups; a text counts once, for the first kind that it fits."""
    seen: set[str] = set()
    out = []

    def add(kind: str, text: str, n: Node, fits: bool) -> None:
        if fits and text not in seen:
            seen.add(text)
            out.append((kind, text, n.start_row))

    for n in root.walk():
        if n.kind in ("binary_expression", "comparison_operator", "if_expression", "if_statement"):
            t = text_of(n)
            add("null_check", t, n, any(s in t for s in _CHECKS))
            add("bounds_check", t, n, any(s in t for s in _BOUNDS))
        if n.kind in ("call_expression", "method_invocation"):
            t = text_of(n)
            tight = t.replace(" ", "")
            add("lock_guard", t, n, any(s in tight for s in _LOCKS))
            add("resource_cleanup", t, n, any(s in tight for s in _CLOSES))
    return out


_RULES = {
    "null_check": ("REMOVED_NULL_CHECK", "CRITICAL", "Safety guard '{}' was removed, potential null-pointer dereference"),
    "bounds_check": ("REMOVED_BOUNDS_CHECK", "ERROR", "Bounds guard '{}' was removed, potential out-of-bounds access"),
    "lock_guard": ("STRIPPED_LOCK_GUARD", "CRITICAL", "Concurrency guard '{}' was removed, potential race condition"),
    "resource_cleanup": ("OMITTED_RESOURCE_CLEANUP", "WARN", "Resource cleanup call '{}' was omitted, potential handle leak"),
}


def violations(path: str, a: Node, b: Node) -> list[dict]:
    """Guards of the old tree that the new one lacks; rows count from 0."""
    kept = {(k, t) for k, t, _ in guards(b)}
    return [{"file_path": path, "rule": _RULES[k][0], "message": _RULES[k][2].format(t), "row": row, "severity": _RULES[k][1]} for k, t, row in guards(a) if (k, t) not in kept]


_WIDER = {("i32", "i64"), ("int", "int64_t"), ("u32", "u64")}


def type_refactor(a: Node, b: Node) -> str | None:
    """First pair of types, by position, that differ as an Option from a Result or an integer from a wider one."""
    x, y = (list(dict.fromkeys(t for n in r.walk() if n.kind in ("generic_type", "primitive_type", "return_type", "type_annotation", "type_identifier") and (t := text_of(n)))) for r in (a, b))
    for s, t in zip(x, y):
        if s != t and "Option" in s and "Result" in t:
            return f"Option to Result type-safe upgrade ({s} -> {t})"
        if (s, t) in _WIDER:
            return f"Integer widening type refactor ({s} -> {t})"
    return None
