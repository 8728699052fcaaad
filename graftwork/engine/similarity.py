"""Similarity of subtrees."""

from __future__ import annotations

from collections import Counter, defaultdict, deque

from graftwork.parse.node import IDENTIFIERS, Node

RENAME_AT, MODIFY_AT = 0.90, 0.70
DECISIONS = frozenset(
    "binary_expression boolean_operator case_clause catch_clause conditional_expression do_statement elif_clause else_clause for_expression for_in_statement for_statement if_expression if_statement logical_and logical_or "
    "match_arm match_expression switch_case switch_statement ternary_expression try_expression try_statement while_expression while_statement".split()
)
FLOW = frozenset("break_statement continue_statement do_statement for_expression for_in_statement for_statement if_expression if_statement match_expression return_statement switch_statement try_expression try_statement while_expression while_statement".split())


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def structural(a: Node, b: Node) -> float:
    return jaccard({n.structural for n in a.walk()}, {n.structural for n in b.walk()})


def leaves(n: Node, blind: bool = False) -> list[str]:
    """Leaf texts, or kinds where there is none; identifiers are alike if blind."""
    return ["<IDENTIFIER>" if blind and x.kind in IDENTIFIERS else x.text or x.kind for x in n.walk() if not x.children]


def multiset(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    x, y = Counter(a), Counter(b)
    low = sum((x & y).values())
    return low / (len(a) + len(b) - low)


def composite(a: Node, b: Node) -> float:
    return 0.6 * structural(a, b) + 0.4 * multiset(leaves(a, True), leaves(b, True))


def only_identifiers(a: Node, b: Node) -> bool:
    return a.structural == b.structural and a.content != b.content and a.identity == b.identity


def complexity(n: Node) -> int:
    return sum(x.kind in DECISIONS for x in n.walk())


def penalty(a: list[str], b: list[str]) -> float:
    """How far the k-th occurrences of equal tokens lie apart, at most 0.2; 0 for lists of unequal length."""
    if len(a) != len(b) or not a:
        return 0.0
    at: dict[str, deque] = defaultdict(deque)
    for j, t in enumerate(b):
        at[t].append(j)
    moved = sum(abs(i - at[t].popleft()) for i, t in enumerate(a) if at[t])
    return min(0.2, 0.2 * moved / len(a) ** 2)


def score(a: Node, b: Node) -> dict:
    x, y = leaves(a), leaves(b)
    ca, cb = complexity(a), complexity(b)
    shape, token = structural(a, b), multiset(leaves(a, True), leaves(b, True))
    calm = 1.0 if ca + cb == 0 else 1.0 - min(1.0, abs(cb - ca) / (ca + cb))
    percent = 100 * min(1.0, max(0.0, 0.5 * shape + 0.3 * token + 0.2 * calm - penalty(x, y)))
    flow = [n.kind for n in a.walk() if n.kind in FLOW] != [n.kind for n in b.walk() if n.kind in FLOW]
    return {
        "structure_similarity": shape, "token_similarity": token, "node_count_delta": abs(b.size - a.size), "cyclomatic_delta": cb - ca, "control_flow_changed": flow,
        "similarity_percent": percent, "change_intensity": "low" if percent >= 80 else "medium" if percent >= 50 else "high",
    }
