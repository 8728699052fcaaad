"""Python to a tree, from the standard library's own parser; comments come from its tokenizer."""

from __future__ import annotations

import ast
import io
import tokenize

from graftwork.parse.node import Node

_BIN = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%"}
_CMP = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_KINDS = {
    ast.Return: "return_statement", ast.Delete: "delete_statement", ast.For: "for_statement", ast.AsyncFor: "for_statement", ast.While: "while_statement", ast.If: "if_statement", ast.With: "with_statement", ast.AsyncWith: "with_statement",
    ast.Match: "match_statement", ast.match_case: "case_clause", ast.Raise: "raise_statement", ast.Try: "try_statement", ast.Assert: "assert_statement", ast.Global: "global_statement", ast.Nonlocal: "nonlocal_statement", ast.Expr: "expression_statement",
    ast.BoolOp: "boolean_operator", ast.NamedExpr: "named_expression", ast.BinOp: "binary_operator", ast.UnaryOp: "unary_operator", ast.Lambda: "lambda", ast.IfExp: "conditional_expression", ast.Dict: "dictionary", ast.Set: "set", ast.List: "list", ast.Tuple: "tuple",
    ast.ListComp: "list_comprehension", ast.SetComp: "set_comprehension", ast.DictComp: "dictionary_comprehension", ast.GeneratorExp: "generator_expression", ast.comprehension: "for_in_clause", ast.Await: "await", ast.Yield: "yield_expression", ast.YieldFrom: "yield_expression",
    ast.Compare: "comparison_operator", ast.Call: "call", ast.JoinedStr: "string", ast.FormattedValue: "interpolation", ast.Attribute: "attribute", ast.Subscript: "subscript", ast.Starred: "list_splat", ast.Slice: "slice", ast.keyword: "keyword_argument",
    ast.ExceptHandler: "except_clause", ast.withitem: "with_item", ast.Pass: "pass_statement", ast.Break: "break_statement", ast.Continue: "continue_statement",
}


class _Mapper:
    def __init__(self, source: str) -> None:
        self.source = source
        self.texts = source.split("\n")
        self.base = [0]
        for line in self.texts:
            self.base.append(self.base[-1] + len(line) + 1)

    def pos(self, row: int, byte: int) -> int:
        """Character offset of a row from 1 and a byte column."""
        line = self.texts[row - 1]
        return self.base[row - 1] + (byte if line.isascii() else len(line.encode()[:byte].decode("utf-8", "ignore")))

    def build(self, tree: ast.AST) -> Node:
        root = Node("module", 0, len(self.source))
        root.children = [self.map(s) for s in tree.body]
        self._comments(root)
        return root

    def _comments(self, root: Node) -> None:
        try:
            tokens = [(t.string, self.base[t.start[0] - 1] + t.start[1]) for t in tokenize.generate_tokens(io.StringIO(self.source).readline) if t.type == tokenize.COMMENT]
        except (tokenize.TokenError, SyntaxError, IndexError):
            return
        for text, a in tokens:
            n = root
            while inner := next((c for c in n.children if c.children and c.start <= a < c.end and c.kind != "string"), None):
                n = inner
            i = sum(1 for c in n.children if c.start < a)
            n.children.insert(i, Node("comment", a, a + len(text), text))

    def span(self, n: ast.AST) -> tuple[int, int]:
        return self.pos(n.lineno, n.col_offset), self.pos(n.end_lineno, n.end_col_offset)

    def leaf(self, kind: str, text: str, a: int, b: int) -> Node:
        return Node(kind, a, b, text)

    def block(self, body: list[ast.stmt]) -> list[Node]:
        if not body:
            return []
        kids = [self.map(s) for s in body]
        return [Node("block", kids[0].start, kids[-1].end, "", kids)]

    def type(self, n: ast.expr | None) -> list[Node]:
        if n is None:
            return []
        inner = self.map(n)
        if inner.kind == "subscript":
            inner.kind = "generic_type"
        return [Node("type", inner.start, inner.end, "", [inner])]

    def args(self, a: ast.arguments, start: int) -> Node:
        out = Node("parameters", start, start)
        pairs = [(x, None) for x in [*a.posonlyargs, *a.args]]
        for i, d in enumerate(reversed(a.defaults)):
            pairs[-1 - i] = (pairs[-1 - i][0], d)
        pairs += [(a.vararg, None)] * bool(a.vararg) + list(zip(a.kwonlyargs, a.kw_defaults)) + [(a.kwarg, None)] * bool(a.kwarg)
        for x, d in pairs:
            s, e = self.span(x)
            name = Node("identifier", s, s + len(x.arg), x.arg)
            kids = [name, *self.type(x.annotation), *([self.map(d)] if d else [])]
            out.children.append(name if len(kids) == 1 else Node(("typed_default_parameter" if d else "typed_parameter") if x.annotation else "default_parameter", s, kids[-1].end, "", kids))
        if out.children:
            out.start, out.end = out.children[0].start, out.children[-1].end
        return out

    def op(self, text: str | None, a: int, b: int) -> list[Node]:
        return [Node(text, a, b, text, named=False)] if text else []

    def map(self, n: ast.AST) -> Node:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            a, b = self.span(n)
            at = self.source.find(n.name, a)
            name = Node("identifier", at, at + len(n.name), n.name)
            if isinstance(n, ast.ClassDef):
                bases = [self.map(x) for x in [*n.bases, *n.keywords]]
                out = Node("class_definition", a, b, "", [name, *([Node("argument_list", bases[0].start, bases[-1].end, "", bases)] if bases else []), *self.block(n.body)])
            else:
                lead = self.op("async", a, a + 5) if isinstance(n, ast.AsyncFunctionDef) else []
                arrow = self.op("->", name.end, name.end) if n.returns else []
                out = Node("function_definition", a, b, "", [*lead, name, self.args(n.args, name.end), *arrow, *self.type(n.returns), *self.block(n.body)])
            if n.decorator_list:
                marks = [(lambda d: Node("decorator", max(0, d.start - 1), d.end, "", [d]))(self.map(d)) for d in n.decorator_list]
                return Node("decorated_definition", marks[0].start, b, "", [*marks, out])
            return out
        if isinstance(n, (ast.Assign, ast.AugAssign, ast.AnnAssign)):
            a, b = self.span(n)
            if isinstance(n, ast.Assign):
                kids = []
                for t in n.targets:
                    left = self.map(t)
                    kids += [left, *self.op("=", left.end, left.end + 1)]
                inner = Node("assignment", a, b, "", [*kids, self.map(n.value)])
            elif isinstance(n, ast.AugAssign):
                left, mark = self.map(n.target), _BIN.get(type(n.op))
                inner = Node("augmented_assignment", a, b, "", [left, *self.op(mark and mark + "=", left.end, left.end + 2), self.map(n.value)])
            else:
                left = self.map(n.target)
                inner = Node("assignment", a, b, "", [left, *self.type(n.annotation), *([*self.op("=", left.end, left.end + 1), self.map(n.value)] if n.value else [])])
            return Node("expression_statement", a, b, "", [inner])
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            a, b = self.span(n)
            names = [Node("dotted_name", *self.span(x), "", [Node("identifier", *self.span(x), x.name), *([Node("identifier", *self.span(x), x.asname)] if x.asname else [])]) for x in n.names]
            if isinstance(n, ast.Import):
                return Node("import_statement", a, b, "", names)
            return Node("import_from_statement", a, b, "", [Node("dotted_name", a, b, "", [Node("identifier", a, b, "." * n.level + (n.module or ""))]), *names])
        if isinstance(n, ast.Name):
            return Node("identifier", *self.span(n), n.id)
        if isinstance(n, ast.Constant):
            a, b = self.span(n)
            text = self.source[a:b]
            if isinstance(n.value, (str, bytes)):
                quote = next((q for q in ('"""', "'''", '"', "'") if text.endswith(q)), "")
                lead = text.find(quote) + len(quote) if quote else 0
                inner = text[lead : len(text) - len(quote)]
                return Node("string", a, b, "" if inner else text, [Node("string_content", a + lead, b - len(quote), inner)] if inner else [])
            kind = {True: "true", False: "false", None: "none"}.get(n.value, None) if isinstance(n.value, (bool, type(None))) else None
            return Node(kind or {int: "integer", float: "float", complex: "float"}.get(type(n.value), "ellipsis"), a, b, text)
        kids: list[Node] = []
        if isinstance(n, ast.Attribute):
            a, b = self.span(n)
            return Node("attribute", a, b, "", [self.map(n.value), Node("identifier", b - len(n.attr), b, n.attr)])
        if isinstance(n, ast.Call):
            a, b = self.span(n)
            f = self.map(n.func)
            return Node("call", a, b, "", [f, Node("argument_list", f.end, b, "" if n.args or n.keywords else "()", [self.map(x) for x in [*n.args, *n.keywords]])])
        if isinstance(n, ast.Compare):
            kids = [self.map(n.left)]
            for o, c in zip(n.ops, n.comparators):
                right = self.map(c)
                kids += [*self.op(_CMP.get(type(o)), kids[-1].end, right.start), right]
        elif isinstance(n, ast.BinOp):
            left, right = self.map(n.left), self.map(n.right)
            kids = [left, *self.op(_BIN.get(type(n.op)), left.end, right.start), right]
        elif isinstance(n, ast.UnaryOp):
            e = self.map(n.operand)
            kids = [*self.op({ast.USub: "-", ast.UAdd: "+", ast.Invert: "~"}.get(type(n.op)), self.span(n)[0], e.start), e]
        elif isinstance(n, ast.If):
            kids = [self.map(n.test), *self.block(n.body)]
            if n.orelse:
                if len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and self.source.startswith("elif", self.span(n.orelse[0])[0]):
                    e = self.map(n.orelse[0])
                    e.kind = "elif_clause"
                    tail = [c for c in e.children if c.kind in ("elif_clause", "else_clause")]
                    e.children = [c for c in e.children if c not in tail]
                    kids += [e, *tail]
                else:
                    body = self.block(n.orelse)
                    kids.append(Node("else_clause", body[0].start, body[0].end, "", body))
        elif isinstance(n, ast.keyword):
            a, b = self.span(n)
            kids = [*([Node("identifier", a, a + len(n.arg), n.arg)] if n.arg else []), self.map(n.value)]
        elif isinstance(n, ast.Lambda):
            kids = [self.args(n.args, self.span(n)[0]), self.map(n.body)]
        elif isinstance(n, ast.Dict):
            for k, v in zip(n.keys, n.values):
                v = self.map(v)
                if k is None:
                    kids.append(Node("dictionary_splat", v.start, v.end, "", [v]))
                else:
                    k = self.map(k)
                    kids.append(Node("pair", k.start, v.end, "", [k, v]))
        else:
            for field, value in ast.iter_fields(n):
                if field in ("body", "orelse", "finalbody", "handlers") and isinstance(value, list) and not isinstance(n, ast.Module):
                    if field == "handlers":
                        kids += [self.map(x) for x in value]
                    elif value:
                        body = self.block(value)
                        kids += body if field == "body" else [Node("else_clause" if field == "orelse" else "finally_clause", body[0].start, body[0].end, "", body)]
                elif isinstance(value, ast.AST) and not isinstance(value, (ast.expr_context, ast.operator, ast.boolop, ast.unaryop)):
                    kids.append(self.map(value))
                elif isinstance(value, list):
                    kids += [self.map(x) for x in value if isinstance(x, ast.AST) and not isinstance(x, ast.cmpop)]
                elif isinstance(value, str) and field in ("name", "id", "attr", "rest"):
                    kids.append(Node("identifier", kids[-1].end if kids else 0, kids[-1].end if kids else 0, value))
        if hasattr(n, "lineno"):
            a, b = self.span(n)
        else:
            a, b = (kids[0].start, kids[-1].end) if kids else (0, 0)
        kind = _KINDS.get(type(n), type(n).__name__.lower())
        for c in kids:
            if c.start == c.end == 0 and a:
                c.start = c.end = a
        return Node(kind, a, b, "" if kids else self.source[a:b], kids)


def parse_python(source: str) -> Node:
    """A source that doesn't compile becomes a module of one ERROR for each line."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        root, at = Node("module", 0, len(source)), 0
        for line in source.split("\n"):
            if line.strip():
                root.children.append(Node("ERROR", at, at + len(line), line.strip()))
            at += len(line) + 1
        return root
    return _Mapper(source).build(tree)
