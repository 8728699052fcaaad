"""A tolerant parser for languages with braces: one lexer, one grammar of items and expressions, names of kinds by language.

It aims at trees that are consistent with themselves and carry the kinds that
later steps know; what it can't make sense of becomes an ERROR leaf.
"""

from __future__ import annotations

import re

from graftwork.parse.node import OPERATORS, Node

_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<raw>b?r(?P<hash>\#+)".*?"(?P=hash))|(?P<string>[bru]?\#?"(?:[^"\\]|\\.)*"\#?|`(?:[^`\\]|\\.)*`)|(?P<char>'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.)*')|(?P<life>'[A-Za-z_]\w*)
    |(?P<number>\d[\w]*(?:\.\d[\w]*)?)|(?P<word>[^\W\d]\w*|\$\w*)|(?P<mark><<=|>>=|===|!==|\.\.\.|\.\.=|->|=>|::|:=|\+\+|--|&&|\|\||[-+*/%&|^!=<>]=|\?\?|\?\.|<<|\.\.|.)""",
    re.S | re.X,
)
_PRIMITIVES = frozenset("bool boolean byte char double f32 f64 float i128 i16 i32 i64 i8 int isize long short str string u128 u16 u32 u64 u8 uint usize void unsigned signed number any size_t int64 int32 float64 error".split())
_MODIFIERS = frozenset("abstract async default extern final inline internal native override private protected pub public readonly sealed static synchronized transient unsafe virtual volatile constexpr friend explicit register restrict".split())
_BINARY = {"||": 1, "??": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "..": 0, "..=": 0}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= :=".split())
_CONTROL = frozenset("if for while loop do switch match return break continue try throw".split())


class _Parser:
    def __init__(self, source: str, lang: str) -> None:
        self.lang = "rust" if lang in ("csharp", "ruby", "php") else lang
        self.rust, self.js, self.go, self.java, self.c = (self.lang == x if isinstance(x, str) else self.lang in x for x in ("rust", ("javascript", "typescript"), "go", "java", ("c", "cpp")))
        self.tokens: list[tuple[str, str, int, int]] = []
        self.comments: list[Node] = []
        for m in _LEX.finditer(source):
            kind = "string" if m["raw"] else m.lastgroup
            if kind in ("line", "block"):
                name = f"{kind}_comment" if self.rust or self.java else "comment"
                self.comments.append(Node(name, m.start(), m.end(), m[0]))
            elif kind == "char" and self.rust and len(m[0]) > 4 and m[0][1] != "\\":
                self.tokens.append(("life", m[0], m.start(), m.end()))
            elif kind != "space":
                self.tokens.append((kind, m[0], m.start(), m.end()))
        self.end = len(source)
        self.i = 0
        self.no_struct = False
        self.depth = 0

    # tokens
    def text(self, k: int = 0) -> str:
        return self.tokens[self.i + k][1] if self.i + k < len(self.tokens) else ""

    def type(self, k: int = 0) -> str:
        return self.tokens[self.i + k][0] if self.i + k < len(self.tokens) else ""

    def at(self) -> int:
        return self.tokens[self.i][2] if self.i < len(self.tokens) else self.end

    def last(self) -> int:
        return self.tokens[self.i - 1][3] if self.i else 0

    def leaf(self, kind: str, named: bool = True) -> Node:
        _, text, a, b = self.tokens[self.i]
        self.i += 1
        return Node(kind, a, b, text, named=named)

    def take(self, text: str, into: list[Node] | None = None) -> bool:
        """Passes a token if it's next; operators that count are kept as leaves."""
        if self.text() != text or self.type() in ("string", "char"):
            return False
        if into is not None and text in OPERATORS:
            into.append(self.leaf(text, named=False))
        else:
            self.i += 1
        return True

    def node(self, kind: str, start: int, kids: list[Node]) -> Node:
        return Node(kind, start, max(start, self.last()), "", kids)

    def ident(self, kind: str = "identifier") -> list[Node]:
        return [self.leaf(kind)] if self.type() == "word" else []

    # items
    def file(self) -> Node:
        root = Node({"rust": "source_file", "go": "source_file", "c": "translation_unit", "cpp": "translation_unit"}.get(self.lang, "program"), 0, self.end)
        while self.i < len(self.tokens):
            before = self.i
            root.children += self.item(False)
            if self.i == before:
                root.children.append(self.leaf("ERROR"))
        self.place(root)
        return root

    def place(self, root: Node) -> None:
        """Puts comments where they lie in the tree."""
        for c in self.comments:
            n = root
            while inner := next((x for x in n.children if x.children and x.start <= c.start and c.end <= x.end), None):
                n = inner
            n.children.insert(sum(1 for x in n.children if x.start < c.start), c)

    def body(self, kind: str, in_class: bool = False) -> list[Node]:
        if self.text() != "{":
            return []
        a, kids = self.at(), []
        self.i += 1
        was, self.no_struct = self.no_struct, False
        while self.i < len(self.tokens) and self.text() != "}":
            before = self.i
            kids += self.item(in_class)
            if self.i == before:
                kids.append(self.leaf("ERROR"))
        if not self.take("}"):
            kids.append(Node("MISSING", self.last(), self.last()))
        self.no_struct = was
        n = self.node(kind, a, kids)
        if not kids:
            n.text = "{}"
        return [n]

    def block(self) -> list[Node]:
        return self.body("block" if self.rust or self.go or self.java else "compound_statement" if self.c else "statement_block")

    def item(self, in_class: bool) -> list[Node]:
        self.depth += 1
        try:
            if self.depth > 300:
                return [self.leaf("ERROR")]
            return self._item(in_class)
        finally:
            self.depth -= 1

    def _item(self, in_class: bool) -> list[Node]:
        a, t, kids = self.at(), self.text(), []
        if self.take(";") or self.take(","):
            return []
        if self.type() in ("string", "char", "number"):
            return self.statement(a)
        if t == "#":
            return [self.attribute(a)]
        if t == "@" and self.text(1) != "interface":
            self.i += 1
            kids = self.ident()
            if self.text() == "(":
                kids.append(self.arguments())
            return [self.node("decorator" if self.js else "annotation", a, kids)]
        if t == "{":
            return self.block()
        if t == "export" and self.js:
            self.i += 1
            self.take("default")
            inner = self.item(in_class) if self.text() not in ("{", "*") else self.clause(a)
            self.take(";")
            return [self.node("export_statement", a, inner)]
        while self.text() in _MODIFIERS and self.type(1) in ("word", "mark", "string") and not (self.text(1) in _ASSIGN | {".", ";", ","} or self.text(1) == "(" and self.text() != "pub"):
            m = self.text()
            if m == "pub" and self.text(1) == "(":
                self.i += 2
                while self.i < len(self.tokens) and not self.take(")"):
                    self.i += 1
                kids.append(Node("visibility_modifier", a, self.last(), "pub"))
            elif m == "async":
                kids.append(self.leaf("async", named=False))
            elif m == "unsafe" and self.text(1) == "{":
                self.i += 1
                return [self.node("unsafe_block", a, self.block())]
            elif m == "extern" and self.type(1) == "string":
                self.i += 2
            else:
                kids.append(self.leaf("visibility_modifier" if m in ("pub", "public", "private", "protected") else "modifiers"))
        t = self.text()
        found = self.declaration(a, t, kids, in_class)
        if found is not None:
            return found
        if kids and self.type() != "word":
            return kids
        return self.statement(a, kids)

    def attribute(self, a: int) -> Node:
        if self.c:
            self.i += 1
            name = self.text()
            row = self.at()
            kids = []
            self.i += 1
            end = self.source_line(row)
            while self.i < len(self.tokens) and self.at() < end:
                kids.append(self.leaf("string_literal" if self.type() == "string" else "identifier" if self.type() == "word" else "preproc_arg"))
            return self.node("preproc_include" if name == "include" else "preproc_def" if name == "define" else "preproc_directive", a, kids)
        self.i += 1
        self.take("!")
        kids = []
        depth = 0
        while self.i < len(self.tokens):
            t = self.text()
            depth += (t in "[(") - (t in "])")
            if self.type() == "word":
                kids.append(self.leaf("identifier"))
            else:
                self.i += 1
            if depth <= 0:
                break
        return self.node("attribute_item", a, kids)

    def source_line(self, at: int) -> int:
        end = self.source.find("\n", at)
        return self.end if end < 0 else end

    def clause(self, a: int) -> list[Node]:
        """The rest of an import or export up to its end, names and paths as leaves."""
        kids, depth = [], 0
        while self.i < len(self.tokens):
            t, k = self.text(), self.type()
            if depth == 0 and (t == ";" or k == "word" and t in ("import", "export", "const", "let", "function", "class", "use", "fn", "func", "public", "package", "type", "var") and kids):
                break
            if self.js and depth == 0 and kids and kids[-1].kind == "string":
                break
            depth += (t in ("{", "(")) - (t in ("}", ")"))
            if depth < 0:
                break
            if k == "word" and t not in ("from", "as"):
                kids.append(self.leaf("identifier"))
            elif k in ("string", "char"):
                kids.append(self.string())
                if self.go and depth == 0:
                    break
            else:
                self.i += 1
                if self.go and t == ")" and depth == 0:
                    break
        self.take(";")
        return kids

    def declaration(self, a: int, t: str, kids: list[Node], in_class: bool) -> list[Node] | None:
        nxt = self.type(1) == "word"
        if t in ("use", "import", "package", "using") and self.type(1) in ("word", "string", "mark", "char") and self.text(1) not in ("(", ".", "=") or t == "import" and self.go:
            self.i += 1
            kind = {"use": "use_declaration", "package": "package_clause" if self.go else "package_declaration", "using": "using_declaration"}.get(t, "import_statement" if self.js else "import_declaration")
            return [self.node(kind, a, kids + self.clause(a))]
        if (t in ("fn", "func", "function")) and (nxt or self.text(1) in ("(", "*")):
            return [self.function(a, t, kids)]
        if t in ("struct", "class", "interface", "trait", "enum", "union") and nxt or t == "impl" or t == "@" and self.text(1) == "interface":
            return [self.classlike(a, t, kids)]
        if t in ("mod", "namespace") and nxt:
            self.i += 1
            kids += self.ident()
            kids += self.body("declaration_list", True)
            self.take(";")
            return [self.node("mod_item" if self.rust else "namespace_definition" if self.c else "internal_module", a, kids)]
        if t == "type" and nxt:
            self.i += 1
            name = self.ident("type_identifier")
            if self.go:
                rest = self.classlike(a, self.text(), []).children if self.text() in ("struct", "interface") else [self.type_expr()]
                return [self.node("type_declaration", a, [self.node("type_spec", a, name + rest)])]
            self.generics(name)
            if self.take("=", name):
                name.append(self.type_expr())
            self.take(";")
            return [self.node("type_item" if self.rust else "type_alias_declaration", a, kids + name)]
        if t == "typedef":
            self.i += 1
            inner = [self.classlike(self.at(), self.text(), [])] if self.text() in ("struct", "enum", "union") else [self.type_expr()]
            inner += self.ident("type_identifier")
            self.take(";")
            return [self.node("type_definition", a, inner)]
        if t == "template" and self.text(1) == "<":
            self.i += 1
            self.generics(kids)
            return [self.node("template_declaration", a, kids + self.item(in_class))]
        if t in ("let", "const", "var", "static") and (nxt or self.text(1) in ("{", "[", "(", "&") and (self.js or self.rust or self.go)) and not (self.c or self.java and t != "var"):
            return [self.variable(a, t, kids)]
        if in_class and self.js and self.type() == "word" and t not in _CONTROL:
            k = 1 if t in ("get", "set", "static") and self.type(1) == "word" else 0
            if self.text(k + 1) in ("(", "<"):
                self.i += k
                return [self.function(a, "", kids, "method_definition", "property_identifier")]
            if self.text(k + 1) in ("=", ";", ":", "?", "!"):
                self.i += k
                kids += self.ident("property_identifier")
                self.take("?"), self.take("!")
                if self.take(":"):
                    kids.append(self.type_expr())
                if self.take("=", kids):
                    kids += self.expression()
                self.take(";")
                return [self.node("public_field_definition" if self.lang == "typescript" else "field_definition", a, kids)]
        if in_class and self.java and self.type() == "word" and self.text(1) == "(":
            return [self.function(a, "", kids, "constructor_declaration")]
        if (self.java or self.c) and self.type() == "word" and t not in _CONTROL | {"new", "else", "case", "delete", "sizeof", "this"}:
            return self.typed(a, kids, in_class)
        return None

    def typed(self, a: int, kids: list[Node], in_class: bool) -> list[Node] | None:
        """`Type name ...` of C and Java, if it is one."""
        start = self.i
        if self.text() in ("const", "struct", "enum", "unsigned", "signed", "long") and self.type(1) == "word" and self.text(1) not in ("=",):
            self.i += 1 if self.text() in ("const", "struct", "enum") or self.text(1) in _PRIMITIVES else 0
        typ = self.type_expr()
        stars = 0
        while self.text() in ("*", "&", "&&") and self.c:
            self.i += 1
            stars += 1
        if self.type() != "word" or typ is None or self.text() in _CONTROL | {"instanceof"} or self.text(1) not in ("(", "=", ";", ",", "[", ":", "::"):
            self.i = start
            return None
        if self.c and self.text(1) == "::":
            scope = self.leaf("namespace_identifier")
            self.i += 1
            kids = [*kids, scope]
        if self.text(1) == "(":
            close = self.matching(self.i + 1)
            after = self.tokens[close + 1][1] if close + 1 < len(self.tokens) else ""
            if after in ("{", "const", "throws", "override", "noexcept") or in_class or after == ";" and typ.kind != "identifier" and not self.inside_function:
                kind = "method_declaration" if self.java else "function_definition" if after != ";" else "declaration"
                return [self.function(a, "", [*kids, typ], kind)]
            self.i = start
            return None
        kind = "variable_declarator" if self.java else "init_declarator"
        decls = []
        while self.type() == "word":
            b = self.at()
            one = self.ident("field_identifier" if self.c and in_class else "identifier")
            while self.text() == "[":
                self.i += 1
                one += [] if self.text() == "]" else self.expression()
                self.take("]")
            if self.take("=", one):
                one += self.expression()
            decls.append(self.node(kind, b, one) if self.java or len(one) > 1 else one[0])
            if not self.take(","):
                break
            while self.text() == "*":
                self.i += 1
        self.take(";")
        name = "field_declaration" if in_class else "local_variable_declaration" if self.java else "declaration"
        return [self.node(name, a, [*kids, typ, *decls])]

    inside_function = 0

    def matching(self, i: int) -> int:
        depth = 0
        while i < len(self.tokens):
            t = self.tokens[i][1]
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            if depth == 0:
                return i
            i += 1
        return i

    def function(self, a: int, word: str, kids: list[Node], kind: str = "", name: str = "identifier") -> Node:
        if word:
            self.i += 1
        self.take("*")
        if self.go and self.text() == "(":
            kids.append(self.parameters())
            kind, name = "method_declaration", "field_identifier"
        named = self.ident(name)
        if not kind:
            kind = {"fn": "function_item"}.get(word, "function_declaration" if named else "function_expression" if self.js else "func_literal")
        if self.lang == "cpp" and named and self.text() == "::":
            self.i += 1
            named += self.ident()
        head = named
        self.generics(head)
        if self.text() == "(":
            head.append(self.parameters())
        if self.c:
            head = [self.node("function_declarator", head[0].start if head else a, head)]
        kids = kids + head
        if self.take("->", kids) or self.js and self.take(":"):
            kids.append(self.type_expr())
        elif self.go and self.text() not in ("{", ";", ""):
            kids.append(self.parameters() if self.text() == "(" else self.type_expr())
        while self.text() in ("where", "throws", "const", "override", "noexcept"):
            self.i += 1
            while self.i < len(self.tokens) and self.text() not in ("{", ";"):
                self.i += 1
        self.inside_function += 1
        kids += self.block()
        self.inside_function -= 1
        if not kids or kids[-1].kind not in ("block", "statement_block", "compound_statement"):
            self.take(";")
        return self.node(kind, a, [k for k in kids if k])

    def generics(self, into: list[Node]) -> None:
        if self.text() != "<":
            return
        a, depth, kids = self.at(), 0, []
        while self.i < len(self.tokens):
            t = self.text()
            depth += (t == "<") - (t == ">") - 2 * (t == ">>")
            if self.type() == "word":
                kids.append(self.leaf("type_identifier"))
            else:
                self.i += 1
            if depth <= 0 or t in ("{", ";"):
                break
        into.append(self.node("type_parameters", a, kids))

    def parameters(self) -> Node:
        a, kids = self.at(), []
        self.i += 1
        while self.i < len(self.tokens) and self.text() != ")":
            before, b, one = self.i, self.at(), []
            if self.take("...") or self.take(","):
                continue
            while self.text() in ("&", "mut", "const", "final", "@", "*") or self.type() == "life":
                if self.text() == "mut":
                    one.append(self.leaf("mut", named=False))
                else:
                    self.i += 1
            if self.rust and self.text() == "self":
                one.append(self.leaf("self"))
                kids.append(self.node("self_parameter", b, one))
            elif self.rust or self.js:
                one += [self.pattern()] if self.text() in ("{", "[", "(") else self.ident()
                self.take("?")
                if self.take(":"):
                    one.append(self.type_expr())
                if self.take("=", one):
                    one += self.expression()
                kids.append(one[0] if self.lang == "javascript" and len(one) == 1 else self.node("parameter" if self.rust else "required_parameter" if self.lang == "typescript" else "assignment_pattern", b, one))
            elif self.go:
                names = self.ident()
                if self.text() not in (",", ")"):
                    names.append(self.type_expr())
                kids.append(self.node("parameter_declaration", b, names))
            else:
                one.append(self.type_expr())
                while self.text() in ("*", "&", "&&", "...", "const"):
                    self.i += 1
                one += self.ident()
                while self.text() in ("[", "]"):
                    self.i += 1
                if self.take("=", one):
                    one += self.expression()
                kids.append(self.node("formal_parameter" if self.java else "parameter_declaration", b, one))
            if self.i == before:
                kids.append(self.leaf("ERROR"))
        self.take(")")
        n = self.node("formal_parameters" if self.js or self.java else "parameter_list" if self.c or self.go else "parameters", a, kids)
        if not kids:
            n.text = "()"
        return n

    def pattern(self) -> Node:
        a, depth, kids = self.at(), 0, []
        while self.i < len(self.tokens):
            t = self.text()
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            if self.type() == "word":
                kids.append(self.leaf("identifier"))
            else:
                self.i += 1
            if depth == 0:
                break
        return self.node("pattern", a, kids)

    def type_expr(self) -> Node:
        a, kids = self.at(), []
        while self.text() in ("&", "*", "dyn", "impl", "mut", "const", "[", "]", "?", "&&", "chan", "map") or self.type() == "life" or self.go and self.type() == "number":
            if self.text() == "[" and self.rust:
                self.i += 1
                inner = [self.type_expr()]
                if self.take(";"):
                    inner += self.expression()
                self.take("]")
                return self.node("array_type", a, inner)
            self.i += 1
        if self.text() == "(":
            self.i += 1
            while self.i < len(self.tokens) and self.text() != ")":
                before = self.i
                kids.append(self.type_expr())
                self.take(","), self.take(":")
                if self.i == before:
                    self.i += 1
            self.take(")")
            if self.text() in ("=>", "->"):
                self.i += 1
                kids.append(self.type_expr())
            n = self.node("tuple_type", a, kids)
            n.text = "" if kids else "()"
            return n
        if self.text() == "{" and self.js:
            p = self.pattern()
            p.kind = "object_type"
            return p
        if self.type() != "word" or self.text() in ("where",):
            return Node("type_identifier", a, a)
        n = self.leaf("primitive_type" if self.text() in _PRIMITIVES else "type_identifier")
        while self.text() in ("::", ".") and self.type(1) == "word":
            self.i += 1
            n = self.node("scoped_type_identifier", a, [n, self.leaf("type_identifier")])
        if self.text() == "<":
            b, inner = self.at(), []
            self.i += 1
            while self.i < len(self.tokens) and self.text() not in (">", ">>", "{", ";", ")"):
                before = self.i
                inner.append(self.type_expr())
                self.take(","), self.take("="), self.take("+"), self.take("extends")
                if self.i == before:
                    self.i += 1
            if self.text() == ">>":
                k, _, p, q = self.tokens[self.i]
                self.tokens[self.i : self.i + 1] = [(k, ">", p, p + 1), (k, ">", p + 1, q)]
            self.take(">")
            n = self.node("generic_type", a, [n, self.node("type_arguments", b, [x for x in inner if x.text or x.children])])
        while self.text() == "[" and self.text(1) == "]":
            self.i += 2
            n = self.node("array_type", a, [n])
        while self.text() in ("|", "+") and (self.js or self.rust) and self.type(1) == "word":
            self.i += 1
            n = self.node("union_type" if self.js else "bounded_type", a, [n, self.type_expr()])
        return n

    def classlike(self, a: int, t: str, kids: list[Node]) -> Node:
        self.i += 1 + (t == "@")
        if t == "enum" and self.text() in ("class", "struct"):
            self.i += 1
        if t == "impl":
            self.generics(kids)
            kids.append(self.type_expr())
            if self.take("for"):
                kids.append(self.type_expr())
        else:
            kids += self.ident("identifier" if self.java or self.lang == "javascript" else "type_identifier")
            self.generics(kids)
        while self.i < len(self.tokens) and self.text() not in ("{", ";", "("):
            if self.type() == "word" and self.text() not in ("extends", "implements", "public", "private", "protected", "where", "virtual"):
                kids.append(self.type_expr())
            else:
                self.i += 1
        if self.text() == "(":
            p = self.pattern()
            p.kind = "ordered_field_declaration_list"
            kids.append(p)
        kind = {
            "impl": "impl_item", "trait": "trait_item",
            "struct": "struct_item" if self.rust else "struct_type" if self.go else "struct_specifier",
            "enum": "enum_item" if self.rust else "enum_specifier" if self.c else "enum_declaration",
            "class": "class_specifier" if self.c else "class_declaration",
            "interface": "interface_type" if self.go else "interface_declaration",
        }.get(t, "union_specifier")
        if self.text() == "{":
            if t in ("struct", "enum", "union") and (self.rust or self.go) or t == "enum" or t == "interface" and self.js or self.c and t == "union":
                kids.append(self.fields(t))
            else:
                kids += self.body("declaration_list" if self.rust else "field_declaration_list" if self.c else "class_body", True)
        self.take(";")
        return self.node(kind, a, kids)

    def fields(self, t: str) -> Node:
        a, kids = self.at(), []
        self.i += 1
        while self.i < len(self.tokens) and self.text() != "}":
            before, b, one = self.i, self.at(), []
            if self.take(",") or self.take(";"):
                continue
            if self.text() == "#":
                kids.append(self.attribute(b))
                continue
            while self.text() in _MODIFIERS:
                self.i += 1
                if self.text() == "(":
                    self.i = self.matching(self.i) + 1
            one = self.ident("identifier" if t == "enum" else "property_identifier" if self.js else "field_identifier")
            if self.text() == "(" and t != "enum":
                one.append(self.parameters())
            elif self.text() in ("(", "{"):
                one.append(self.pattern())
            self.take("?")
            if self.take(":") or self.go and self.type() in ("word", "mark") and self.text() not in ("}", ";"):
                one.append(self.type_expr())
            if self.go and self.type() == "string":
                one.append(self.string())
            if self.take("=", one):
                one += self.expression()
            if one:
                kids.append(self.node("enum_variant" if t == "enum" else "property_signature" if self.js else "field_declaration", b, one))
            if self.i == before:
                kids.append(self.leaf("ERROR"))
        self.take("}")
        n = self.node("enum_variant_list" if t == "enum" else "field_declaration_list" if not self.js else "object_type", a, kids)
        n.text = "" if kids else "{}"
        return n

    def variable(self, a: int, t: str, kids: list[Node]) -> Node:
        self.i += 1
        if self.rust or self.go:
            if self.text() == "(" and self.go:
                self.i += 1
                specs = []
                while self.i < len(self.tokens) and self.text() != ")":
                    b, one = self.at(), self.ident()
                    if self.text() not in ("=", ")") and self.type() == "word" and self.text(1) in ("=",):
                        one.append(self.type_expr())
                    if self.take("=", one):
                        one += self.expression()
                    specs.append(self.node(f"{t}_spec", b, one) if one else self.leaf("ERROR"))
                self.take(")")
                return self.node(f"{t}_declaration", a, specs)
            self.take("mut", kids)
            kids += [self.pattern()] if self.text() in ("(", "[", "{", "&") else self.ident()
            if self.rust and self.text() in ("(", "{", "::"):
                while self.i < len(self.tokens) and self.text() not in ("=", ";"):
                    if self.type() == "word":
                        kids.append(self.leaf("identifier"))
                    else:
                        self.i += 1
            if self.take(":") or self.go and self.text() != "=" and self.type() in ("word", "mark"):
                kids.append(self.type_expr())
            if self.take("=", kids):
                kids += self.expression()
                if self.take("else"):
                    kids += self.block()
            self.take(";")
            return self.node({"let": "let_declaration", "const": "const_item" if self.rust else "const_declaration", "static": "static_item"}.get(t, "var_declaration"), a, kids)
        decls = []
        while self.i < len(self.tokens):
            b = self.at()
            one = [self.pattern()] if self.text() in ("{", "[") else self.ident()
            if self.take(":"):
                one.append(self.type_expr())
            if self.take("=", one):
                one += self.expression()
            decls.append(self.node("variable_declarator", b, one))
            if not self.take(","):
                break
        self.take(";")
        return self.node("variable_declaration" if t == "var" else "lexical_declaration", a, kids + decls)

    # statements
    def statement(self, a: int, kids: list[Node] | None = None) -> list[Node]:
        t = self.text()
        if t == "return" and self.type() == "word" or t in ("break", "continue", "throw", "goto", "defer"):
            self.i += 1
            out = [] if self.text() in (";", "}", "") or self.type() == "life" or t in ("break", "continue", "goto") and not self.rust else self.expression()
            if self.type() == "life" or t == "goto" and self.type() == "word":
                out.append(self.leaf("label"))
            self.take(";")
            n = self.node("return_expression" if t == "return" and self.rust else f"{t}_expression" if self.rust else f"{t}_statement", a, out)
            n.text = "" if out else t
            return [self.node("expression_statement", a, [n])] if self.rust else [n]
        e = self.expression()
        semi = self.take(";")
        if not e:
            return kids or []
        control = e[0].kind.endswith(("_statement", "_declaration"))
        if control or self.rust and not semi and len(e) == 1 and not e[0].kind.endswith("_expression"):
            return [*(kids or []), *e]
        if self.go and e[0].kind == "assignment_expression":
            e[0].kind = "short_var_declaration" if any(c.kind == ":=" for c in e[0].children) else "assignment_statement"
            return [*(kids or []), *e]
        return [*(kids or []), *e] if self.rust and not semi else [self.node("expression_statement", a, [*(kids or []), *e])]

    def condition(self) -> list[Node]:
        was, self.no_struct = self.no_struct, True
        kids: list[Node] = []
        if self.take("let"):
            b, pat = self.at(), []
            while self.i < len(self.tokens) and self.text() not in ("=", "{"):
                pat.append(self.leaf("identifier") if self.type() == "word" else self.primary_token())
            self.take("=")
            kids.append(self.node("let_condition", b, [p for p in pat if p] + self.expression()))
        else:
            kids += self.expression()
            while self.take(";"):
                kids += self.expression()
        self.no_struct = was
        return kids

    def primary_token(self) -> Node | None:
        if self.type() in ("number", "string", "char"):
            return self.leaf("literal")
        self.i += 1
        return None

    def kind(self, word: str) -> str:
        return f"{word}_expression" if self.rust else f"{word}_statement"

    def clause_body(self) -> list[Node]:
        return self.block() if self.text() == "{" else self.item(False)

    def control(self) -> Node:
        a, t = self.at(), self.text()
        self.i += 1
        if t == "if":
            kids = self.condition() + self.clause_body()
            if self.text() == "else":
                b = self.at()
                self.i += 1
                kids.append(self.node("else_clause", b, [self.control()] if self.text() == "if" else self.clause_body()))
            return self.node(self.kind("if"), a, kids)
        if t in ("while", "loop"):
            kids = (self.condition() if t == "while" else []) + self.clause_body()
            return self.node(self.kind(t), a, kids)
        if t == "do":
            kids = self.clause_body()
            if self.take("while"):
                kids += self.condition()
            return self.node("do_statement", a, kids)
        if t == "for":
            kids, kind = [], self.kind("for")
            was, self.no_struct = self.no_struct, True
            paren = not (self.rust or self.go) and self.take("(")
            depth = 0
            while self.i < len(self.tokens):
                u = self.text()
                if u == "{" and depth == 0 or paren and u == ")" and depth == 0:
                    break
                if u in ("let", "const", "var", ";", ",", "in", "of", ":", "range"):
                    if u in ("of", "in") and self.js:
                        kind = "for_in_statement"
                    self.i += 1
                    continue
                before = self.i
                e = self.typed(self.at(), [], False) if self.java or self.c else None
                kids += e if e else self.expression(stop_in=True)
                if self.i == before:
                    kids.append(self.leaf("ERROR"))
            if paren:
                self.take(")")
            self.no_struct = was
            return self.node(kind, a, kids + self.clause_body())
        if t in ("match", "switch"):
            kids = self.condition()
            b, arms = self.at(), []
            self.take("{")
            while self.i < len(self.tokens) and self.text() != "}":
                before, c = self.i, self.at()
                if t == "match":
                    pat = []
                    depth = 0
                    while self.i < len(self.tokens) and not (depth == 0 and self.text() == "=>"):
                        u = self.text()
                        depth += (u in ("(", "[", "{")) - (u in (")", "]", "}"))
                        if depth < 0:
                            break
                        if u == "if" and depth == 0:
                            self.i += 1
                            pat += self.condition()
                            continue
                        x = self.leaf("identifier") if self.type() == "word" else self.primary_token()
                        pat += [x] if x else []
                    arm = [Node("match_pattern", c, self.last(), "" if pat else "_", pat)]
                    if self.take("=>", arm):
                        arm += self.block() if self.text() == "{" else self.expression()
                    self.take(",")
                    arms.append(self.node("match_arm", c, arm))
                else:
                    case = []
                    if self.text() in ("case", "default"):
                        word = self.text()
                        self.i += 1
                        while self.i < len(self.tokens) and self.text() not in (":", "->", "}"):
                            k = self.i
                            case += self.expression()
                            self.take(",")
                            if k == self.i:
                                self.i += 1
                        self.take(":") or self.take("->", case)
                        while self.i < len(self.tokens) and self.text() not in ("case", "default", "}"):
                            k = self.i
                            case += self.item(False)
                            if k == self.i:
                                self.i += 1
                        arms.append(self.node("switch_case" if word == "case" else "switch_default", c, case))
                if self.i == before:
                    arms.append(self.leaf("ERROR"))
            self.take("}")
            return self.node("match_expression" if t == "match" else "switch_statement", a, [*kids, self.node(f"{t}_{'block' if t == 'match' else 'body'}", b, arms)])
        kids = self.clause_body()  # try
        while self.text() in ("catch", "finally"):
            b, word = self.at(), self.text()
            self.i += 1
            inner = [self.pattern()] if self.text() == "(" else []
            kids.append(self.node(f"{word}_clause", b, inner + self.clause_body()))
        return self.node("try_statement", a, kids)

    # expressions
    def expression(self, least: int = -1, stop_in: bool = False) -> list[Node]:
        self.depth += 1
        try:
            if self.depth > 300:
                return []
            return self._expression(least, stop_in)
        finally:
            self.depth -= 1

    def _expression(self, least: int, stop_in: bool) -> list[Node]:
        a = self.at()
        left = self.unary()
        if left is None:
            return []
        while self.i < len(self.tokens):
            t = self.text()
            if self.type() in ("string", "char", "number"):
                break
            if t == "as" and (self.rust or self.js):
                self.i += 1
                left = self.node("type_cast_expression" if self.rust else "as_expression", a, [left, self.type_expr()])
                continue
            if t == ">" and self.text(1) == ">" and self.tokens[self.i][3] == self.tokens[self.i + 1][2]:
                self.i += 1
                t = ">>"
            if t in _ASSIGN and least <= 0:
                kids = [left]
                if not self.take(t, kids):
                    kids.append(self.leaf(t, named=False))
                elif t == ":=":
                    kids.append(Node(":=", self.last() - 2, self.last(), ":=", named=False))
                right = self.expression(-1, stop_in)
                plain = t in ("=", ":=")
                left = self.node("assignment_expression" if plain or not (self.rust or self.js) else "compound_assignment_expr" if self.rust else "augmented_assignment_expression", a, kids + right)
                continue
            if t == "?" and not self.rust and least <= 0:
                self.i += 1
                yes = self.expression()
                self.take(":")
                left = self.node("conditional_expression" if self.c else "ternary_expression", a, [left, *yes, *self.expression()])
                continue
            if t == "=>" and self.js:
                kids = [left]
                self.take("=>", kids)
                kids += self.block() if self.text() == "{" else self.expression()
                left = self.node("arrow_function", a, kids)
                continue
            p = _BINARY.get(t)
            if p is None or p <= least or stop_in and t == "in" or t in ("in", "instanceof") and not (self.js or self.java):
                break
            kids = [left]
            if t == ">>" or not self.take(t, kids):
                self.i += 1
            kids += self.expression(p, stop_in)
            left = self.node("range_expression" if t in ("..", "..=") else "binary_expression", a, kids)
        return [left]

    def unary(self) -> Node | None:
        a, t = self.at(), self.text()
        if self.type() in ("mark", "word") and t in ("!", "-", "+", "~", "&", "*", "&&", "++", "--", "await", "typeof", "delete", "..", "...", "sizeof", "void", "yield", "<-"):
            if t == "void" and not self.js:
                return self.postfix()
            kids: list[Node] = []
            if not self.take(t, kids):
                self.i += 1
            if t == "&":
                self.take("mut", kids)
            e = self.unary()
            kind = {"await": "await_expression", "&": "reference_expression" if self.rust else "pointer_expression", "...": "spread_element", "yield": "yield_expression", "++": "update_expression", "--": "update_expression"}.get(t, "unary_expression")
            return self.node(kind, a, kids + ([e] if e else []))
        return self.postfix()

    def arguments(self) -> Node:
        a, kids = self.at(), []
        self.i += 1
        was, self.no_struct = self.no_struct, False
        while self.i < len(self.tokens) and self.text() != ")":
            before = self.i
            kids += self.expression()
            self.take(",")
            if self.i == before:
                kids.append(self.leaf("ERROR") if self.text() not in (";", "}") else Node("MISSING", a, a))
                if kids[-1].kind == "MISSING":
                    break
        self.take(")")
        self.no_struct = was
        n = self.node("arguments" if self.rust or self.js else "argument_list", a, kids)
        n.text = "" if kids else "()"
        return n

    def postfix(self) -> Node | None:
        a = self.at()
        e = self.primary()
        while e is not None and self.i < len(self.tokens):
            t = self.text()
            if self.type() in ("string", "char", "number"):
                break
            if t == "(":
                args = self.arguments()
                if self.java and e.kind == "field_access":
                    e = self.node("method_invocation", a, [*e.children, args])
                elif self.java:
                    e = self.node("method_invocation", a, [e, args])
                else:
                    e = self.node("call_expression", a, [e, args])
            elif t in (".", "?.", "->") and (self.type(1) in ("word", "number")) and (t != "->" or self.c):
                self.i += 1
                kind = {"js": "property_identifier"}.get("js" if self.js else "", "identifier" if self.java else "field_identifier")
                if self.text() == "await":
                    self.i += 1
                    e = self.node("await_expression", a, [e])
                    continue
                e = self.node("member_expression" if self.js else "field_access" if self.java else "selector_expression" if self.go else "field_expression", a, [e, self.leaf(kind)])
            elif t == "::" and self.type(1) == "word":
                self.i += 1
                e = self.node("scoped_identifier" if self.rust else "qualified_identifier", a, [e, self.leaf("identifier")])
            elif t == "::" and self.text(1) == "<":
                self.i += 1
                kids = [e]
                self.generics(kids)
                e = self.node("generic_function", a, kids)
            elif t == "[":
                self.i += 1
                inner = self.expression()
                while self.take(":") or self.take(","):
                    inner += self.expression()
                self.take("]")
                e = self.node("subscript_expression" if not (self.rust or self.go) else "index_expression", a, [e, *inner])
            elif t == "?" and self.rust:
                self.i += 1
                e = self.node("try_expression", a, [e])
            elif t in ("++", "--"):
                self.i += 1
                e = self.node("update_expression" if not self.go else "inc_statement", a, [e])
            elif t == "!" and self.rust and e.kind in ("identifier", "scoped_identifier") and self.text(1) in ("(", "[", "{"):
                self.i += 1
                p = self.pattern_tokens()
                e = self.node("macro_invocation", a, [e, p])
            elif t == "{" and not self.no_struct and e.kind in ("identifier", "scoped_identifier", "type_identifier", "selector_expression") and (self.rust or self.go) and (self.text(1) == "}" or self.type(1) == "word" and self.text(2) in (":", ",", "}")) and e.text[:1] != e.text[:1].lower():
                b, kids = self.at(), []
                self.i += 1
                while self.i < len(self.tokens) and self.text() != "}":
                    before, c = self.i, self.at()
                    one = self.ident("field_identifier")
                    if self.take(":"):
                        one += self.expression()
                    else:
                        one = one or self.expression()
                    self.take(",")
                    kids.append(self.node("field_initializer", c, one))
                    if self.i == before:
                        kids.append(self.leaf("ERROR"))
                self.take("}")
                e = self.node("struct_expression" if self.rust else "composite_literal", a, [e, self.node("field_initializer_list", b, kids)])
            else:
                break
        return e

    def pattern_tokens(self) -> Node:
        a, depth, kids = self.at(), 0, []
        while self.i < len(self.tokens):
            t, k = self.text(), self.type()
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}")) if k == "mark" else 0
            if k == "word":
                kids.append(self.leaf("identifier"))
            elif k in ("string", "char"):
                kids.append(self.string())
            elif k == "number":
                kids.append(self.leaf("integer_literal"))
            elif t in OPERATORS:
                kids.append(self.leaf(t, named=False))
            else:
                self.i += 1
            if depth == 0:
                break
        return self.node("token_tree", a, kids)

    def string(self) -> Node:
        kind = {"js": "template_string" if self.text()[:1] == "`" else "string"}.get("js" if self.js else "", "char_literal" if self.type() == "char" else "interpreted_string_literal" if self.go else "string_literal")
        return self.leaf(kind)

    def primary(self) -> Node | None:
        a, t, k = self.at(), self.text(), self.type()
        if k in ("string", "char"):
            return self.string()
        if k == "number":
            return self.leaf("number" if self.js else "number_literal" if self.c else ("float_literal" if "." in t else "integer_literal") if self.rust or self.go else "decimal_integer_literal")
        if k == "life":
            label = self.leaf("label")
            self.take(":")
            return self.control() if self.text() in _CONTROL else label
        if k == "word":
            if t in ("if", "for", "while", "loop", "do", "switch", "match", "try") and not (t == "match" and not self.rust) and not (t == "loop" and not self.rust):
                return self.control()
            if t == "return" and self.rust:
                self.i += 1
                inner = [] if self.text() in (";", "}", ",", ")") else self.expression()
                n = self.node("return_expression", a, inner)
                n.text = "" if inner else "return"
                return n
            if t in ("function", "func") or t == "async" and self.text(1) == "function":
                lead = [self.leaf("async", named=False)] if t == "async" else []
                return self.function(a, self.text(), lead, "function_expression" if self.js else "func_literal")
            if t == "class" and self.js:
                return self.classlike(a, t, [])
            if t == "new" and (self.js or self.java or self.c):
                self.i += 1
                kids = [self.type_expr()]
                if self.text() == "(":
                    kids.append(self.arguments())
                if self.text() == "{" and self.java:
                    kids += self.body("class_body", True)
                return self.node("new_expression" if not self.java else "object_creation_expression", a, kids)
            if t in ("move", "async") and self.rust:
                self.i += 1
                return self.primary()
            if t == "unsafe" and self.text(1) == "{":
                self.i += 1
                return self.node("unsafe_block", a, self.block())
            if t in ("true", "false"):
                return self.leaf("boolean_literal" if self.rust else t)
            if t in ("null", "nil", "undefined", "nullptr"):
                return self.leaf({"null": "null_literal" if self.java else "null"}.get(t, t))
            if t in ("self", "this", "super"):
                return self.leaf(t)
            if t in ("else", "case", "default", "catch", "finally") or t == "in":
                return None
            if t in ("map", "chan") and self.go and self.text(1) == "[":
                typ = self.type_expr()
                return self.node("composite_literal", a, [typ, self.pattern_tokens()]) if self.text() == "{" else typ
            return self.leaf("identifier")
        if t == "(":
            close = self.matching(self.i)
            after = self.tokens[close + 1][1] if close + 1 < len(self.tokens) else ""
            if self.js and after == "=>":
                kids = [self.parameters()]
                self.take("=>", kids)
                kids += self.block() if self.text() == "{" else self.expression()
                return self.node("arrow_function", a, kids)
            if self.java and after == "->":
                kids = [self.parameters()]
                self.take("->", kids)
                kids += self.block() if self.text() == "{" else self.expression()
                return self.node("lambda", a, kids)
            self.i += 1
            was, self.no_struct = self.no_struct, False
            kids = self.expression()
            commas = 0
            while self.take(","):
                commas += 1
                kids += self.expression()
            self.take(")")
            self.no_struct = was
            n = self.node("tuple_expression" if commas and self.rust else "parenthesized_expression", a, kids)
            n.text = "" if kids else "()"
            return n
        if t == "[":
            self.i += 1
            kids = []
            if self.text() == "]" and self.go:
                self.i += 1
                kids = [self.type_expr()]
                return self.node("composite_literal", a, [*kids, self.pattern_tokens()]) if self.text() == "{" else kids[0]
            while self.i < len(self.tokens) and self.text() != "]":
                before = self.i
                kids += self.expression()
                self.take(","), self.take(";")
                if self.i == before:
                    kids.append(self.leaf("ERROR"))
            self.take("]")
            if self.lang == "cpp" and self.text() in ("(", "{"):
                kids += ([self.parameters()] if self.text() == "(" else []) + self.block()
                return self.node("lambda_expression", a, kids)
            n = self.node("array" if self.js else "array_expression", a, kids)
            n.text = "" if kids else "[]"
            return n
        if t == "{":
            return self.object(a) if self.js else self.pattern_tokens() if self.c or self.java else (self.block() or [None])[0]
        if t in ("|", "||") and self.rust:
            self.i += 1
            params = []
            while t == "|" and self.i < len(self.tokens) and self.text() != "|":
                if self.type() == "word":
                    params.append(self.leaf("identifier"))
                else:
                    self.i += 1
                    if self.text(-1) == ":":
                        params.append(self.type_expr())
            if t == "|":
                self.take("|")
            kids = [Node("closure_parameters", a, self.last(), "" if params else "||", params)]
            kids += self.block() if self.text() == "{" else self.expression()
            return self.node("closure_expression", a, kids)
        if t == "#" and self.type(1) == "word" and self.js:
            self.i += 1
            return self.leaf("private_property_identifier")
        if t == "<" and self.js and self.type(1) == "word":
            return None
        return None

    def object(self, a: int) -> Node:
        self.i += 1
        kids = []
        while self.i < len(self.tokens) and self.text() != "}":
            before, b = self.i, self.at()
            if self.take(","):
                continue
            if self.text() == "...":
                kids += self.expression()
            elif self.type() == "word" and self.text(1) == "(" or self.text() in ("async", "get", "set") and self.type(1) == "word":
                if self.text(1) != "(":
                    self.i += 1
                kids.append(self.function(b, "", [], "method_definition", "property_identifier"))
            else:
                key = self.string() if self.type() in ("string", "char") else self.leaf("property_identifier") if self.type() == "word" else (self.expression() or [None])[0]
                if self.take(":"):
                    kids.append(self.node("pair", b, [key, *self.expression()]))
                elif key:
                    key.kind = "shorthand_property_identifier" if key.kind == "property_identifier" else key.kind
                    kids.append(key)
            if self.i == before:
                kids.append(self.leaf("ERROR"))
        self.take("}")
        n = self.node("object", a, kids)
        n.text = "" if kids else "{}"
        return n


def parse_brace(source: str, lang: str) -> Node:
    p = _Parser(source, lang)
    p.source = source
    return p.file()
