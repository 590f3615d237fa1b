"""A parser of Go source files: functions with their token sequences, structure, calls and imports."""

from __future__ import annotations

import re

from ..schema import CODE, CONTROL_FLOW

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_LEX = re.compile(
    r"(?P<blank>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<raw>`[^`]*`)|(?P<string>\"(?:\\.|[^\"\\\n])*\")|(?P<char>'(?:\\[^\n]+?|[^'\\\n])')|"
    r"(?P<number>0[xXbBoO][0-9a-fA-F_.]*(?:[pP][+-]?[0-9_]+)?i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?i?)|(?P<word>[^\W\d]\w*)|"
    r"(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])",
    re.S,
)
_ENDS = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))
PRECEDENCE = {"||": 1, "&&": 2, **dict.fromkeys(("==", "!=", "<", "<=", ">", ">="), 3), **dict.fromkeys(("+", "-", "|", "^"), 4), **dict.fromkeys(("*", "/", "%", "<<", ">>", "&", "&^"), 5)}
ASSIGNS = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class SyntaxProblem(ValueError):
    """The source isn't Go, or not that part of it which the parser knows."""


class Node:
    """A node of the tree; ``kids`` are in the order in which Go's own tree walk visits them."""

    __slots__ = ("kind", "text", "kids", "parts")

    def __init__(self, kind: str, *kids: Node | None, text: str = "", **parts) -> None:
        self.kind, self.text, self.kids, self.parts = kind, text, [k for k in kids if k is not None], parts

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))


def lex(source: str) -> tuple[list[tuple[str, str, int]], list[str]]:
    """Tokens (kind, text, offset) with semicolons put in at line ends, and the comments."""
    out, comments, at, last = [], [], 0, ("", "")
    n = len(source)

    def line_end(offset: int) -> None:
        nonlocal last
        if last[0] in ("name", "literal") or last[1] in _ENDS:
            out.append(("op", ";", offset))
        last = ("", "")

    while at < n:
        m = _LEX.match(source, at)
        if m is None:
            raise SyntaxProblem(f"unexpected {source[at]!r} at {at}")
        kind, text = m.lastgroup, m[0]
        if kind == "line":
            line_end(at)
        elif kind == "comment":
            comments.append(text)
            if text[1] == "*" and "\n" in text:
                line_end(at)
        elif kind != "blank":
            kind = "op" if kind == "op" else "literal" if kind != "word" else "keyword" if text in KEYWORDS else "name"
            out.append((kind, text, at))
            last = (kind, text)
        at = m.end()
    line_end(n)
    out.append(("end", "", n))
    return out, comments


class Parser:
    def __init__(self, source: str) -> None:
        self.source = source
        self.tokens, self.comments = lex(source)
        self.i, self.level = 0, 0

    # tokens
    def peek(self, k: int = 0) -> str:
        kind, text, _ = self.tokens[min(self.i + k, len(self.tokens) - 1)]
        return text if kind in ("op", "keyword") else kind

    def take(self, *want: str) -> str:
        got = self.peek()
        if want and got not in want:
            raise SyntaxProblem(f"expected {' or '.join(want)}, found {got!r} at {self.tokens[self.i][2]}")
        text = self.tokens[self.i][1]
        self.i += 1
        return text

    def skip(self, what: str) -> bool:
        if self.peek() == what:
            self.i += 1
            return True
        return False

    def end(self) -> None:
        if self.peek() not in (")", "}", "end"):
            self.take(";")

    # files
    def file(self) -> dict:
        self.take("package")
        package = self.take("name")
        self.end()
        imports, functions = [], []
        while self.peek() == "import":
            self.take()
            imports += self.group(self.import_spec)
            self.end()
        while self.peek() != "end":
            if self.peek() == "func":
                f = self.func_decl()
                if f is not None:
                    functions.append(f)
            elif self.peek() in ("const", "var", "type"):
                self.declaration()
            else:
                raise SyntaxProblem(f"unexpected {self.peek()!r} at {self.tokens[self.i][2]}")
            self.end()
        return {"package": package, "imports": imports, "functions": functions}

    def group(self, one) -> list:
        if not self.skip("("):
            return [one()]
        out = []
        while self.peek() != ")":
            out.append(one())
            self.end()
        self.take(")")
        return out

    def import_spec(self) -> tuple[str | None, str]:
        alias = self.take() if self.peek() in ("name", ".") else None
        return alias, self.take("literal").strip('"`')

    def func_decl(self) -> dict | None:
        begin = self.tokens[self.i][2]
        self.take("func")
        receiver = self.parameters() if self.peek() == "(" else None
        name = self.take("name")
        type_params = self.type_parameters() if self.peek() == "[" else None
        params, results = self.signature()
        if self.peek() != "{":
            return None
        self.level = 0
        body = self.block()
        end = self.tokens[self.i - 1][2] + 1
        fields = [f for group in (receiver, type_params, params, results) for f in group or []]
        return {"name": name, "receiver": receiver, "params": params, "results": results, "body": body, "begin": begin, "end": end, "tree": Node("FuncDecl", *fields, body)}

    def signature(self) -> tuple[list[Node], list[Node] | None]:
        params = self.parameters()
        if self.peek() == "(":
            return params, self.parameters()
        t = self.type_or_none()
        return params, None if t is None else [Node("Field", t, names=[], type=t)]

    def type_parameters(self) -> list[Node]:
        self.take("[")
        out = []
        while self.peek() != "]":
            names = [self.take("name")]
            while self.skip(","):
                names.append(self.take("name"))
            t = self.constraint()
            out.append(Node("Field", t, names=names, type=t))
            if not self.skip(","):
                break
        self.take("]")
        return out

    def constraint(self) -> Node:
        parts = []
        while True:
            self.skip("~")
            parts.append(self.type())
            if not self.skip("|"):
                return parts[0] if len(parts) == 1 else Node("Union", *parts)

    def parameters(self) -> list[Node]:
        self.take("(")
        old, self.level = self.level, 0
        entries: list[tuple[Node | None, Node]] = []
        while self.peek() != ")":
            first = self.parameter_type(True)
            if self.peek() in (",", ")"):
                entries.append((None, first))
            else:
                entries.append((first, self.parameter_type(False)))
            if not self.skip(","):
                break
        self.take(")")
        self.level = old
        if not any(name is not None for name, _ in entries):
            return [Node("Field", t, names=[], type=t) for _, t in entries]
        out, names = [], []
        for name, t in entries:
            names.append((name if name is not None else t).text)
            if name is not None:
                out.append(Node("Field", t, names=names, type=t))
                names = []
        if names:
            raise SyntaxProblem("mixed named and unnamed parameters")
        return out

    def parameter_type(self, may_be_name: bool) -> Node:
        if self.skip("..."):
            return Node("Ellipsis", self.type())
        if may_be_name and self.peek() == "name" and self.peek(1) == "[":
            # 'a []T' and 'a [N]T' name a parameter; 'A[T]' is a type
            start, name = self.i, self.take()
            if self.peek(1) != "]":
                self.take("[")
                self.expression_or_type()
                if self.peek() == "]":
                    self.take()
                    if self.peek() not in (",", ")", "."):
                        self.i = start + 1
                        return Node("Ident", text=name)
                self.i = start
                return self.type()
            return Node("Ident", text=name)
        return self.type()

    # types
    def type(self) -> Node:
        t = self.type_or_none()
        if t is None:
            raise SyntaxProblem(f"expected a type, found {self.peek()!r} at {self.tokens[self.i][2]}")
        return t

    def type_or_none(self) -> Node | None:
        p = self.peek()
        if p == "name":
            t = Node("Ident", text=self.take())
            if self.skip("."):
                t = Node("Selector", t, sel=self.take("name"))
            if self.peek() == "[" and self.peek(1) != "]":
                self.take()
                args = [self.type()]
                while self.skip(","):
                    if self.peek() != "]":
                        args.append(self.type())
                self.take("]")
                t = Node("Index", t, *args)
            return t
        if p == "*":
            self.take()
            return Node("Star", self.type())
        if p == "(":
            self.take()
            t = self.type()
            self.take(")")
            return Node("Paren", t)
        if p == "[":
            self.take()
            size = None
            if self.peek() == "...":
                self.take()
                size = Node("Ellipsis")
            elif self.peek() != "]":
                old, self.level = self.level, self.level + 1
                size = self.expression()
                self.level = old
            self.take("]")
            element = self.type()
            return Node("ArrayType", size, element, element=element)
        if p == "map":
            self.take()
            self.take("[")
            key = self.type()
            self.take("]")
            value = self.type()
            return Node("MapType", key, value)
        if p == "chan":
            self.take()
            self.skip("<-")
            return Node("ChanType", self.type())
        if p == "<-":
            self.take()
            self.take("chan")
            return Node("ChanType", self.type())
        if p == "func":
            self.take()
            return self.func_type()
        if p == "struct":
            return self.struct()
        if p == "interface":
            return self.interface()
        return None

    def func_type(self) -> Node:
        params, results = self.signature()
        return Node("FuncType", *params, *(results or []))

    def struct(self) -> Node:
        self.take("struct")
        self.take("{")
        fields = []
        while self.peek() != "}":
            if self.peek() == "*" or self.peek() == "name" and self.peek(1) in (".", ";", "}", "literal"):
                t = self.type()
                fields.append(Node("Field", t, names=[], type=t))
            elif self.peek() == "name" and self.peek(1) == "[" and self.peek(2) != "]":
                first = self.parameter_type(True)
                t = self.type() if self.peek() not in (";", "}", "literal") else first
                fields.append(Node("Field", t, names=[], type=t))
            else:
                names = [self.take("name")]
                while self.skip(","):
                    names.append(self.take("name"))
                t = self.type()
                fields.append(Node("Field", t, names=names, type=t))
            self.skip("literal")
            self.end()
        self.take("}")
        return Node("StructType", *fields)

    def interface(self) -> Node:
        self.take("interface")
        self.take("{")
        fields = []
        while self.peek() != "}":
            if self.peek() == "name" and self.peek(1) == "(":
                self.take()
                t = self.func_type()
            else:
                t = self.constraint()
            fields.append(Node("Field", t, names=[], type=t))
            self.end()
        self.take("}")
        return Node("InterfaceType", *fields)

    # declarations and statements
    def declaration(self) -> Node:
        word = self.take("const", "var", "type")
        return Node("Decl", *self.group(self.type_spec if word == "type" else self.value_spec))

    def type_spec(self) -> Node:
        self.take("name")
        params = []
        if self.peek() == "[" and self.peek(1) == "name" and self.peek(2) != "]":
            start = self.i
            try:
                params = self.type_parameters()
            except SyntaxProblem:
                self.i = start  # an array type
        self.skip("=")
        return Node("TypeSpec", *params, self.type())

    def value_spec(self) -> Node:
        self.take("name")
        while self.skip(","):
            self.take("name")
        t = self.type_or_none()
        values = self.expressions() if self.skip("=") else []
        return Node("ValueSpec", t, *values)

    def block(self) -> Node:
        self.take("{")
        old, self.level = self.level, 0
        out = self.statements()
        self.take("}")
        self.level = old
        return Node("Block", *out)

    def statements(self) -> list[Node]:
        out = []
        while self.peek() not in ("}", "case", "default", "end"):
            s = self.statement()
            if s is not None:
                out.append(s)
            if self.peek() not in ("}", "case", "default"):
                self.take(";")
        return out

    def statement(self) -> Node | None:
        p = self.peek()
        if p == ";":
            return None
        if p in ("const", "var", "type"):
            return self.declaration()
        if p == "{":
            return self.block()
        if p in ("if", "for", "switch", "select"):
            return getattr(self, f"{p}_statement")()
        if p == "return":
            self.take()
            return Node("Return", *([] if self.peek() in (";", "}") else self.expressions()))
        if p in ("break", "continue", "goto", "fallthrough"):
            self.take()
            if self.peek() == "name":
                self.take()
            return Node("Branch", text=p)
        if p in ("go", "defer"):
            self.take()
            return Node(p.title(), self.expression())
        if p == "name" and self.peek(1) == ":":
            self.i += 2
            s = None if self.peek() == "}" else self.statement()
            return Node("Labeled", s)
        return self.simple()

    def simple(self, ranges: bool = False) -> Node:
        if ranges and self.peek() == "range":
            self.take()
            return Node("Range", self.expression())
        left = self.expressions()
        p = self.peek()
        if p in ASSIGNS:
            self.take()
            if ranges and p in ("=", ":=") and self.peek() == "range":
                self.take()
                return Node("Range", *left, self.expression())
            return Node("Assign", *left, *self.expressions(), text=p)
        if len(left) > 1:
            raise SyntaxProblem(f"unexpected {p!r} after a list at {self.tokens[self.i][2]}")
        if p in ("++", "--"):
            self.take()
            return Node("IncDec", left[0])
        if p == "<-":
            self.take()
            return Node("Send", left[0], self.expression())
        return Node("Expr", left[0])

    def if_statement(self) -> Node:
        self.take("if")
        old, self.level = self.level, -1
        init = condition = None
        if self.peek() != ";":
            condition = self.simple()
        if self.skip(";"):
            init, condition = condition, self.simple()
        self.level = old
        body, other = self.block(), None
        if self.skip("else"):
            other = self.if_statement() if self.peek() == "if" else self.block()
        return Node("If", init, condition, body, other, body=body, other=other)

    def for_statement(self) -> Node:
        self.take("for")
        old, self.level = self.level, -1
        parts: list[Node | None] = [None, None, None]
        if self.peek() != "{":
            if self.peek() != ";":
                parts[1] = self.simple(True)
            if parts[1] is None or parts[1].kind != "Range":
                if self.skip(";"):
                    parts[0], parts[1] = parts[1], None
                    if self.peek() not in (";", "{"):
                        parts[1] = self.simple()
                    if self.skip(";") and self.peek() != "{":
                        parts[2] = self.simple()
        self.level = old
        body = self.block()
        if parts[1] is not None and parts[1].kind == "Range":
            return Node("RangeFor", *parts[1].kids, body, body=body)
        return Node("For", *parts, body, body=body)

    def switch_statement(self) -> Node:
        self.take("switch")
        old, self.level = self.level, -1
        init = tag = None
        if self.peek() != "{":
            if self.peek() != ";":
                tag = self.simple()
            if self.skip(";"):
                init, tag = tag, None
                if self.peek() != "{":
                    tag = self.simple()
        self.level = old
        self.take("{")
        clauses = []
        while self.peek() != "}":
            listed = None
            if self.skip("case"):
                listed = [self.expression_or_type()]
                while self.skip(","):
                    listed.append(self.expression_or_type())
            else:
                self.take("default")
            self.take(":")
            body = self.statements()
            clauses.append(Node("Case", *(listed or []), *body, default=listed is None, body=body))
        self.take("}")
        body = Node("Block", *clauses)
        return Node("Switch", init, tag, body, body=body)

    def select_statement(self) -> Node:
        self.take("select")
        self.take("{")
        clauses = []
        while self.peek() != "}":
            comm = None
            if self.skip("case"):
                comm = self.simple()
            else:
                self.take("default")
            self.take(":")
            body = self.statements()
            clauses.append(Node("Comm", comm, *body, body=body))
        self.take("}")
        body = Node("Block", *clauses)
        return Node("Select", body, body=body)

    # expressions
    def expressions(self) -> list[Node]:
        out = [self.expression()]
        while self.skip(","):
            out.append(self.expression())
        return out

    def expression_or_type(self) -> Node:
        return self.expression()

    def expression(self, least: int = 1) -> Node:
        left = self.unary()
        while (p := PRECEDENCE.get(self.peek(), 0)) >= least:
            op = self.take()
            left = Node("Binary", left, self.expression(p + 1), text=op)
        return left

    def unary(self) -> Node:
        p = self.peek()
        if p in ("+", "-", "!", "^", "&", "~"):
            self.take()
            return Node("Unary", self.unary(), text=p)
        if p == "*":
            self.take()
            return Node("Star", self.unary())
        if p == "<-":
            if self.peek(1) == "chan":
                return self.primary(self.type())
            self.take()
            return Node("Unary", self.unary(), text="<-")
        return self.primary(self.operand())

    def operand(self) -> Node:
        p = self.peek()
        if p == "name":
            return Node("Ident", text=self.take())
        if p == "literal":
            return Node("Literal", text=self.take())
        if p == "(":
            self.take()
            old, self.level = self.level, self.level + 1 if self.level >= 0 else 1
            x = self.expression_or_type()
            self.level = old
            self.take(")")
            return Node("Paren", x)
        if p == "func":
            self.take()
            t = self.func_type()
            if self.peek() == "{":
                old, self.level = self.level, 0
                body = self.block()
                self.level = old
                return Node("FuncLit", t, body)
            return t
        t = self.type_or_none()
        if t is None:
            raise SyntaxProblem(f"unexpected {p!r} at {self.tokens[self.i][2]}")
        return t

    def primary(self, x: Node) -> Node:
        while True:
            p = self.peek()
            if p == ".":
                self.take()
                if self.skip("("):
                    t = None if self.skip("type") else self.type()
                    self.take(")")
                    x = Node("TypeAssert", x, t)
                else:
                    x = Node("Selector", x, sel=self.take("name"))
            elif p == "(":
                self.take()
                old, self.level = self.level, 1
                args = []
                while self.peek() != ")":
                    args.append(self.expression_or_type())
                    self.skip("...")
                    if not self.skip(","):
                        break
                self.take(")")
                self.level = old
                x = Node("Call", x, *args, fun=x)
            elif p == "[":
                self.take()
                old, self.level = self.level, 1
                parts, colons = [], 0
                while self.peek() != "]":
                    if self.skip(":"):
                        colons += 1
                    elif not self.skip(","):
                        parts.append(self.expression_or_type())
                self.take("]")
                self.level = old
                x = Node("Slice" if colons else "Index", x, *parts)
            elif p == "{" and self.literal_type(x):
                x = Node("CompositeLit", x, *self.elements())
            else:
                return x

    def literal_type(self, x: Node) -> bool:
        if x.kind in ("ArrayType", "MapType", "StructType"):
            return True
        if self.level < 0:
            return False
        base = x.kids[0] if x.kind == "Index" else x
        return base.kind == "Ident" or base.kind == "Selector" and base.kids[0].kind == "Ident"

    def elements(self) -> list[Node]:
        self.take("{")
        old, self.level = self.level, 1
        out = []
        one = lambda: Node("CompositeLit", *self.elements()) if self.peek() == "{" else self.expression()
        while self.peek() != "}":
            x = one()
            if self.skip(":"):
                x = Node("KeyValue", x, one())
            out.append(x)
            if not self.skip(","):
                break
        self.take("}")
        self.level = old
        return out


# what is said about a function
def type_string(t: Node) -> str:
    k = t.kind
    if k == "Ident":
        return t.text
    if k == "Star":
        return "*" + type_string(t.kids[0])
    if k == "Selector":
        return f"{type_string(t.kids[0])}.{t.parts['sel']}"
    if k == "ArrayType":
        return "[]" + type_string(t.parts["element"])
    if k == "MapType":
        return f"map[{type_string(t.kids[0])}]{type_string(t.kids[1])}"
    return {"FuncType": "func", "InterfaceType": "interface{}"}.get(k) or ({"ChanType": "chan ", "Ellipsis": "..."}[k] + type_string(t.kids[0]) if k in ("ChanType", "Ellipsis") and t.kids else "")


TOKEN_OF = {
    "If": "IF", "For": "FOR", "RangeFor": "RANGE", "Switch": "SWITCH", "Case": "CASE", "Select": "SELECT", "Comm": "COMM", "Return": "RETURN", "Go": "GO", "Send": "SEND", "Defer": "DEFER",
    "FuncLit": "FUNCLIT", "Assign": "ASSIGN", "CompositeLit": "COMPOSITE_LIT", "Binary": "BINARY_OP", "TypeAssert": "TYPE_ASSERT",
}
_FLOW = {"If": "if", "For": "for", "RangeFor": "range", "Switch": "switch", "Select": "select", "Return": "return", "Defer": "defer", "Go": "go", "Send": "send"}


def _package_name(x: Node, aliases: dict[str, str]) -> str | None:
    """The import path that a selector refers to."""
    return aliases.get(x.kids[0].text) if x.kind == "Selector" and x.kids[0].kind == "Ident" else None


def depth(n: Node, at: int, branches_only: bool) -> int:
    """The deepest nesting of statements under ``n``; loops don't count where only branches do. Labels and literals aren't entered."""
    most, stack = 0, [(n, at)]
    while stack:
        n, d = stack.pop()
        if not branches_only:
            most = max(most, d)
        k = n.kind
        if k == "Block":
            stack += [(x, d) for x in n.kids]
        elif k in ("Case", "Comm"):
            stack += [(x, d) for x in n.parts["body"]]
        elif k in ("If", "Switch", "Select"):
            most = max(most, d + 1)
            stack.append((n.parts["body"], d + 1))
            if n.parts.get("other") is not None:
                stack.append((n.parts["other"], d + 1))
        elif k in ("For", "RangeFor"):
            stack.append((n.parts["body"], d + (not branches_only)))
    return most


def _count(fields: list[Node] | None) -> int:
    return sum(max(len(f.parts["names"]), 1) for f in fields or [])


def structure(f: dict, aliases: dict[str, str]) -> tuple[dict, list[int]]:
    """The features of a function and its token sequence: one token for each telling node, then a RETURN for each returned value."""
    flow, tokens = dict.fromkeys(CONTROL_FLOW, 0), []
    cyclo, calls, literals = 1, 0, 0
    for n in f["body"].walk():
        k = n.kind
        if k in _FLOW:
            flow[_FLOW[k]] += 1
        if k in ("If", "For", "RangeFor", "Comm") or k == "Case" and not n.parts["default"] or k == "Binary" and n.text in ("&&", "||"):
            cyclo += 1
        if k == "Branch":
            if n.text in ("continue", "break", "goto"):
                flow[n.text] += 1
                cyclo += n.text == "goto"
                tokens.append(CODE[n.text.upper()])
        elif k == "Call":
            calls += 1
            fun = n.parts["fun"]
            tokens.append(CODE["CALL" if fun.kind != "Selector" else "CALL_PKG" if _package_name(fun, aliases) else "CALL_METHOD"])
        elif k in TOKEN_OF:
            literals += k == "FuncLit"
            tokens.append(CODE[TOKEN_OF[k]])
    params, results = f["params"], f["results"]
    returns, body = _count(results), f["body"].kids
    types = [p.parts["type"] for p in params]
    features = {
        "cyclomatic_complexity": cyclo, "branching_depth": depth(f["body"], 0, True), "nesting_depth": depth(f["body"], 0, False), "early_returns": sum(s.kind == "Return" for s in body[:-1]),
        "control_flow": flow, "outbound_calls": calls, "func_literal_count": literals, "goroutine_spawns": flow["go"], "param_count": _count(params), "return_count": returns,
        "has_func_param": any(t.kind == "FuncType" for t in types), "has_context_param": any(type_string(t) == "context.Context" for t in types),
        "has_error_return": any(type_string(r.parts["type"]) == "error" for r in results or []),
    }
    return features, tokens + [CODE["RETURN"]] * returns


def trivial_constructor(f: dict) -> bool:
    body = f["body"].kids
    if not f["name"].startswith("New") or len(body) != 1 or body[0].kind != "Return" or len(body[0].kids) != 1:
        return False
    x = body[0].kids[0]
    return (x.kids[0] if x.kind == "Unary" and x.text == "&" else x).kind == "CompositeLit"


def parse_file(source: str, path: str = "") -> list[dict]:
    """A row (as in schema.FUNCTIONS, without fn_id and hashes) for each function with a body. SyntaxProblem if the file has an error."""
    from ..operators.cluster import TEST_IMPORTS

    p = Parser(source)
    tree = p.file()
    paths = [x for _, x in tree["imports"]]
    aliases = {(alias or x.rsplit("/", 1)[-1]): x for alias, x in tree["imports"] if alias not in ("_", ".")}
    generated, test = any(c.startswith("// Code generated") for c in p.comments), any(x in TEST_IMPORTS for x in paths)
    out = []
    for f in tree["functions"]:
        features, tokens = structure(f, aliases)
        used, targets = set(), set()
        for n in f["tree"].walk():
            if n.kind == "Selector" and (x := _package_name(n, aliases)):
                used.add(x)
            elif n.kind == "Call" and (x := _package_name(n.parts["fun"], aliases)):
                targets.add(f"{x}.{n.parts['fun'].parts['sel']}")
        receiver = ""
        if f["receiver"]:
            t = f["receiver"][0].parts["type"]
            receiver = type_string(t) if t.kind == "Ident" or t.kind == "Star" and t.kids[0].kind == "Ident" else ""
        start, end = source.count("\n", 0, f["begin"]) + 1, source.count("\n", 0, f["end"]) + 1
        each = lambda fields: [x for x in fields or [] for _ in range(max(len(x.parts["names"]), 1))]
        out.append({
            "name": f["name"], "package": tree["package"], "file_name": path.rsplit("/", 1)[-1], "file_path": path, "lang": "golang", "start_line": start, "end_line": end, "line_count": end - start + 1,
            "is_method": f["receiver"] is not None, "is_exported": f["name"][0].isupper(), "receiver": receiver,
            "params": [{"type_name": type_string(x.parts["type"]), "is_func_type": x.parts["type"].kind == "FuncType", "is_interface": x.parts["type"].kind == "InterfaceType"} for x in each(f["params"])],
            "returns": [{"type_name": type_string(x.parts["type"]), "is_error": type_string(x.parts["type"]) == "error"} for x in each(f["results"])],
            "features": features, "token_seq": tokens, "call_targets": sorted(targets), "imports": paths, "direct_imports": sorted(used), "generated_code": generated, "test_code": test,
            "is_constructor": trivial_constructor(f), "body": source[f["begin"] : f["end"]],
        })
    return out
