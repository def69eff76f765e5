"""Syntax tree, control flow and variable events of a subset of C and C++, in plain Python on one text at a time.

The subset: functions, declarations, expression statements, if, while, for, do, switch, labels, return, break, continue, goto, and C expressions. Preprocessor lines are single nodes; whatever else does not fit becomes an ERROR node up to the next semicolon or brace, and the rest is parsed on. Spans are code points."""

from __future__ import annotations

import bisect
import re

_TOKEN = re.compile(
    r"(?P<skip>[\s\ufeff]+|//[^\n]*|/\*.*?(?:\*/|\Z)|\\\n)|(?P<pre>\#(?:[^\n\\]|\\.)*(?:\\\n[^\n]*)*)|(?P<str>[LuU]?\"(?:[^\"\\\n]|\\.)*\"?)|(?P<chr>[LuU]?'(?:[^'\\\n]|\\.)*'?)"
    r"|(?P<num>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<id>[^\W\d]\w*)|(?P<op><<=|>>=|\.\.\.|->\*?|::|\+\+|--|&&|\|\||[-+*/%&|^<>=!]=|<<|>>|[-+*/%&|^~<>=!?:;,.(){}\[\]])|(?P<bad>.)",
    re.S,
)
TYPE_WORDS = set("void char short int long float double signed unsigned bool auto struct union enum class const volatile static extern register inline typedef restrict mutable constexpr virtual".split())
_STATEMENT_WORDS = set("if else while for do switch case default return break continue goto sizeof".split())
_BINARY = {op: p for p, ops in enumerate(["||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %", "->* .*"], 1) for op in ops.split()}
_ASSIGN = set("= += -= *= /= %= &= |= ^= <<= >>=".split())
#: The children of a block that are statements of control flow.
STATEMENTS = {"declaration", "expression_statement", "return_statement", "if_statement", "while_statement", "for_statement", "switch_statement", "do_statement", "break_statement", "continue_statement"}
#: Nodes whose text is left out: it is the text of what they hold.
CONTAINERS = {"translation_unit", "function_definition", "compound_statement", "if_statement", "else_clause", "while_statement", "for_statement", "do_statement", "switch_statement", "FUNCTION_ENTRY"}
#: Nested nodes beyond which a text is given up as one ERROR.
DEPTH = 200


class Node:
    __slots__ = ("type", "start", "end", "children", "fields", "id")

    def __init__(self, type_: str, start: int, end: int, children: list[Node] = (), **fields: Node):
        self.type, self.start, self.end, self.children, self.fields, self.id = type_, start, end, list(children), fields, -1


class _TooDeep(Exception):
    pass


class _Parser:
    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
        self.tokens.append(("end", "", len(text), len(text)))
        self.i, self.depth, self.failed = 0, 0, False

    def at(self, *words: str) -> bool:
        return self.tokens[self.i][1] in words and self.tokens[self.i][0] in ("op", "id")

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)][0]

    def word(self, ahead: int = 0) -> str:
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)][1]

    def take(self) -> tuple:
        t = self.tokens[self.i]
        if t[0] != "end":
            self.i += 1
        return t

    def leaf(self, type_: str) -> Node:
        _, _, a, b = self.take()
        return Node(type_, a, b)

    def last(self) -> int:
        return self.tokens[self.i - 1][3] if self.i else 0

    def want(self, word: str) -> bool:
        if self.at(word):
            self.take()
            return True
        self.failed = True
        return False

    def matching(self, i: int) -> int:
        """The place of the bracket that closes the one at i (the end where none does)."""
        depth = 0
        for j in range(i, len(self.tokens)):
            w = self.tokens[j][1] if self.tokens[j][0] == "op" else ""
            depth += (w in ("(", "[", "{")) - (w in (")", "]", "}"))
            if depth <= 0:
                return j
        return len(self.tokens) - 1

    # ---- statements

    def unit(self) -> Node:
        root = Node("translation_unit", 0, len(self.text))
        while self.kind() != "end":
            before = self.i
            root.children.append(self.function() or self.statement())
            if self.i == before:
                self.failed = True
                root.children.append(self.leaf("ERROR"))
        return root

    def function(self) -> Node | None:
        """A definition: words and stars, a name, parameters in brackets, words, a block."""
        j = self.i
        while self.tokens[j][0] == "id" or self.tokens[j][1] in ("*", "&", "::", "~", "<", ">", ","):
            if self.tokens[j][1] in _STATEMENT_WORDS or (self.tokens[j][1] in ("<", ",") and not any(t[1] == ">" for t in self.tokens[j : j + 12])):
                return None
            j += 1
        if self.tokens[j][1] != "(" or j == self.i or self.tokens[j - 1][0] != "id" or self.tokens[j - 1][1] in TYPE_WORDS:
            return None
        close = self.matching(j)
        k = close + 1
        while k < len(self.tokens) and self.tokens[k][0] == "id" and self.tokens[k][1] not in _STATEMENT_WORDS:
            k = self.matching(k + 1) + 1 if k + 1 < len(self.tokens) and self.tokens[k + 1][1] == "(" else k + 1
        if k >= len(self.tokens) or self.tokens[k][1] != "{":
            return None
        start = self.tokens[self.i][2]
        kinds = []
        while self.i < j - 1:
            word = self.word()
            kinds.append(self.leaf("primitive_type" if word in TYPE_WORDS else "type_identifier" if self.kind() == "id" else word))
        name = self.leaf("identifier")
        inside = self.tokens[j][2]
        self.take()
        parameters = []
        while self.i < close:
            a, end, depth = self.i, self.i, 0
            while end < close and (depth or self.tokens[end][1] != ","):
                w = self.tokens[end][1]
                depth += (w in ("(", "[", "{")) - (w in (")", "]", "}"))
                end += 1
            named = [i for i in range(a, end) if self.tokens[i][0] == "id" and self.tokens[i][1] not in TYPE_WORDS]
            parts = []
            while self.i < end:
                here = self.i
                if self.kind() == "id":
                    parts.append(self.leaf("primitive_type" if self.word() in TYPE_WORDS else "identifier" if here == named[-1] and here > a else "type_identifier"))
                else:
                    self.take()
            if end > a:
                parameters.append(Node("parameter_declaration", self.tokens[a][2], self.tokens[end - 1][3], parts))
            if self.i < close:
                self.take()
        self.take()
        declarator = Node("function_declarator", name.start, self.last(), [name, Node("parameter_list", inside, self.last(), parameters)])
        self.i = k
        body = self.block()
        return Node("function_definition", start, body.end, [*kinds, declarator, body], body=body, declarator=declarator)

    def block(self) -> Node:
        start = self.tokens[self.i][2]
        self.take()
        out = []
        while self.kind() != "end" and not self.at("}"):
            before = self.i
            out.append(self.statement())
            if self.i == before:
                self.failed = True
                out.append(self.leaf("ERROR"))
        self.want("}")
        return Node("compound_statement", start, self.last(), out)

    def statement(self) -> Node:
        self.depth += 1
        if self.depth > DEPTH:
            raise _TooDeep
        try:
            return self._statement()
        finally:
            self.depth -= 1

    def _statement(self) -> Node:
        start, word = self.tokens[self.i][2], self.word() if self.kind() in ("id", "op") else ""
        if self.kind() == "pre":
            return self.leaf("preproc_directive")
        if word == "{":
            return self.block()
        if word in ("if", "while", "switch"):
            self.take()
            condition = self.condition()
            body = self.statement()
            out = Node(f"{word}_statement", start, body.end, [condition, body], condition=condition, body=body)
            if word == "if" and self.at("else"):
                at = self.tokens[self.i][2]
                self.take()
                other = self.statement()
                clause = Node("else_clause", at, other.end, [other], body=other)
                out.children.append(clause)
                out.fields["alternative"], out.end = clause, clause.end
            return out
        if word == "for":
            return self.for_loop(start)
        if word == "do":
            self.take()
            body = self.statement()
            parts = [body]
            if self.want("while"):
                parts.append(self.condition())
            self.want(";")
            return Node("do_statement", start, self.last(), parts)
        if word in ("return", "goto"):
            self.take()
            value = [] if self.at(";") or self.kind() == "end" else [self.expression()] if word == "return" else [self.leaf("statement_identifier")]
            self.want(";")
            return Node(f"{word}_statement", start, self.last(), value)
        if word in ("break", "continue"):
            self.take()
            self.want(";")
            return Node(f"{word}_statement", start, self.last())
        if word in ("case", "default"):
            self.take()
            value = [self.expression(ternary=False)] if word == "case" else []
            self.want(":")
            return Node("case_statement", start, self.last(), value)
        if self.kind() == "id" and self.word(1) == ":" and self.word(2) != ":" and word not in TYPE_WORDS:
            label = self.leaf("statement_identifier")
            self.take()
            return Node("labeled_statement", start, self.last(), [label])
        if word == ";":
            self.take()
            return Node("expression_statement", start, self.last())
        if self.declares():
            return self.declaration()
        value = self.expression()
        if not self.at(";"):
            return self.error(start, value)
        self.take()
        return Node("expression_statement", start, self.last(), [value])

    def error(self, start: int, *parts: Node) -> Node:
        """What does not fit, up to the next semicolon or brace."""
        self.failed = True
        while self.kind() not in ("end", "pre") and not self.at(";", "{", "}"):
            self.take()
        if self.at(";"):
            self.take()
        return Node("ERROR", start, max(self.last(), start), parts)

    def condition(self) -> Node:
        start = self.tokens[self.i][2]
        if not self.want("("):
            return Node("parenthesized_expression", start, start)
        value = self.expression()
        while self.kind() != "end" and not self.at(")", "{", "}", ";"):
            self.failed = True
            self.take()
        self.want(")")
        return Node("parenthesized_expression", start, self.last(), [value])

    def for_loop(self, start: int) -> Node:
        self.take()
        fields: dict[str, Node] = {}
        if self.want("("):
            close = self.matching(self.i - 1)
            if not self.at(";"):
                fields["initializer"] = self.declaration() if self.declares() else self.expression()
                if fields["initializer"].type != "declaration":
                    self.want(";")
            else:
                self.take()
            if not self.at(";", ")"):
                fields["condition"] = self.expression()
            if self.at(";"):
                self.take()
                if not self.at(")"):
                    fields["update"] = self.expression()
            if self.i < close:
                self.failed, self.i = True, close
            self.want(")")
        fields["body"] = self.statement()
        return Node("for_statement", start, fields["body"].end, list(fields.values()), **fields)

    def declares(self) -> bool:
        """Whether a declaration begins here: a word of a type, or a name, stars and a name before a sign that ends a declarator."""
        if self.kind() != "id" or self.word() in _STATEMENT_WORDS:
            return False
        if self.word() in TYPE_WORDS:
            return True
        j = self.i + 1
        while self.tokens[j][1] == "::" and self.tokens[j + 1][0] == "id":
            j += 2
        while self.tokens[j][1] in ("*", "&", "const"):
            j += 1
        return self.tokens[j][0] == "id" and self.tokens[j][1] not in _STATEMENT_WORDS and self.tokens[min(j + 1, len(self.tokens) - 1)][1] in ("=", ";", ",", "[", "(", ":")

    def declaration(self) -> Node:
        start = self.tokens[self.i][2]
        parts, seen = [], False
        while self.kind() == "id" or self.at("::"):
            known = self.word() in TYPE_WORDS
            after = self.word(1)
            if not known and seen and (after in ("=", ";", ",", "[", "(", ":", ")") or self.kind(1) == "end"):
                break
            parts.append(self.leaf("primitive_type" if known else "type_identifier" if self.kind() == "id" else "::"))
            seen = seen or not known or parts[-1].end - parts[-1].start > 2
            if self.at("{"):  # a struct's or enum's own block
                parts.append(self.block())
        while self.kind() != "end" and not self.at(";"):
            before = self.i
            d = self.declarator()
            if d is not None:
                parts.append(d)
            if self.at(","):
                self.take()
            elif not self.at(";") or self.i == before:
                return self.error(start, *parts)
        self.want(";")
        return Node("declaration", start, self.last(), parts)

    def declarator(self) -> Node | None:
        start, stars = self.tokens[self.i][2], 0
        while self.at("*", "&", "const", "(", "volatile"):
            stars += 1
            self.take()
        if self.kind() != "id":
            return None
        node = self.leaf("identifier")
        if stars:
            while self.at(")"):
                self.take()
            node = Node("pointer_declarator", start, self.last(), [node])
        while self.at("[", "("):
            kind, close = ("array_declarator", "]") if self.at("[") else ("function_declarator", ")")
            self.take()
            inner = [node]
            while self.kind() != "end" and not self.at(close, ";"):
                before = self.i
                inner.append(self.expression(comma=False))
                if self.at(","):
                    self.take()
                elif not self.at(close):
                    self.take()
                if self.i == before:
                    break
            self.want(close)
            node = Node(kind, node.start, self.last(), inner)
        if self.at(":"):  # a bit field
            self.take()
            self.expression(comma=False, ternary=False)
        if self.at("="):
            self.take()
            value = self.expression(comma=False)
            return Node("init_declarator", start, value.end, [node, value], declarator=node, value=value)
        return node

    # ---- expressions

    def expression(self, comma: bool = True, ternary: bool = True) -> Node:
        self.depth += 1
        if self.depth > DEPTH:
            raise _TooDeep
        try:
            left = self.assignment(ternary)
            while comma and self.at(","):
                self.take()
                right = self.assignment(ternary)
                left = Node("comma_expression", left.start, right.end, [left, right])
            return left
        finally:
            self.depth -= 1

    def assignment(self, ternary: bool) -> Node:
        left = self.binary(1)
        if self.kind() == "op" and self.word() in _ASSIGN:
            self.take()
            right = self.expression(comma=False, ternary=ternary)
            return Node("assignment_expression", left.start, right.end, [left, right], left=left, right=right)
        if ternary and self.at("?"):
            self.take()
            yes = self.expression()
            self.want(":")
            no = self.expression(comma=False)
            return Node("conditional_expression", left.start, no.end, [left, yes, no])
        return left

    def binary(self, least: int) -> Node:
        left = self.unary()
        while self.kind() == "op" and _BINARY.get(self.word(), 0) >= least:
            p = _BINARY[self.take()[1]]
            right = self.binary(p + 1)
            left = Node("binary_expression", left.start, right.end, [left, right])
        return left

    def unary(self) -> Node:
        start = self.tokens[self.i][2]
        marks = []
        while self.at("++", "--", "!", "~", "-", "+", "*", "&", "sizeof") or self.is_cast():
            if self.at("("):
                close = self.matching(self.i)
                self.i = close + 1
                marks.append((start, "cast_expression"))
            else:
                w = self.take()[1]
                marks.append((start, "update_expression" if w in ("++", "--") else "pointer_expression" if w in ("*", "&") else "sizeof_expression" if w == "sizeof" else "unary_expression"))
            start = self.tokens[self.i][2]
        node = self.postfix()
        for at, kind in reversed(marks):
            node = Node(kind, at, node.end, [node])
        return node

    def is_cast(self) -> bool:
        """A type in brackets before an operand: words of types, or a name and stars."""
        if not self.at("("):
            return False
        close = self.matching(self.i)
        inner = self.tokens[self.i + 1 : close]
        if not inner or any(t[0] != "id" and t[1] not in ("*", "&") for t in inner) or any(t[1] in _STATEMENT_WORDS for t in inner):
            return False
        after = self.tokens[min(close + 1, len(self.tokens) - 1)]
        operand = after[0] in ("id", "num", "str", "chr") or after[1] in ("(", "*", "&", "-", "!", "~", "{")
        return operand and (any(t[1] in TYPE_WORDS for t in inner) or (inner[-1][1] == "*" and len(inner) > 1) or (len(inner) == 1 and after[0] in ("id", "num", "str", "chr")))

    def postfix(self) -> Node:
        node = self.primary()
        while self.kind() == "op":
            if self.at("("):
                at = self.tokens[self.i][2]
                arguments = self.listed(")")
                node = Node("call_expression", node.start, self.last(), [node, Node("argument_list", at, self.last(), arguments)], function=node)
            elif self.at("["):
                node = Node("subscript_expression", node.start, 0, [node, *self.listed("]")])
                node.end = self.last()
            elif self.at(".", "->", "::") and self.kind(1) == "id":
                self.take()
                field = self.leaf("field_identifier")
                node = Node("field_expression", node.start, field.end, [node, field])
            elif self.at("++", "--"):
                self.take()
                node = Node("update_expression", node.start, self.last(), [node])
            else:
                break
        return node

    def listed(self, close: str) -> list[Node]:
        self.take()
        out = []
        while self.kind() != "end" and not self.at(close, ";"):
            before = self.i
            out.append(self.expression(comma=False))
            if self.at(","):
                self.take()
            elif not self.at(close):
                self.failed = True
                if self.i == before:
                    self.take()
        self.want(close)
        return out

    def primary(self) -> Node:
        kind = self.kind()
        if kind == "id":
            return self.leaf("primitive_type" if self.word() in TYPE_WORDS else "identifier")
        if kind in ("num", "str", "chr"):
            return self.leaf({"num": "number_literal", "str": "string_literal", "chr": "char_literal"}[kind])
        if self.at("("):
            start = self.tokens[self.i][2]
            inner = self.listed(")")
            return Node("parenthesized_expression", start, self.last(), inner)
        if self.at("{"):
            start = self.tokens[self.i][2]
            inner = self.listed("}")
            return Node("initializer_list", start, self.last(), inner)
        self.failed = True
        at = self.tokens[self.i][2]
        return Node("ERROR", at, at)


def parse(text: str) -> tuple[list[tuple[Node, int]], bool]:
    """([(node, parent's id or -1)] in order of the nodes' ids, whether something did not fit)."""
    p = _Parser(text)
    try:
        root = p.unit()
    except (_TooDeep, RecursionError):
        root, p.failed = Node("translation_unit", 0, len(text), [Node("ERROR", 0, len(text))]), True
    out, stack = [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        node.id = len(out)
        out.append((node, parent))
        stack.extend((c, node.id) for c in reversed(node.children))
    return out, p.failed


def identifiers(node: Node) -> list[Node]:
    """The identifiers of a subtree, in order."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.type == "identifier":
            out.append(n)
        stack.extend(reversed(n.children))
    return out


def function_name(node: Node) -> str | None:
    found = identifiers(node.fields["declarator"])
    return found[0] if found else None


class Flow:
    """The control flow of every function: nodes (type, source node or None) and edges (source, target, kind), labelled as they are made."""

    def __init__(self):
        self.nodes: list[tuple[str, Node | None]] = []
        self.edges: list[tuple[int, int, str]] = []

    def node(self, type_: str, of: Node | None = None) -> int:
        self.nodes.append((type_, of))
        return len(self.nodes) - 1

    def lead(self, ways: list[tuple[int, str]], to: int, kind: str | None = None) -> None:
        self.edges.extend((a, to, kind or k) for a, k in ways)

    def function(self, f: Node) -> None:
        entry, end = self.node("FUNCTION_ENTRY", f), self.node("FUNCTION_EXIT")
        self.lead(self.sequence(statements(f.fields["body"]), [(entry, "CFG")], end, None, None), end)

    def sequence(self, all_: list[Node], ways: list[tuple[int, str]], end: int, again: int | None, out: int | None) -> list[tuple[int, str]]:
        """The ways on from statements that are reached by ways; what follows a jump is left out. again, out: where continue and break lead."""
        for s in all_:
            if not ways:
                break
            if s.type == "if_statement":
                ways = self.branch(s, ways, end, again, out)
            elif s.type in ("while_statement", "for_statement"):
                ways = self.loop(s, ways, end)
            else:
                jump = {"break_statement": ("BREAK", out, "CFG_BREAK"), "continue_statement": ("CONTINUE", again, "CFG_CONTINUE"), "return_statement": (s.type, end, "CFG_RETURN")}.get(s.type)
                here = self.node(jump[0] if jump else s.type, s)
                self.lead(ways, here)
                ways = [(here, "CFG")]
                if jump:
                    if jump[1] is not None:
                        self.edges.append((here, jump[1], jump[2]))
                    ways = []
        return ways

    def branch(self, s: Node, ways, end, again, out):
        test, merge = self.node("IF_CONDITION", s.fields["condition"]), self.node("IF_MERGE")
        self.lead(ways, test)
        on = self.sequence(statements(s.fields["body"]), [(test, "CFG_TRUE")], end, again, out)
        other = s.fields.get("alternative")
        on += self.sequence(statements(other.fields["body"]) if other else [], [(test, "CFG_FALSE")], end, again, out)
        self.lead(on, merge)
        return [(merge, "CFG")] if on else []

    def loop(self, s: Node, ways, end):
        if s.type == "while_statement":
            test, out = self.node("WHILE_CONDITION", s.fields["condition"]), self.node("WHILE_EXIT")
            again = test
        else:
            out = self.node("FOR_EXIT")
            if "initializer" in s.fields:
                first = self.node("FOR_INITIALIZER", s.fields["initializer"])
                self.lead(ways, first)
                ways = [(first, "CFG")]
            test = self.node("FOR_CONDITION", s.fields.get("condition", s))
            again = self.node("FOR_UPDATE", s.fields["update"]) if "update" in s.fields else test
        self.lead(ways, test)
        on = self.sequence(statements(s.fields["body"]), [(test, "CFG_TRUE")], end, again, out)
        if again == test:
            self.lead(on, test, "CFG_LOOP_BACK")
        else:
            self.lead(on, again)
            self.edges.append((again, test, "CFG_LOOP_BACK"))
        self.edges.append((test, out, "CFG_FALSE"))
        return [(out, "CFG")]


def statements(body: Node) -> list[Node]:
    """The statements of a block, or a single one."""
    return [c for c in body.children if c.type in STATEMENTS] if body.type == "compound_statement" else [body] if body.type in STATEMENTS else []


def control_flow(nodes: list[tuple[Node, int]]) -> Flow:
    flow = Flow()
    for n, _ in nodes:
        if n.type == "function_definition":
            flow.function(n)
    return flow


def variable_events(root: Node) -> list[tuple[str, Node]]:
    """("DEF" or "USE", identifier) in order: of a declaration's first declarator the uses of its value, then its name; of an assignment the right side's uses, then the left side if it is a name; of an update a use and a definition; of a return its uses. What stands within these is not looked at again."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.type == "declaration":
            d = next((c for c in n.children if c.type == "init_declarator" or c.type.endswith("declarator") or c.type == "identifier"), None)
            if d is not None:
                if d.type == "init_declarator":
                    out += [("USE", i) for i in identifiers(d.fields["value"])]
                    d = d.fields["declarator"]
                out += [("DEF", i) for i in identifiers(d)[:1]]
        elif n.type == "assignment_expression":
            out += [("USE", i) for i in identifiers(n.fields["right"])]
            if n.fields["left"].type == "identifier":
                out.append(("DEF", n.fields["left"]))
        elif n.type == "update_expression":
            for i in identifiers(n):
                out += [("USE", i), ("DEF", i)]
        elif n.type == "return_statement":
            out += [("USE", i) for i in identifiers(n)]
        else:
            stack.extend(reversed(n.children))
    return out


def graph_rows(text: str) -> tuple[list[tuple], bool]:
    """The rows (part, id, type, source, target, start_line, end_line, start, end, text, variable) of a text's graphs: parts ast, cfg and dfg are nodes (an AST node's source is its parent), cfg_edge edges."""
    nodes, failed = parse(text)
    starts = [0] + [m.end() for m in re.finditer(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text)]
    line = lambda at: bisect.bisect_right(starts, at)
    span = lambda n: (line(n.start), line(max(n.start, n.end - 1)), n.start, n.end)
    rows = [("ast", n.id, n.type, None if parent < 0 else parent, None, *span(n), None if n.type in CONTAINERS else text[n.start : n.end], None) for n, parent in nodes]
    flow = control_flow(nodes)
    rows += [("cfg", i, t, None, None, *(span(n) if n else (None,) * 4), None if n is None or t == "FUNCTION_ENTRY" or n.type in CONTAINERS else text[n.start : n.end], None) for i, (t, n) in enumerate(flow.nodes)]
    rows += [("cfg_edge", i, k, a, b, None, None, None, None, None, None) for i, (a, b, k) in enumerate(flow.edges)]
    rows += [("dfg", i, k, None, None, *span(n), text[n.start : n.end], text[n.start : n.end]) for i, (k, n) in enumerate(variable_events(nodes[0][0]))]
    return rows, failed
