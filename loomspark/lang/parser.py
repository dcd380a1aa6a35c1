"""Text to tree, by recursive descent over one token pattern."""

from __future__ import annotations

import re
from decimal import Decimal

from ..errors import QueryError
from .tree import ONCE, ROOTS, Arg, Both, Call, Compare, Either, Literal, Not, Path, Query, Star, Within

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>\#[^\n]*)|(?P<uuid>uuid"[^"]*")|(?P<hex>x"[0-9A-Fa-f]*")|(?P<bytes>b"(?:[^"\\]|\\.)*")
    |(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*|`[^`]+`)|(?P<op>==|!=|<=|>=|&&|\|\||[<>!.,:()\[\]*])""",
    re.VERBOSE,
)
COMPARE = ("==", "!=", "<", "<=", ">", ">=")
MOST_CHARACTERS, DEEPEST = 100_000, 64


def tokens(text: str) -> list[tuple[str, str]]:
    if len(text) > MOST_CHARACTERS:
        raise QueryError("E_PARSE", "the query is too long")
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError("E_PARSE", f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


def unescape(body: str) -> str:
    import json

    try:
        return json.loads(body)
    except ValueError as wrong:
        raise QueryError("E_LITERAL", f"bad string {body}") from wrong


class Parser:
    def __init__(self, text: str):
        every = tokens(text)
        self.directives = tuple((m[1].strip(), m[2].strip()) for kind, x in every if kind == "comment" and (m := re.match(r"#\s*([\w]+)\s*:\s*(.+)", x)))
        self.items = [t for t in every if t[0] != "comment"]
        self.at, self.depth = 0, 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.items[i] if i < len(self.items) else ("end", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if got[0] == "end" or text is not None and (got[1] != text or got[0] in ("string", "uuid", "bytes", "hex")):
            raise QueryError("E_PARSE", f"expected {text or 'more'}, found {got[1] or 'the end'}")
        self.at += 1
        return got

    def next_is(self, text: str) -> bool:
        kind, got = self.peek()
        return got == text and kind in ("op", "name")

    def name(self) -> str:
        kind, got = self.take()
        if kind != "name":
            raise QueryError("E_PARSE", f"expected a name, found {got}")
        return got.strip("`")

    def query(self) -> Query:
        explain = None
        if self.peek()[0] == "name" and self.peek()[1].upper() == "EXPLAIN" and self.peek(1)[1] != "(":
            self.take()
            modes = ("public", "developer", "proof", "coded", "ai", "forensic")
            explain = self.name() if self.peek()[1] in modes and self.peek(1)[1] not in ("(", ".") else "public"
        kind, first = self.peek()
        if kind == "name" and self.peek(1)[1] == "(":
            if first not in ROOTS:
                raise QueryError("E_PARSE", f"{first} is not a root")
            root = self.aliased(self.call(self.name()))
        else:  # a bare name is an object type
            root = self.aliased(Call("object", (Arg(Path((self.name(),))),)))
        methods: list[Call] = []
        while self.next_is("."):
            self.take()
            method = self.call(self.name())
            if method.name == "explain":
                explain = method.plain()[0].name if method.args else "public"
                if self.peek()[0] != "end":
                    raise QueryError("E_METHOD_CONFLICT", "explain must be last")
                break
            if method.name in ONCE and any(m.name == method.name for m in methods):
                raise QueryError("E_DUPLICATE_METHOD", method.name)
            methods.append(method)
        if self.peek()[0] != "end":
            raise QueryError("E_PARSE", f"unexpected {self.peek()[1]}")
        return Query(root, tuple(methods), self.directives, explain)

    def aliased(self, call: Call) -> Call:
        if self.next_is("as"):
            self.take()
            return Call(call.name, call.args, self.name())
        return call

    def call(self, name: str) -> Call:
        self.take("(")
        args = []
        while not self.next_is(")"):
            args.append(self.arg())
            if not self.next_is(")"):
                self.take(",")
        self.take(")")
        return Call(name, tuple(args))

    def arg(self) -> Arg:
        label = None
        if self.peek()[0] == "name" and self.peek(1)[1] == ":" and self.peek(1)[0] == "op":
            label = self.name()
            self.take(":")
        return Arg(self.either(), label)

    def either(self):
        self.depth += 1
        if self.depth > DEEPEST:
            raise QueryError("E_RESOURCE_LIMIT", "the expression is too deep")
        parts = [self.both()]
        while self.next_is("||"):
            self.take()
            parts.append(self.both())
        self.depth -= 1
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def both(self):
        parts = [self.negation()]
        while self.next_is("&&"):
            self.take()
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def negation(self):
        if self.next_is("!"):
            self.take()
            return Not(self.negation())
        return self.comparison()

    def comparison(self):
        left = self.operand()
        if self.peek()[0] == "op" and self.peek()[1] in COMPARE:
            return Compare(self.take()[1], left, self.operand())
        if self.next_is("in") and self.peek(1)[1] == "[":
            self.take()
            self.take("[")
            choices = []
            while not self.next_is("]"):
                x = self.operand()
                if not isinstance(x, Literal):
                    raise QueryError("E_PARSE", "a list holds literals only")
                choices.append(x)
                if not self.next_is("]"):
                    self.take(",")
            self.take("]")
            return Within(left, tuple(choices))
        return left

    def operand(self):
        kind, text = self.peek()
        if kind == "op" and text == "(":
            self.take()
            out = self.either()
            self.take(")")
            return self.suffixes(out)
        if kind == "op" and text == "*":
            self.take()
            return Star()
        if kind in ("string", "number", "uuid", "hex", "bytes"):
            self.take()
            return self.literal(kind, text)
        if kind != "name":
            raise QueryError("E_PARSE", f"unexpected {text or 'end'}")
        if text in ("true", "false", "null") and self.peek(1)[1] != "(":
            self.take()
            return Literal({"true": True, "false": False, "null": None}[text])
        name = self.name()
        if self.next_is("("):
            return self.suffixes(self.aliased(self.call(name)))
        parts = [name]
        while self.next_is(".") and self.peek(2)[1] != "(":
            self.take()
            parts.append(self.name())
        return self.suffixes(Path(tuple(parts)))

    def suffixes(self, value):
        while self.next_is("."):  # value.f(args) is f(value, args)
            self.take()
            call = self.call(self.name())
            value = self.aliased(Call(call.name, (Arg(value), *call.args)))
        return value

    @staticmethod
    def literal(kind: str, text: str) -> Literal:
        if kind == "string":
            return Literal(unescape(text))
        if kind == "number":
            return Literal(Decimal(text) if "." in text else int(text))
        if kind == "uuid":
            digits = text[5:-1].replace("-", "").lower()
            if not re.fullmatch("[0-9a-f]{32}", digits):
                raise QueryError("E_LITERAL", f"bad {text}")
            return Literal(digits, "uuid")
        if kind == "hex":
            if len(text[2:-1]) % 2:
                raise QueryError("E_LITERAL", f"odd number of digits in {text}")
            return Literal(bytes.fromhex(text[2:-1]), "binary")
        return Literal(unescape(text[1:]).encode(), "binary")


def parse(text: str) -> Query:
    return Parser(text).query()
