"""Fluent builder of the same trees that the parser makes."""

from __future__ import annotations

from decimal import Decimal

from .tree import Arg, Both, Call, Compare, Either, Literal, Not, Path, Query, Star, Within


def _node(x):
    if isinstance(x, E):
        return x.node
    if isinstance(x, Q):
        return x.tree().root
    if x is None or isinstance(x, bool | int | str | Decimal | bytes):
        return Literal(x, "binary" if isinstance(x, bytes) else "plain")
    return x


class E:
    """An expression; comparison and boolean operators build predicates."""

    def __init__(self, node):
        self.node = node

    def __eq__(self, other):
        return E(Compare("==", self.node, _node(other)))

    def __ne__(self, other):
        return E(Compare("!=", self.node, _node(other)))

    def __lt__(self, other):
        return E(Compare("<", self.node, _node(other)))

    def __le__(self, other):
        return E(Compare("<=", self.node, _node(other)))

    def __gt__(self, other):
        return E(Compare(">", self.node, _node(other)))

    def __ge__(self, other):
        return E(Compare(">=", self.node, _node(other)))

    def __and__(self, other):
        return E(Both((*_parts(self.node, Both), *_parts(_node(other), Both))))

    def __or__(self, other):
        return E(Either((*_parts(self.node, Either), *_parts(_node(other), Either))))

    def __invert__(self):
        return E(Not(self.node))

    __hash__ = None

    def within(self, *choices):
        return E(Within(self.node, tuple(_node(c) for c in choices)))

    def to(self, root):
        return E(Call("to", (Arg(self.node), Arg(_node(root)))))


def _parts(node, kind):
    return node.parts if isinstance(node, kind) else (node,)


def col(name: str) -> E:
    return E(Path(tuple(name.split("."))))


def lit(value) -> E:
    return E(_node(value))


def _args(plain, named) -> tuple[Arg, ...]:
    word = lambda v: Path((v.word,)) if isinstance(v, Word) else _node(v)
    return tuple([*(Arg(word(v)) for v in plain), *(Arg(word(v), k) for k, v in named.items())])


class Word:
    """A bare word among arguments, such as ``left`` in ``kind: left``."""

    def __init__(self, word: str):
        self.word = word


def fn(name: str, *plain, alias: str | None = None, **named) -> E:
    return E(Call(name, _args(plain, named), alias))


def agg(name: str, x=None) -> E:
    return E(Call(name, (Arg(Star() if x is None else _node(x)),)))


class Q:
    def __init__(self, kind: str, name: str, alias: str | None = None, methods: tuple[Call, ...] = ()):
        self.root, self.methods = Call(kind, (Arg(Path((name,))),), alias), methods

    def _with(self, method: Call) -> Q:
        out = Q.__new__(Q)
        out.root, out.methods = self.root, (*self.methods, method)
        return out

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda *plain, **named: self._with(Call(name, _args(plain, named)))

    def tree(self) -> Query:
        return Query(self.root, self.methods)
