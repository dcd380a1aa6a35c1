"""Query templates: chains with typed parameters, rendered and checked by parsing."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from ..errors import QueryError
from .parser import parse
from .tree import Query, render

TYPES = {"int": int, "text": str, "bool": bool, "name": str}


@dataclass
class Template:
    """``text`` holds ``{parameter}`` marks; names are inserted bare and other values as literals."""

    name: str
    text: str
    parameters: dict[str, str] = field(default_factory=dict)

    def render(self, **values) -> str:
        if set(values) != set(self.parameters):
            raise QueryError("E_UNKNOWN_BINDING", f"{self.name} takes {sorted(self.parameters)}")
        written = {}
        for key, kind in self.parameters.items():
            value = values[key]
            if not isinstance(value, TYPES[kind]) or kind == "int" and isinstance(value, bool):
                raise QueryError("E_LITERAL", f"{key} is not of type {kind}")
            if kind == "name" and not re.fullmatch(r"[A-Za-z_]\w*", value):
                raise QueryError("E_LITERAL", f"{key} is not a name")
            written[key] = value if kind == "name" else json.dumps(value)
        return render(self.parsed(re.sub(r"\{(\w+)\}", lambda m: written[m[1]], self.text)))

    @staticmethod
    def parsed(text: str) -> Query:
        return parse(text)


#: Chains that fit every table.
BUILT_IN = [
    Template("count_by", "table({table}).groupBy({column}).select({column}, n: count(*)).orderBy(n, desc)", {"table": "name", "column": "name"}),
    Template("top", "table({table}).orderBy({column}, desc).take({n})", {"table": "name", "column": "name", "n": "int"}),
    Template("equal", "table({table}).where({column} == {value})", {"table": "name", "column": "name", "value": "text"}),
]
