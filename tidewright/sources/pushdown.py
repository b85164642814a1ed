"""Conditions that a source applies as it reads: spark.read.format(…).option("where", where(("parameter", "=", 77), …)).

They are options of a load, not filters that Spark pushes: Spark 4.1 keeps what a Python source was pushed with the loaded table, so that
a later scan of the same DataFrame, with other filters or none, reads those partitions, and rows go missing. An option belongs to its load alone.
A condition is a column, =, <>, <, <=, >, >= or in, and a literal, or a column and `is null` or `is not null`; all must hold, and what a
null meets is false, as in SQL. A column that the source cannot test, or an unknown operator, is an error."""

from __future__ import annotations

import json
import operator
from collections.abc import Callable, Iterable, Mapping

_COMPARED: dict[str, Callable] = {
    "=": operator.eq,
    "<>": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "in": lambda v, some: v in some,
}


def where(*conditions: tuple) -> str:
    return json.dumps([list(c) for c in conditions])


class Conditions:
    def __init__(self, options: Mapping[str, str], columns: Iterable[str]):
        self.all: list[tuple] = [(c[0], c[1].lower(), *c[2:]) for c in json.loads(options.get("where") or "[]")]
        for name, op, *value in self.all:
            if name not in columns:
                raise ValueError(f"no condition on {name} is applied while reading; those on {', '.join(columns)} are")
            if (op not in _COMPARED or len(value) != 1) and (op not in ("is null", "is not null") or value):
                raise ValueError(f"condition {[name, op, *value]} is not understood")

    @staticmethod
    def _holds(value: object, op: str, *literal: object) -> bool:
        if op.startswith("is "):
            return (value is None) == (op == "is null")
        return value is not None and literal[0] is not None and _COMPARED[op](value, literal[0])

    def accept(self, **values: object) -> bool:
        """Whether the conditions on these columns accept them."""
        return all(self._holds(values[name], *rest) for name, *rest in self.all if name in values)

    def may_meet(self, name: str, low: float, high: float) -> bool:
        """Whether the conditions on this column may accept a value from low to high, each by itself."""
        for column, op, *literal in self.all:
            if column != name or op in ("<>", "is not null"):
                continue
            value = literal[0] if literal else None
            if op in ("=", "in"):
                if not any(x is not None and low <= x <= high for x in (value if op == "in" else [value])):
                    return False
            elif not self._holds(high if op in (">", ">=") else low, op, *literal):
                return False
        return True
