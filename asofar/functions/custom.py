"""User-defined scalar functions: a SQL body, which the optimiser inlines, or the name of a function that the session knows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Parameter:
    """A parameter's name and type; without a default it has to be given. test: the value that test() calls with."""

    name: str
    kind: str
    default: Any = None
    test: Any = None

    def accepts(self, kind: str) -> bool:
        """Numbers take any number; an unknown type is left to the analyser."""
        if not kind or kind == self.kind:
            return True
        return self.kind.startswith(_NUMBERS) and kind.startswith(_NUMBERS)


class UserDefinedFunction:
    """Callable on columns of a view, on features and on request columns. Constants are cast to their parameters' types."""

    def __init__(self, spark: SparkSession, name: str, parameters: list[Parameter], returns: str, body: str | None = None, function: str | None = None) -> None:
        if (body is None) == (function is None):
            raise ValueError("give a body or the name of a function")
        names = [p.name for p in parameters]
        if len(set(names)) < len(names) or not all(map(_NAME.fullmatch, [name, *names])):
            raise ValueError("functions and parameters need distinct plain names")
        self.name, self.parameters, self.returns, self._spark = name, tuple(parameters), returns, spark
        self.function = function or name
        if body is not None:
            said = ", ".join(f"{p.name} {p.kind}" for p in parameters)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({said}) RETURNS {returns} RETURN {body}")
        elif not spark.catalog.functionExists(function):
            raise ValueError(f"no such function: {function}")

    def _column(self, values: list[Column]) -> Column:
        return F.call_function(self.function, *values).cast(self.returns)

    def __call__(self, *args: Any, **named: Any) -> Any:
        from ..plans.expressions import Expression

        known = [p.name for p in self.parameters]
        if len(args) > len(known) or set(named) - set(known[len(args) :]):
            raise TypeError(f"{self.name} takes {', '.join(known)}")
        given = dict(zip(known, args, strict=False)) | named
        columns, expressions = [], []
        for p in self.parameters:
            if p.name not in given and p.default is None:
                raise TypeError(f"{self.name} needs {p.name}")
            value = given.get(p.name, p.default)
            if isinstance(value, Expression):
                if not p.accepts(value._kind()):
                    raise TypeError(f"{self.name}: {p.name} is {p.kind}, not {value._kind()}")
                expressions.append(value)
                columns.append(value.col)
            else:
                columns.append(F.lit(value).cast(p.kind))
        if not expressions:
            raise TypeError("a view's column or a feature is needed")
        out = expressions[0]._wrap(self._column(columns), *expressions[1:])
        if hasattr(out, "_type"):
            out._type = self.returns
        return out

    def test(self) -> Any:
        """The function's value for its parameters' test values."""
        return self._spark.range(1).select(self._column([F.lit(p.test).cast(p.kind) for p in self.parameters]).alias("v")).first()[0]
