"""Named element types: a registry from type name to StructType, with methods as column expressions.

A set has one declared type. Edges of a computation graph compare declared types when the graph is built; data is
checked against the declared StructType when a set is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

Method = Callable[..., Column]


@dataclass
class ElementType:
    name: str
    declared: T.StructType | str | None = None
    methods: dict[str, Method] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType | None:
        """Parsed when first asked for: text needs a session."""
        if isinstance(self.declared, str):
            self.declared = T.StructType.fromDDL(self.declared)
        return self.declared


class TypeRegistry:
    """Element types by name. A method takes a row, whose fields are columns by name, and returns a Column."""

    def __init__(self):
        self._types: dict[str, ElementType] = {}

    def register(self, name: str, schema: T.StructType | str | None = None, **methods: Method) -> ElementType:
        own = self._types.setdefault(name, ElementType(name))
        if schema is not None and own.declared is not None and own.declared != schema:
            schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            if own.schema != schema:
                raise TypeError(f"type {name} is already registered with another schema")
        own.declared = schema if schema is not None else own.declared
        own.methods.update(methods)
        return own

    def method(self, type_name: str | None, method: str) -> Method:
        for own in [self._types[type_name]] if type_name in self._types else self._types.values():
            if method in own.methods:
                return own.methods[method]
        raise KeyError(f"type {type_name} has no method {method}")

    def __contains__(self, name: str) -> bool:
        return name in self._types

    def __getitem__(self, name: str) -> ElementType:
        return self._types[name]

    def check(self, name: str | None, df: DataFrame) -> DataFrame:
        """df, if its columns are those of the type (order and nullability aside); else TypeError."""
        if name is None or name not in self._types or self._types[name].schema is None:
            return df
        want = {f.name: f.dataType.simpleString() for f in self._types[name].schema.fields}
        have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        wrong = {k: (v, have.get(k)) for k, v in want.items() if have.get(k) != v}
        if wrong:
            raise TypeError(f"set isn't of type {name}: " + ", ".join(f"{k} is {b}, not {a}" for k, (a, b) in wrong.items()))
        return df


REGISTRY = TypeRegistry()
