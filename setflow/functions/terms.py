"""Terms: predicates and projections over the inputs of a computation.

Structure is kept for field access, method calls, whole objects, equality and conjunction: an equality between two
inputs is a join key. Everything else is a native term, a function from columns to a column. All terms compile to Catalyst
columns; none becomes a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from setflow.types import REGISTRY, TypeRegistry


class Term:
    """A node of an expression over inputs, which are numbered from 0."""

    kids: tuple[Term, ...] = ()

    def inputs(self) -> frozenset[int]:
        return frozenset().union(*(k.inputs() for k in self.kids)) if self.kids else frozenset()

    def compile(self, rows: list[Row]) -> Column:
        raise NotImplementedError

    # structural operators
    def __eq__(self, other) -> Term:  # type: ignore[override]
        return Equal(self, wrap(other))

    def __and__(self, other) -> Term:
        return Both(self, wrap(other))

    __hash__ = object.__hash__

    def same(self, other) -> Term:
        """Equality that is false, not null, where a side is null."""
        return native(lambda a, b: F.coalesce(a == b, F.lit(False)), self, other)

    # native operators
    def __ne__(self, other) -> Term:  # type: ignore[override]
        return native(lambda a, b: a != b, self, other)

    def __or__(self, other) -> Term:
        return native(lambda a, b: a | b, self, other)

    def __invert__(self) -> Term:
        return native(lambda a: ~a, self)

    def __lt__(self, other) -> Term:
        return native(lambda a, b: a < b, self, other)

    def __le__(self, other) -> Term:
        return native(lambda a, b: a <= b, self, other)

    def __gt__(self, other) -> Term:
        return native(lambda a, b: a > b, self, other)

    def __ge__(self, other) -> Term:
        return native(lambda a, b: a >= b, self, other)

    def __add__(self, other) -> Term:
        return native(lambda a, b: a + b, self, other)

    def __radd__(self, other) -> Term:
        return native(lambda a, b: b + a, self, other)

    def __sub__(self, other) -> Term:
        return native(lambda a, b: a - b, self, other)

    def __rsub__(self, other) -> Term:
        return native(lambda a, b: b - a, self, other)

    def __mul__(self, other) -> Term:
        return native(lambda a, b: a * b, self, other)

    def __rmul__(self, other) -> Term:
        return native(lambda a, b: b * a, self, other)

    def __truediv__(self, other) -> Term:
        return native(lambda a, b: a / b, self, other)

    def __mod__(self, other) -> Term:
        return native(lambda a, b: a % b, self, other)

    def isin(self, *values) -> Term:
        return native(lambda a: a.isin(*values), self)

    def apply(self, f: Callable[..., Column], *others) -> Term:
        return native(f, self, *others)

    def conjuncts(self) -> Iterator[Term]:
        yield self


class Row:
    """How the fields of one input are reached: by a table alias, or as a struct column."""

    def __init__(self, columns: list[str], alias: str | None = None, struct: Column | None = None, type_name: str | None = None, types: TypeRegistry = REGISTRY):
        self.columns, self.alias, self.struct, self.type_name, self.types = columns, alias, struct, type_name, types

    def __getitem__(self, path: str) -> Column:
        first, *rest = path.split(".")
        if self.struct is not None:
            out = self.struct.getField(first)
        else:
            out = F.col(f"{self.alias}.`{first}`" if self.alias else f"`{first}`")
        for name in rest:
            out = out.getField(name)
        return out

    def whole(self) -> Column:
        return self.struct if self.struct is not None else F.struct(*(self[c].alias(c) for c in self.columns))


class Member(Term):
    def __init__(self, slot: int, path: str):
        self.slot, self.path = slot, path

    def inputs(self) -> frozenset[int]:
        return frozenset([self.slot])

    def compile(self, rows: list[Row]) -> Column:
        return rows[self.slot][self.path]

    def __getitem__(self, name: str) -> Member:
        return Member(self.slot, f"{self.path}.{name}")


class Method(Term):
    """A method registered for the type of an input."""

    def __init__(self, slot: int, name: str, args: tuple = ()):
        self.slot, self.name, self.args = slot, name, args

    def inputs(self) -> frozenset[int]:
        return frozenset([self.slot])

    def compile(self, rows: list[Row]) -> Column:
        row = rows[self.slot]
        return row.types.method(row.type_name, self.name)(row, *self.args)


class Self(Term):
    def __init__(self, slot: int):
        self.slot = slot

    def inputs(self) -> frozenset[int]:
        return frozenset([self.slot])

    def compile(self, rows: list[Row]) -> Column:
        return rows[self.slot].whole()


class Native(Term):
    def __init__(self, f: Callable[..., Column], kids: tuple[Term, ...]):
        self.f, self.kids = f, kids

    def compile(self, rows: list[Row]) -> Column:
        return self.f(*(k.compile(rows) for k in self.kids))


class Constant(Term):
    def __init__(self, value):
        self.value = value

    def compile(self, rows: list[Row]) -> Column:
        return self.value if isinstance(self.value, Column) else F.lit(self.value)


class Equal(Term):
    def __init__(self, left: Term, right: Term):
        self.kids = (left, right)

    def compile(self, rows: list[Row]) -> Column:
        return self.kids[0].compile(rows) == self.kids[1].compile(rows)

    def is_key(self) -> bool:
        """Does it compare two different inputs?"""
        a, b = (k.inputs() for k in self.kids)
        return bool(a and b and not a & b)

    def __bool__(self) -> bool:
        return self.kids[0] is self.kids[1]


class Both(Term):
    def __init__(self, left: Term, right: Term):
        self.kids = (left, right)

    def compile(self, rows: list[Row]) -> Column:
        return self.kids[0].compile(rows) & self.kids[1].compile(rows)

    def conjuncts(self) -> Iterator[Term]:
        for k in self.kids:
            yield from k.conjuncts()


class Handle:
    """What a computation's functions get for each input."""

    def __init__(self, slot: int):
        self.slot = slot

    def __getitem__(self, path: str) -> Member:
        return Member(self.slot, path)

    def call(self, method: str, *args) -> Method:
        return Method(self.slot, method, args)

    def itself(self) -> Self:
        return Self(self.slot)


def wrap(value) -> Term:
    return value if isinstance(value, Term) else Constant(value)


def native(f: Callable[..., Column], *terms) -> Term:
    """A term of columns: f gets one column for each term or value."""
    return Native(f, tuple(wrap(t) for t in terms))
